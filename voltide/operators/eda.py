"""Descriptive tables: missing values, describe, histograms, density, profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.constants import INPUT_END, PRICE_EPS, RV_FLOOR
from voltide.functions import columns as vc
from voltide.functions.aggregates import count_where, mean_of_seconds, std_of_seconds, window_rv
from voltide.operators.book import SNAPSHOT, WHOLE, returns_by_piece
from voltide.plans.ordered import exact_quantiles

FEATURES = ["wap", "bid_ask_spread", "total_volume", "price_spread", "volume_imbalance"]
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def unpivot(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
    return df.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def overview(df: DataFrame) -> DataFrame:
    """Rows, stocks, snapshots and the range of seconds."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("stock_id").alias("n_stocks"),
                  F.count_distinct("time_id").alias("n_time_ids"), F.min("seconds_in_bucket").alias("min_second"),
                  F.max("seconds_in_bucket").alias("max_second"))


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Missing count and percentage per column, one pass."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[count_where(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("n_missing"))
                               for i, c in enumerate(cols)]))
    out = agg.select("_n", rows.alias("r")).select(
        "r.*", F.coalesce(F.try_divide(F.col("r.n_missing") * 100.0, F.col("_n")), F.lit(0.0)).alias("pct_missing"))
    return out.where("n_missing > 0") if only_missing else out


def rows_per_sample(df: DataFrame, expected: int = 600) -> DataFrame:
    """Distribution of rows per (stock, snapshot) and whether all have the expected count."""
    sizes = df.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("rows")).withColumn("_k", F.lit(0))
    stats = sizes.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("rows").alias("mean_rows"), F.stddev_samp("rows").alias("std_rows"),
        F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        count_where(F.col("rows") < expected).alias("n_short"), F.every(F.col("rows") == expected).alias("all_complete"))
    quant = exact_quantiles(sizes, ["_k"], "rows", {"q25": 0.25, "median_rows": 0.5, "q75": 0.75})
    return stats.join(F.broadcast(quant), "_k").drop("_k")


def describe(df: DataFrame, cols: Sequence[str], percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """count, mean, std, min, max and exact percentiles of each column."""
    long = unpivot(df, cols)
    stats = long.groupBy("feature").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    return stats.join(exact_quantiles(long, ["feature"], "v", percentiles), "feature")


def stock_summary(df: DataFrame) -> DataFrame:
    """Per-stock means, std, exact median spread, row count and relative spread."""
    stats = df.groupBy("stock_id").agg(
        F.avg("wap").alias("wap_mean"), F.stddev_samp("wap").alias("wap_std"), F.avg("bid_ask_spread").alias("spread_mean"),
        F.avg("total_volume").alias("volume_mean"), F.avg("price_spread").alias("price_spread_mean"),
        F.avg("volume_imbalance").alias("vol_imbal_mean"), F.count(F.lit(1)).alias("n_rows"))
    median = exact_quantiles(df, ["stock_id"], "bid_ask_spread", {"spread_median": 0.5})
    return stats.join(median, "stock_id", "left").withColumn("relative_spread", F.try_divide("spread_mean", "wap_mean"))


def target_overview(rv: DataFrame) -> DataFrame:
    """Zero-RV share, log-RV moments and share below the floor."""
    log_floor = F.log(F.lit(RV_FLOOR))
    return rv.agg(
        F.count(F.lit(1)).alias("n_total"), count_where(F.col("rv") == 0).alias("n_zero"),
        count_where(F.col("rv") > 0).alias("n_pos"),
        (F.avg((F.col("rv") == 0).cast("double")) * 100.0).alias("pct_zero"),
        F.avg("log_rv").alias("mean_log_rv"), F.stddev_samp("log_rv").alias("std_log_rv"),
        (F.avg((F.col("log_rv") < log_floor).cast("double")) * 100.0).alias("pct_below_floor"))


def stock_target_summary(rv: DataFrame) -> DataFrame:
    """Per-stock log-RV mean, std, count and share at the floor (a missing log counts as at it)."""
    at_floor = F.coalesce(F.col("log_rv"), F.lit(-999.0)) <= F.log(F.lit(RV_FLOOR))
    return rv.groupBy("stock_id").agg(
        F.avg("log_rv").alias("log_rv_mean"), F.stddev_samp("log_rv").alias("log_rv_std"),
        F.count("log_rv").alias("n_samples"), F.avg(at_floor.cast("double")).alias("frac_at_floor"))


def floor_counts(stock_rv: DataFrame) -> DataFrame:
    """Stocks with more than half, and more than 90 %, of samples at the floor."""
    return stock_rv.agg(count_where(F.col("frac_at_floor") > 0.5).alias("n_above_50pct"),
                        count_where(F.col("frac_at_floor") > 0.9).alias("n_above_90pct"))


def _binned(long: DataFrame, bounds: DataFrame, bins: int, clip_values: bool) -> DataFrame:
    """Counts and densities per (feature, bin) with the given per-feature bounds."""
    joined = long.join(F.broadcast(bounds), "feature")
    v = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi")) if clip_values else F.col("v")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_no = F.least(F.floor(F.coalesce(F.try_divide(v - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = joined.select("feature", "lo", "hi", bin_no.alias("bin")).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "bin", (F.col("lo") + step * F.col("bin")).alias("left_edge"), "n",
        F.try_divide(F.col("n").cast("double"), F.col("_total") * step).alias("density"))


def clipped_histogram(df: DataFrame, cols: Sequence[str], bins: int = 100, tails: float = 0.005) -> DataFrame:
    """Equal-width histogram of each column after clipping to its two tail quantiles.

    The bounds table has one row per column, which bounds the broadcast.
    """
    long = unpivot(df, cols).where("v IS NOT NULL")
    bounds = exact_quantiles(long, ["feature"], "v", {"lo": tails, "hi": 1.0 - tails})
    return _binned(long, bounds, bins, True)


def range_histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram over the observed range, or from ``lo`` / to ``hi``."""
    long = unpivot(df, [col]).where("v IS NOT NULL")
    bounds = long.groupBy("feature").agg(
        (F.min("v") if lo is None else F.lit(float(lo))).alias("lo"), (F.max("v") if hi is None else F.lit(float(hi))).alias("hi"))
    return _binned(long, bounds, bins, True)


def log_spaced_histogram(df: DataFrame, col: str, edges: int = 80) -> DataFrame:
    """Histogram with ``edges`` edges spaced evenly in log10 between whole decades."""
    pos = df.where(F.col(col) > 0)
    bounds = pos.agg(F.floor(F.log10(F.min(col))).alias("lo"), F.ceil(F.log10(F.max(col))).alias("hi")).select(
        F.lit(col).alias("feature"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    return _binned(unpivot(pos.withColumn(col, F.log10(col)), [col]), bounds, edges - 1, True).select(
        "bin", F.pow(F.lit(10.0), F.col("left_edge")).alias("left_edge"), "n")


def capped_histogram(df: DataFrame, col: str, bins: int, share: float = 0.99) -> DataFrame:
    """Equal-width histogram from the least value to the ``share`` quantile, to which larger values are cut."""
    long = unpivot(df, [col]).where("v IS NOT NULL")
    top = exact_quantiles(long, ["feature"], "v", {"hi": share})
    bounds = long.groupBy("feature").agg(F.min("v").alias("lo")).join(F.broadcast(top), "feature")
    return _binned(long, bounds, bins, True)


def kernel_density(df: DataFrame, col: str, points: int = 500, factor: float = 0.1, tails: float = 0.001) -> DataFrame:
    """Gaussian density estimate on an even grid between two tail quantiles (values clipped to them).

    A task adds its values' heights to ``points`` running sums, an Arrow batch at a time, and emits one row per point.
    """
    long = unpivot(df, [col]).where("v IS NOT NULL")
    bounds = exact_quantiles(long, ["feature"], "v", {"lo": tails, "hi": 1.0 - tails})
    clipped = long.join(F.broadcast(bounds), "feature").select(
        "lo", "hi", F.least(F.greatest("v", "lo"), F.col("hi")).alias("v"))
    shape = clipped.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    spark = df.sparkSession
    if not shape["n"]:
        return spark.createDataFrame([], "point int, x double, density double")
    grid = shape["lo"] + (shape["hi"] - shape["lo"]) * np.arange(points) / (points - 1.0)
    band = (shape["sd"] or 0.0) * factor

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(points)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, len(v), 1024):
                u = (grid[:, None] - v[None, s:s + 1024]) / band
                sums += np.exp(-0.5 * u * u).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(sums)], ["point", "s"])

    places = spark.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "point int, x double")
    if band <= 0.0:
        return places.withColumn("density", F.lit(None).cast("double"))
    sums = clipped.select("v").mapInArrow(add, "point int, s double").groupBy("point").agg(F.sum("s").alias("s"))
    return places.join(sums, "point").select("point", "x", (F.col("s") / (shape["n"] * band * 2.5066282746310002)).alias("density"))


def second_profile(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and std of each column, and the std of the log return, at every second."""
    rows = returns_by_piece(df, PRICE_EPS, first=0.0, every=1)
    aggs = [a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return rows.groupBy("seconds_in_bucket").agg(*aggs, F.stddev_samp("log_return").alias("lr_std"))


def input_window_samples(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Per sample: mean and std of each column over the input window, and log input RV."""
    early = df.where(F.col("seconds_in_bucket") < INPUT_END).selectExpr("*", *[f"{c} - last({c}, true) OVER {WHOLE} AS {c}_d" for c in cols])
    rows = returns_by_piece(early, PRICE_EPS, first=0.0, every=INPUT_END).where(F.col("seconds_in_bucket") < INPUT_END)
    aggs = [F.expr(a) for c in cols for a in (f"{mean_of_seconds(c)} AS {c}_mean", f"{std_of_seconds(c, f'{c}_d')} AS {c}_std")]
    log_rv = F.log(vc.at_least(window_rv("log_return", None, None), PRICE_EPS))
    return rows.groupBy(*SNAPSHOT).agg(*aggs, log_rv.alias("log_rv_input"))


def hash_sample(df: DataFrame, keys: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """Deterministic random sample of at most ``n`` rows (a top-k by hash of whole-number keys, merged across tasks)."""
    h = vc.mixed_hash(F.col(keys[0]), seed)
    for k in keys[1:]:
        h = vc.mixed_hash(h + F.col(k), seed)
    return df.orderBy(h, *keys).limit(n)
