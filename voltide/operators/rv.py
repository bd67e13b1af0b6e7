"""Realised volatility in its several definitions, bucket tables and regime labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.constants import (
    BUCKET_EPS, FEATURE_EPS, INPUT_END, LIVE_TARGET_LOG_RV, PRICE_EPS, RV_FLOOR, SECONDS_PER_SNAPSHOT, TARGET_END,
)
from voltide.functions import columns as vc
from voltide.functions.aggregates import mean_of_seconds, window_rv, window_text
from voltide.operators.book import BY_SECOND, SNAPSHOT, returns_by_piece
from voltide.plans.ordered import exact_quantiles

BUCKETS_120 = [("rv_b0", 0, 120), ("rv_b1", 120, 240), ("rv_b2", 240, 360), ("rv_b3", 360, 480),
               ("rv_target", 480, 600)]


def realised_vol(df: DataFrame, windows: Sequence[tuple[str, int | None, int | None]], edge: str = "include",
                 eps: float | None = PRICE_EPS, first: float | None = None, clip: float | None = None,
                 floor: float | None = None, missing: float | None = None) -> DataFrame:
    """RV per (stock, snapshot) for several windows in one aggregate, from seconds or runs.

    ``edge='include'`` counts the return that enters a window from the second before it (returns
    taken, then filtered); ``'exclude'`` takes returns inside each window only.
    """
    every = math.gcd(*[b for _, lo, hi in windows for b in (lo, hi) if b]) or SECONDS_PER_SNAPSHOT
    if edge == "include":
        rows = returns_by_piece(df, eps, first, clip, every)
        aggs = [window_rv("log_return", lo, hi).alias(name) for name, lo, hi in windows]
    else:
        before = "last_second" if "last_second" in df.columns else "seconds_in_bucket"
        rows = returns_by_piece(df.selectExpr("*", f"lag({before}) OVER ({BY_SECOND}) AS _prev"), eps, 0.0, None, every)
        # A row inside the window counts toward presence even when its return does not.
        aggs = []
        for name, lo, hi in windows:
            r = f"CASE WHEN {'TRUE' if lo is None else f'_prev >= {lo}'} THEN log_return ELSE 0D END"
            aggs.append(F.expr(f"sqrt(sum(CASE WHEN {window_text(lo, hi)} THEN pow({r}, 2D) END))").alias(name))
    out = rows.groupBy(*SNAPSHOT).agg(*aggs)
    for name, _, _ in windows:
        c = F.col(name)
        if missing is not None:
            c = F.coalesce(c, F.lit(float(missing)))
        if floor is not None:
            c = F.greatest(c, F.lit(floor))
        out = out.withColumn(name, c)
    return out


def bucket_rv(book_sec: DataFrame, narrow: bool = False) -> DataFrame:
    """Four 120-second RVs of the input window and the target RV, one row per snapshot."""
    out = realised_vol(book_sec, BUCKETS_120, eps=FEATURE_EPS, first=0.0)
    if narrow:
        out = out.select(*SNAPSHOT, *[F.col(n).cast("float").alias(n) for n, _, _ in BUCKETS_120])
    return out


def target_rv_panel(book_sec: DataFrame) -> DataFrame:
    """Exploratory target RV: returns inside [480, 600) only, log left NULL where RV is 0."""
    rv = realised_vol(book_sec, [("rv", INPUT_END, TARGET_END)], edge="exclude")
    return rv.where(F.col("rv").isNotNull()).withColumn(
        "log_rv", F.when(F.col("rv") > 0, F.log("rv"))
    )


BUCKET_FEATURES = ["log_ret_sum", "rv", "wap_mean", "spread_mean", "volume_sum", "pspread_mean", "dimbal_mean"]


def _with_defaults(book_sec: DataFrame) -> DataFrame:
    """Liquidity columns a source may lack count as zero."""
    for c in ("bid_ask_spread", "total_volume", "price_spread", "depth_imbalance"):
        if c not in book_sec.columns:
            book_sec = book_sec.withColumn(c, F.lit(0.0))
    return book_sec


def _bucket_aggs() -> list:
    return [
        F.sum("log_return").alias("log_ret_sum"),
        F.sqrt(F.sum(F.col("log_return") * F.col("log_return"))).alias("rv"),
        F.expr(mean_of_seconds("wap")).alias("wap_mean"),
        F.expr(mean_of_seconds("bid_ask_spread")).alias("spread_mean"),
        F.expr("sum(total_volume * seconds)").alias("volume_sum"),
        F.expr(mean_of_seconds("price_spread")).alias("pspread_mean"),
        F.expr(mean_of_seconds("depth_imbalance")).alias("dimbal_mean"),
    ]


def bucket_features(book_sec: DataFrame, width: int = 60, n_buckets: int = 8) -> DataFrame:
    """Seven features per 60-second bucket of the input window (long form)."""
    rows = returns_by_piece(_with_defaults(book_sec), BUCKET_EPS, first=0.0, every=math.gcd(width, INPUT_END)).where(
        F.col("seconds_in_bucket") < INPUT_END)
    return (
        rows.withColumn("bucket", vc.second_bucket(width, n_buckets))
        .groupBy(*SNAPSHOT, "bucket")
        .agg(*_bucket_aggs())
    )


def log_target_rv(book_sec: DataFrame) -> DataFrame:
    """log of the floored target RV (no upper bound on the second)."""
    return (
        realised_vol(book_sec, [("rv", INPUT_END, None)], eps=BUCKET_EPS, first=0.0)
        .where(F.col("rv").isNotNull())
        .select(*SNAPSHOT, F.log(F.greatest("rv", F.lit(RV_FLOOR))).alias("y"))
    )


def bucket_tensor(book_sec: DataFrame, n_buckets: int = 8) -> DataFrame:
    """(time_id, stock_id, x[8][7], y): the dense input block of one stock at one snapshot.

    One pass over the seconds or runs gives both the buckets and the target: the target window
    is bucket -1 of the same grouping.  At most nine rows meet in the final step.
    """
    rows = returns_by_piece(_with_defaults(book_sec), BUCKET_EPS, first=0.0, every=60)
    bucket = F.when(F.col("seconds_in_bucket") < INPUT_END, vc.second_bucket(60, n_buckets)).otherwise(-1)
    per_bucket = rows.withColumn("bucket", bucket).groupBy(*SNAPSHOT, "bucket").agg(*_bucket_aggs())
    cell = F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in BUCKET_FEATURES])
    zero = F.array(*[F.lit(0.0).cast("float") for _ in BUCKET_FEATURES])
    cells = [F.coalesce(F.max(F.when(F.col("bucket") == b, cell)), zero) for b in range(n_buckets)]
    target = F.max(F.when(F.col("bucket") == -1, F.col("rv")))
    return per_bucket.groupBy(*SNAPSHOT).agg(
        F.array(*cells).alias("x"),
        F.coalesce(F.log(vc.at_least(target, RV_FLOOR)), F.lit(0.0)).cast("float").alias("y"),
    )


def dense_tensor(tensor: DataFrame) -> DataFrame:
    """Every (snapshot, stock) cell, absent cells as zeros.  Only for consumers that need it dense.

    The stock list (one row per stock) rides along as an array and is exploded per snapshot.
    """
    stocks = tensor.groupBy(F.lit(0).alias("_k")).agg(F.collect_set("stock_id").alias("_stocks"))
    grid = (
        tensor.select("time_id").distinct().withColumn("_k", F.lit(0)).join(F.broadcast(stocks), "_k")
        .select("time_id", F.explode("_stocks").alias("stock_id"))
    )
    zero_x = F.expr("array_repeat(array_repeat(CAST(0 AS FLOAT), 7), 8)")
    return grid.join(tensor, ["time_id", "stock_id"], "left").select(
        "time_id", "stock_id", F.coalesce("x", zero_x).alias("x"),
        F.coalesce("y", F.lit(0.0).cast("float")).alias("y"),
    )


def sampling_weights(log_target: DataFrame) -> DataFrame:
    """Inverse mean-RV weight per snapshot, capped at its 99th percentile, summing to one."""
    live = F.when(F.col("y") > LIVE_TARGET_LOG_RV, F.exp("y"))
    raw = log_target.groupBy("time_id").agg(
        F.when(F.count(live) == 0, 1.0)
        .otherwise(F.try_divide(F.lit(1.0), F.greatest(F.avg(live), F.lit(BUCKET_EPS)))).alias("w")
    ).withColumn("_k", F.lit(0))
    cap = exact_quantiles(raw, ["_k"], "w", {"cap": 0.99})
    capped = raw.join(F.broadcast(cap), "_k").select("_k", "time_id", F.least("w", "cap").alias("w"))
    total = capped.groupBy("_k").agg(F.sum("w").alias("total"))
    return capped.join(F.broadcast(total), "_k").select("time_id", (F.col("w") / F.col("total")).alias("weight"))
