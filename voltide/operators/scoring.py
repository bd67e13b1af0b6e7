"""Forecast reports: tiers, dispersion, per-stock tables, combined loss, blends and spread weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltide.constants import LIVE_TARGET_LOG_RV
from voltide.functions import columns as vc
from voltide.functions.losses import log_metrics, qlike_loss, squared_pct_loss
from voltide.operators import ols

EPS = 1e-8


def tier_report(pred: DataFrame, min_rows: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Seven metrics per RV tier, tiers with at least ``min_rows`` rows."""
    return (
        pred.groupBy(*keys, vc.tier_label(F.exp("true_log_rv")).alias("tier"))
        .agg(F.count(F.lit(1)).alias("n_rows"), *log_metrics("pred_log_rv", "true_log_rv", EPS))
        .where(F.col("n_rows") >= min_rows)
    )


def dispersion(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of predicted against true log RV."""
    return pred.groupBy(*keys).agg(
        F.stddev_pop("pred_log_rv").alias("pred_std"), F.stddev_pop("true_log_rv").alias("true_std"),
    ).withColumn("spread_ratio", F.try_divide("pred_std", "true_std"))


def stock_extremes(per_stock: DataFrame, k: int = 5, metric: str = "rmspe_pct", keys: Sequence[str] = ()) -> DataFrame:
    """Best and worst ``k`` stocks by a metric, of each group of ``keys``.

    Without keys, two small top-k sorts; with keys, a group's window holds one row per stock of the universe.
    """
    def side(name: str, order: Column) -> DataFrame:
        if not keys:
            return per_stock.orderBy(order, "stock_id").limit(k).withColumn("side", F.lit(name))
        place = F.row_number().over(W.partitionBy(*keys).orderBy(order, "stock_id"))
        return per_stock.withColumn("_place", place).where(F.col("_place") <= k).drop("_place").withColumn("side", F.lit(name))

    return side("best", F.col(metric).asc()).unionByName(side("worst", F.col(metric).desc()))


def fold_aggregate(fold_metrics: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and std (ddof 0) over folds, long form."""
    agg = fold_metrics.agg(*[F.avg(m).alias(f"m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"s_{m}") for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("mean"),
                                        F.col(f"s_{m}").alias("std")) for m in metrics]))
    return agg.select(rows.alias("r")).select("r.*")


def stock_bias(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-stock fixed effect: mean log error of the training rows (of each group of ``keys``)."""
    return pred.groupBy(*keys, "stock_id").agg(F.avg(F.col("true_log_rv") - F.col("pred_log_rv")).alias("stock_bias"))


def apply_stock_bias(pred: DataFrame, bias: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    joined = pred.join(bias, [*keys, "stock_id"], "left")
    return joined.withColumn("pred_log_rv", F.col("pred_log_rv") + F.coalesce("stock_bias", F.lit(0.0)))


def bias_summary(bias: DataFrame) -> DataFrame:
    return bias.agg(F.avg("stock_bias").alias("mean"), F.stddev_pop("stock_bias").alias("std"),
                    F.min("stock_bias").alias("min"), F.max("stock_bias").alias("max"))


def bias_extremes(bias: DataFrame, k: int = 3) -> DataFrame:
    top = bias.orderBy(F.col("stock_bias").desc(), "stock_id").limit(k).withColumn("side", F.lit("largest"))
    low = bias.orderBy(F.col("stock_bias").asc(), "stock_id").limit(k).withColumn("side", F.lit("smallest"))
    return top.unionByName(low)


def spread_weights(pred: DataFrame) -> DataFrame:
    """Per-stock weight clip(2 - std_pred/std_true, 0.25, 4), scaled to mean 1; small or flat stocks start at 1."""
    live = (F.col("true_log_rv") != 0.0) & (F.col("true_log_rv") > LIVE_TARGET_LOG_RV)
    t, p = F.when(live, F.col("true_log_rv")), F.when(live, F.col("pred_log_rv"))
    per = pred.groupBy("stock_id").agg(F.count(t).alias("n"), F.stddev_pop(p).alias("ps"), F.stddev_pop(t).alias("ts"))
    raw = per.select("stock_id", F.lit(0).alias("_k"), F.when(
        (F.col("n") >= 3) & (F.col("ts") >= 1e-6), vc.clip(2.0 - F.try_divide("ps", "ts"), 0.25, 4.0)
    ).otherwise(1.0).alias("w"))
    mean = raw.groupBy("_k").agg(F.avg("w").alias("_mean"))
    return raw.join(F.broadcast(mean), "_k").select("stock_id", (F.col("w") / F.col("_mean")).alias("spread_weight"))


def combined_loss(pred: DataFrame, weights: DataFrame, rmspe_w: float = 0.3, qlike_w: float = 0.5,
                  spread_w: float = 0.2) -> DataFrame:
    """Evaluation loss: RMSPE, QLIKE and the mean per-stock under-dispersion penalty."""
    live = pred.where((F.col("true_log_rv") != 0.0) & (F.col("true_log_rv") > LIVE_TARGET_LOG_RV))
    p_log = vc.clip("pred_log_rv", -20.0, 5.0)
    p_rv, t_rv = f"exp({vc.clip_text('pred_log_rv', -20.0, 5.0)})", "exp(true_log_rv)"
    per = live.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(squared_pct_loss(t_rv, p_rv, EPS)).alias("sq"),
        F.sum(qlike_loss(t_rv, p_rv, EPS)).alias("ql"), F.stddev_samp(p_log).alias("ps"), F.stddev_samp("true_log_rv").alias("ts"),
    ).join(weights, "stock_id", "left")
    gap = F.greatest(F.col("ts") - F.col("ps"), F.lit(0.0))
    penalty = F.when(F.col("n") >= 3, F.coalesce("spread_weight", F.lit(1.0)) * gap * gap)
    return per.agg(
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rmspe"), (F.sum("ql") / F.sum("n")).alias("qlike"),
        F.coalesce(F.avg(penalty), F.lit(0.0)).alias("spread"),
    ).withColumn("loss", rmspe_w * F.col("rmspe") + qlike_w * F.col("qlike") + spread_w * F.col("spread"))


def bucket_har_forecast(tensor: DataFrame, split: str = "split", floor: float = 1e-4, keys: Sequence[str] = ()) -> DataFrame:
    """Linear forecast of log target RV from the eight log bucket RVs; fitted on training rows (of each group of ``keys``)."""
    xs = [f"lb_{b}" for b in range(8)]
    by = list(keys) or ["_k"]
    rows = tensor.select(
        "stock_id", "time_id", split, F.col("y").cast("double").alias("true_log_rv"), *(keys or [F.lit(0).alias("_k")]),
        *[F.log(F.greatest(F.col("x")[b][1].cast("double"), F.lit(floor))).alias(xs[b]) for b in range(8)])
    coefs = ols.fit(rows.where(F.col(split) == "train"), by, xs, "true_log_rv")
    return ols.predict(rows, coefs, by, xs, "pred_log_rv", small=True).select(
        *keys, "stock_id", "time_id", split, "true_log_rv", "pred_log_rv")


def blend_weight_grid(rows: DataFrame, a: str, b: str, true_log: str = "true_log_rv", steps: int = 100,
                      keys: Sequence[str] = ()) -> DataFrame:
    """QLIKE of w*a + (1-w)*b on a grid of weights, in one pass over the data (for each group of ``keys``).

    Each row is multiplied by the grid map-side and collapses there to one row per weight.
    """
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")
    w = f"step / {float(steps)}D"
    mixed = vc.clip_text(f"{w} * {a} + (1 - {w}) * {b}", -20.0, 5.0)
    return rows.select(*keys, a, b, true_log, grid).groupBy(*keys, "step").agg(
        F.avg(qlike_loss(f"exp({true_log})", f"exp({mixed})", EPS)).alias("qlike")
    ).select(*keys, (F.col("step") / F.lit(float(steps))).alias("weight"), "qlike")


def best_blend(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return grid.groupBy(*keys).agg(F.min_by("weight", F.struct("qlike", "weight")).alias("weight"), F.min("qlike").alias("qlike"))


def least_squares_blend(rows: DataFrame, a: str, b: str, true_log: str = "true_log_rv", keys: Sequence[str] = ()) -> DataFrame:
    """Closed-form weight in [0, 1] minimising squared log error (for each group of ``keys``)."""
    d = F.col(a) - F.col(b)
    return rows.groupBy(*keys).agg(F.sum((F.col(true_log) - F.col(b)) * d).alias("_num"), F.sum(d * d).alias("_den")).select(
        *keys, vc.clip(F.coalesce(F.try_divide("_num", "_den"), F.lit(0.5)), 0.0, 1.0).alias("weight"))
