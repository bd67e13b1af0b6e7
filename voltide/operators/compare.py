"""Model comparison: alignment, pooled metrics, Diebold-Mariano tests, corrections, intervals.

Predictions are one long table: model, stock_id, time_id, fold, actual_rv, predicted_rv.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltide.functions.columns import stars
from voltide.functions.distributions import t_quantile_text, two_sided_normal_text
from voltide.functions.losses import LOSSES, qlike, rmspe
from voltide.plans.ordered import with_global_index

KEY = ["stock_id", "time_id", "fold"]
VARIANCE_FLOOR = 1e-10
BLOCK_ROWS = 65536


def stack_models(frames: dict[str, DataFrame]) -> DataFrame:
    """Per-model prediction tables as one long table."""
    parts = [df.select(F.lit(name).alias("model"), *KEY, "actual_rv", "predicted_rv") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def align(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows every model has: keys, the first model's actual, one prediction column per model.

    One grouping replaces the chain of inner joins; each prediction crosses the shuffle once.
    """
    def of(m: str, c: str):
        return F.max(F.when(F.col("model") == m, F.col(c)))

    wide = predictions.groupBy(*KEY).agg(
        of(models[0], "actual_rv").alias("actual_rv"), *[of(m, "predicted_rv").alias(f"pred_{m}") for m in models]
    )
    return wide.na.drop(subset=[f"pred_{m}" for m in models])


def long_predictions(aligned: DataFrame, models: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("p")) for m in models]))
    return aligned.select(*keys, "actual_rv", pairs.alias("_m")).select(
        *keys, "actual_rv", F.col("_m.model").alias("model"), F.col("_m.p").alias("predicted_rv"))


def actual_consistency(predictions: DataFrame, models: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Largest difference between the first model's actual RV and each other model's."""
    def actual(m: str):
        return F.max(F.when(F.col("model") == m, F.col("actual_rv")))

    wide = predictions.groupBy(*KEY).agg(*[actual(m).alias(f"a_{i}") for i, m in enumerate(models)])
    wide = wide.na.drop(subset=[f"a_{i}" for i in range(len(models))])
    diffs = wide.agg(*[F.max(F.abs(F.col("a_0") - F.col(f"a_{i}"))).alias(f"d_{i}") for i in range(1, len(models))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"d_{i}").alias("max_diff"))
                               for i, m in enumerate(models) if i]))
    return diffs.select(rows.alias("r")).select("r.*", (F.col("r.max_diff") < tolerance).alias("consistent"))


def row_count_report(predictions: DataFrame, base_model: str) -> DataFrame:
    """Rows per model and fold, with totals, and the difference from the base model's count."""
    counts = predictions.groupingSets([["model", "fold"], ["model"]], "model", "fold").agg(
        F.grouping("fold").alias("_total"), F.count(F.lit(1)).alias("n_rows"),
    ).select("model", F.when(F.col("_total") == 1, "all").otherwise(F.col("fold").cast("string")).alias("fold"), "n_rows")
    base = counts.where(F.col("model") == base_model).select("fold", F.col("n_rows").alias("_base"))
    return counts.join(F.broadcast(base), "fold", "left").select(
        "model", "fold", "n_rows", (F.col("n_rows") - F.coalesce("_base", F.lit(0))).alias("vs_base"))


def pooled_metrics(long: DataFrame) -> DataFrame:
    """RMSPE and QLIKE of every model, pooled ('all') and per fold."""
    return long.groupingSets([["model", "fold"], ["model"]], "model", "fold").agg(
        F.grouping("fold").alias("_g"), F.count(F.lit(1)).alias("n_rows"),
        rmspe("actual_rv", "predicted_rv").alias("rmspe"), qlike("actual_rv", "predicted_rv").alias("qlike"),
    ).select("model", F.when(F.col("_g") == 1, "all").otherwise(F.col("fold").cast("string")).alias("fold"),
             "n_rows", "rmspe", "qlike")


def confidence_intervals(fold_metrics: DataFrame, confidence: float = 0.95) -> DataFrame:
    """t-interval of the fold means for each model and metric (input: ``pooled_metrics``)."""
    long = fold_metrics.where("fold <> 'all'").select("model", F.explode(F.array(
        F.struct(F.lit("RMSPE").alias("metric"), F.col("rmspe").alias("v")),
        F.struct(F.lit("QLIKE").alias("metric"), F.col("qlike").alias("v")))).alias("m")).select("model", "m.*")
    stats = long.groupBy("model", "metric").agg(
        F.count("v").alias("n_folds"), F.avg("v").alias("mean"),
        F.try_divide(F.stddev_samp("v"), F.sqrt(F.count("v"))).alias("se"))
    t = F.expr(t_quantile_text(f"{(1 + confidence) / 2!r}D", "(n_folds - 1D)"))
    return stats.select("model", "metric", "n_folds", "mean", (F.col("mean") - t * F.col("se")).alias("ci_low"),
                        (F.col("mean") + t * F.col("se")).alias("ci_high"))


# ---- Diebold-Mariano ----------------------------------------------------------

def _lag_products(n: int, h: int, block_rows: int, width: int):
    """Per block: sums of d[i]*d[i+k], and the sums of the first and last k values, k = 1..h."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        idx = pdf["idx"].to_numpy()
        d = np.stack(pdf["d"].to_numpy())
        own = int((idx // block_rows == pdf["block"].iloc[0]).sum())
        lags, series, products, heads, tails = [], [], [], [], []
        for k in range(1, h + 1):
            reach = min(own, len(idx) - k)
            prod = (d[:reach] * d[k : k + reach]).sum(axis=0) if reach > 0 else np.zeros(width)
            lags += [k] * width
            series += range(width)
            products.append(prod)
            heads.append(d[:own][idx[:own] < k].sum(axis=0))
            tails.append(d[:own][idx[:own] >= n - k].sum(axis=0))
        return pd.DataFrame({"series": series, "lag": lags, "product": np.concatenate(products),
                             "head": np.concatenate(heads), "tail": np.concatenate(tails)})
    return run


def autocovariances(indexed: DataFrame, cols: Sequence[str], n: int, h: int, means: Sequence[float],
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sample covariance of each series with itself ``lag`` steps later, lag = 1..h.

    The series is cut into runs of ``block_rows`` rows plus the ``h`` rows that follow, so a lag
    never needs a join: the shuffle carries n rows and a thin overlap instead of n*h rows.
    """
    block_rows = max(block_rows, h)
    block = F.floor(F.col("idx") / block_rows)
    overlap = (F.col("idx") % block_rows < h) & (block > 0)
    rows = indexed.select(
        "idx", F.array(*[F.col(c) - F.lit(float(m)) for c, m in zip(cols, means)]).alias("d"),
        F.explode(F.when(overlap, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"),
    )
    partial = rows.groupBy("block").applyInPandas(
        _lag_products(n, h, block_rows, len(cols)), "series int, lag int, product double, head double, tail double")
    sums = partial.groupBy("series", "lag").agg(*[F.sum(c).alias(c) for c in ("product", "head", "tail")])
    left = F.lit(n) - F.col("lag")
    cov = F.try_divide(F.col("product") - F.col("head") * F.col("tail") / left, left - 1)
    return sums.select("series", "lag", cov.alias("autocov"))


def diebold_mariano(aligned: DataFrame, models: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All model pairs under both losses; a positive statistic means the second model is better.

    Newey-West variance with Bartlett weights and int(n^(1/3)) lags over rows ordered by
    (fold, stock_id, time_id).
    """
    tests = [(metric, a, b) for metric in LOSSES for a, b in combinations(models, 2)]
    cols = [f"d_{i}" for i in range(len(tests))]
    diffs = aligned.select(*KEY, *[
        F.expr(f"{LOSSES[metric]('actual_rv', f'pred_{a}', 1e-10)} - {LOSSES[metric]('actual_rv', f'pred_{b}', 1e-10)}").alias(c)
        for (metric, a, b), c in zip(tests, cols)])
    indexed = with_global_index(diffs, ["fold", "stock_id", "time_id"])
    base = indexed.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                       *[F.var_samp(c).alias(f"v_{c}") for c in cols]).first()
    n = base["n"]
    h = int(n ** (1 / 3))
    means = [base[f"m_{c}"] for c in cols]
    cov = autocovariances(indexed, cols, n, h, means, block_rows)
    weighted = cov.groupBy("series").agg(
        F.sum((1 - F.col("lag") / F.lit(h + 1.0)) * F.col("autocov")).alias("weighted"))
    facts = [(i, *t, float(means[i]), float(base[f"v_{cols[i]}"])) for i, t in enumerate(tests)]
    labels = aligned.sparkSession.createDataFrame(
        facts, "series int, metric string, model_1 string, model_2 string, mean double, gamma0 double")
    variance = (F.col("gamma0") + 2 * F.coalesce(F.col("weighted"), F.lit(0.0))) / F.lit(float(n))
    stat = F.col("mean") / F.sqrt(F.greatest(variance, F.lit(VARIANCE_FLOOR)))
    scored = labels.join(weighted, "series", "left").select("metric", "model_1", "model_2", stat.alias("dm_stat"))
    scored = scored.withColumn("p_value", F.expr(two_sided_normal_text("dm_stat")))
    return scored.withColumn("sig", stars("p_value"))


def benjamini_hochberg(tests: DataFrame, family: str = "metric", p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Step-up correction within each family of tests (a handful of rows each)."""
    fam = W.partitionBy(family)
    ranked = tests.withColumn("_r", F.row_number().over(fam.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(fam))
    above = fam.orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
    corrected = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(above))
    return ranked.withColumn("p_value_corrected", corrected).drop("_r", "_m").withColumns({
        "rejected_corrected": F.col("p_value_corrected") <= alpha,
        "sig_corrected": stars("p_value_corrected"),
    })


def pair_winner(tests: DataFrame) -> DataFrame:
    """Better model of each pair by the sign of the statistic; significance is a column of its own."""
    better = F.when(F.col("dm_stat") > 0, F.col("model_2")).otherwise(F.col("model_1"))
    return tests.withColumn("winner", better)


def lookup_pair(tests: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """The test row of an unordered model pair."""
    lo, hi = sorted((a, b))
    return tests.where((F.col("metric") == metric) & (F.least("model_1", "model_2") == lo)
                       & (F.greatest("model_1", "model_2") == hi))
