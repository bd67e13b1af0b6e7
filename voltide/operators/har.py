"""Heterogeneous-autoregressive feature table and model columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.constants import INPUT_END, PRICE_EPS, RV_FLOOR
from voltide.functions import columns as vc
from voltide.functions.aggregates import mean_of_seconds, window_rv, window_text
from voltide.functions.losses import volatility_metrics
from voltide.operators.book import SNAPSHOT, normalise_preprocessed, returns_by_piece, with_book_columns

RV_FEATURES = ["rv_360_480", "rv_240_480", "rv_0_480"]
TARGET = "target_rv_480_600"
LIQUIDITY = ["spread_mean_0_480", "spread_max_0_480", "volume_sum_0_480", "volume_imbalance_mean_0_480"]
PURE_FEATURES = [f"log_{c}" for c in RV_FEATURES]
FULL_FEATURES = [*PURE_FEATURES, "log_spread_mean_0_480", "log_spread_max_0_480", "log_volume_sum_0_480",
                 "volume_imbalance_mean_0_480"]
LOG_TARGET = f"log_{TARGET}"


def _feature_table(rows: DataFrame) -> DataFrame:
    """Four RV windows and four liquidity columns in one conditional aggregate (no joins)."""
    input_window = window_text(None, INPUT_END)

    def early(agg: str, c: str):
        return F.expr(f"{agg}(CASE WHEN {input_window} THEN {c} END)")

    wide = rows.groupBy(*SNAPSHOT).agg(
        window_rv("log_return", 360, 480).alias("rv_360_480"),
        window_rv("log_return", 240, 480).alias("rv_240_480"),
        window_rv("log_return", 0, 480).alias("rv_0_480"),
        window_rv("log_return", 480, 600).alias(TARGET),
        F.expr(mean_of_seconds("bid_ask_spread", input_window)).alias("spread_mean_0_480"),
        early("max", "bid_ask_spread").alias("spread_max_0_480"),
        early("sum", "total_volume * seconds").alias("volume_sum_0_480"),
        F.expr(mean_of_seconds("volume_imbalance", input_window)).alias("volume_imbalance_mean_0_480"),
    )
    cols = [*RV_FEATURES, TARGET, *LIQUIDITY]
    zeroed = wide.selectExpr(*SNAPSHOT, *[f"coalesce({c}, 0D) AS {c}" for c in cols])
    return zeroed.select(*SNAPSHOT, *[vc.finite(c).alias(c) for c in cols]).na.drop(subset=cols)


def features_from_raw(raw: DataFrame) -> DataFrame:
    """From raw quotes: better-of-two-levels price, sparse seconds."""
    return _feature_table(returns_by_piece(with_book_columns(raw, "best"), eps=None))


def features_from_preprocessed(book_sec: DataFrame) -> DataFrame:
    """From the dense book of the shared folds, by the second or as runs."""
    return _feature_table(returns_by_piece(normalise_preprocessed(book_sec), PRICE_EPS, every=120))


def add_model_columns(features: DataFrame) -> DataFrame:
    """Log columns for the regression; rows with a missing or infinite value are dropped."""
    logged = [*RV_FEATURES, TARGET, "spread_mean_0_480", "spread_max_0_480"]
    out = features.select(
        "*",
        *[vc.floored_log(c, PRICE_EPS).alias(f"log_{c}") for c in logged],
        F.log1p(vc.at_least("volume_sum_0_480", 0.0)).alias("log_volume_sum_0_480"),
    )
    return out.na.drop()


def drop_small_targets(model_rows: DataFrame, min_target: float = RV_FLOOR) -> DataFrame:
    return model_rows.where(F.col(TARGET) > min_target)


def target_filter_report(model_rows: DataFrame, min_target: float = RV_FLOOR, keys: Sequence[str] = ()) -> DataFrame:
    """Rows kept and dropped by the target filter, of each group of ``keys``, from one pass."""
    keep = F.col(TARGET) > min_target
    return model_rows.groupBy(*keys).agg(
        F.count(F.when(keep, 1)).alias("kept_rows"),
        F.count(F.when(~keep, 1)).alias("dropped_rows"),
    )


def model_rows(features: DataFrame, min_target: float = RV_FLOOR) -> DataFrame:
    return drop_small_targets(add_model_columns(features), min_target)


def require_rows(df: DataFrame, least: int = 2) -> DataFrame:
    """Fail early when a table has fewer than ``least`` rows (reads at most that many)."""
    if len(df.select(F.lit(1)).head(least)) < least:
        raise ValueError(f"need at least {least} rows with target RV above the minimum")
    return df


def inverse_log_rv(log_rv: str, floor: float = RV_FLOOR) -> str:
    """SQL text: forecast RV from a forecast log RV, floored."""
    return vc.floor_text(f"exp({log_rv}) - {PRICE_EPS}D", floor)


def naive_last_two_minutes(floor: float = RV_FLOOR) -> str:
    """SQL text: the last two input minutes' RV as the forecast."""
    return vc.floor_text("rv_360_480", floor)


def with_error_columns(pred: DataFrame) -> DataFrame:
    """Absolute and percentage errors of the model and of the naive forecast."""
    floor = vc.at_least(TARGET, PRICE_EPS)
    err = F.abs(F.col(TARGET) - F.col("predicted_rv_480_600"))
    naive_err = F.abs(F.col(TARGET) - F.col("naive_rv_360_480"))
    return pred.select(
        "*",
        err.alias("absolute_error"), (err / floor).alias("percentage_error"),
        naive_err.alias("naive_absolute_error"), (naive_err / floor).alias("naive_percentage_error"),
    )


def long_scores(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Both forecasts of every row in long form: keys, model, actual, predicted."""
    models = F.explode(F.array(
        F.struct(F.lit("HAR").alias("model"), F.col("predicted_rv_480_600").alias("p")),
        F.struct(F.lit("naive_last_2min").alias("model"), F.col("naive_rv_360_480").alias("p")),
    )).alias("_m")
    return pred.select(*keys, F.col(TARGET).alias("actual_rv"), models).select(
        *keys, F.col("_m.model").alias("model"), "actual_rv", F.col("_m.p").alias("predicted_rv"),
    )


def fold_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *volatility_metrics("actual_rv", "predicted_rv"))


def fold_summary(scored: DataFrame) -> DataFrame:
    """Per-fold rows plus the pooled row, fold mean and fold std (ddof 0) for every model.

    Pooled and per-fold metrics come from one GROUPING SETS aggregate; mean and std are then
    taken over the few fold rows.
    """
    by_fold = scored.groupingSets([["model", "fold"], ["model"]], "model", "fold").agg(
        F.grouping("fold").alias("_pooled"), F.count(F.lit(1)).cast("double").alias("n_rows"),
        *volatility_metrics("actual_rv", "predicted_rv"),
    )
    metrics = ["n_rows", "rmspe", "qlike", "mse"]
    labelled = by_fold.select(
        "model", "_pooled",
        F.when(F.col("_pooled") == 1, "all").otherwise(F.col("fold").cast("string")).alias("fold_id"),
        F.when(F.col("_pooled") == 1, "test_pooled").otherwise("test").alias("split"), *metrics,
    )
    stats = labelled.where("_pooled = 0").groupBy("model").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics],
    )
    extra = stats.select("model", F.explode(F.array(
        F.struct(F.lit("mean").alias("fold_id"), F.lit("test_fold_mean").alias("split"),
                 *[F.col(f"mean_{m}").alias(m) for m in metrics]),
        F.struct(F.lit("std").alias("fold_id"), F.lit("test_fold_std").alias("split"),
                 *[F.col(f"std_{m}").alias(m) for m in metrics]),
    )).alias("r")).select("model", "r.*")
    return labelled.drop("_pooled").unionByName(extra)
