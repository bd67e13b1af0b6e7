"""HAR regressions: pooled per fold, K-fold by row or stock, and per stock with out-of-fold fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.constants import FEATURE_EPS, INPUT_END, RV_FLOOR, TARGET_END
from voltide.functions.losses import volatility_metrics
from voltide.operators import har, ols
from voltide.operators.book import SNAPSHOT
from voltide.operators.folds import holdout_split, kfold_parts, with_folds
from voltide.operators.rv import realised_vol

MIN_TRAIN_ROWS = 10
STOCK_HAR_X = ["log_rv_in", "log_rv_last_window"]


def _with_forecasts(scored: DataFrame, log_pred: str, floor: float) -> DataFrame:
    return scored.selectExpr(
        "*", f"{har.inverse_log_rv(log_pred, floor)} AS predicted_rv_480_600",
        f"{har.naive_last_two_minutes(floor)} AS naive_rv_360_480",
    ).drop(log_pred)


def fold_forecasts(model_rows: DataFrame, assignment: DataFrame, xs: Sequence[str] = har.FULL_FEATURES,
                   floor: float = RV_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Pooled fit on each fold's training rows; forecasts for both sides.  Returns (rows, coefficients)."""
    rows = with_folds(model_rows, assignment)
    coefs = ols.fit(rows.where("split = 'train'"), ["fold"], xs, har.LOG_TARGET)
    scored = ols.predict(rows, coefs, ["fold"], xs, "_log_pred", small=True)
    return _with_forecasts(scored, "_log_pred", floor), coefs


def holdout_forecasts(model_rows: DataFrame, xs: Sequence[str] = har.FULL_FEATURES, test_ratio: float = 0.2,
                      floor: float = RV_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Random row split, one pooled fit."""
    rows = holdout_split(model_rows, test_ratio).withColumn("_k", F.lit(0))
    coefs = ols.fit(rows.where("split = 'train'"), ["_k"], xs, har.LOG_TARGET)
    scored = ols.predict(rows, coefs, ["_k"], xs, "_log_pred", small=True)
    return _with_forecasts(scored.drop("_k"), "_log_pred", floor), coefs.drop("_k")


def split_metrics(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """RMSPE, QLIKE and MSE of the model and of the naive forecast for each split."""
    return har.fold_metrics(har.long_scores(forecasts, keys), [*keys, "model"])


def cross_validate(model_rows: DataFrame, n_splits: int = 5, by_stock: bool = False,
                   xs: Sequence[str] = har.FULL_FEATURES, floor: float = RV_FLOOR) -> DataFrame:
    """K-fold metrics; each part is scored by the fit on all others (sums minus the part's sums)."""
    p = len(xs)
    rows = kfold_parts(model_rows, n_splits, by_stock).withColumn("_k", F.lit(0))
    parts = ols.cross_sums(rows, ["_k", "part"], xs, har.LOG_TARGET)
    coefs = ols.solve(ols.leave_part_out(parts, ["_k"], "part", p), ["_k", "part"], p)
    scored = ols.predict(rows, coefs, ["_k", "part"], xs, "_log_pred", small=True)
    return scored.groupBy((F.col("part") + 1).alias("fold")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *volatility_metrics(har.TARGET, har.inverse_log_rv("_log_pred", floor)),
    )


def stock_har_windows(book_sec: DataFrame) -> DataFrame:
    """Floored RVs of the per-stock regression; returns are taken inside each window only."""
    rv = realised_vol(book_sec, [("rv_in", 0, INPUT_END), ("rv_last_window", 360, INPUT_END),
                                 ("rv_fut", INPUT_END, TARGET_END)],
                      edge="exclude", eps=FEATURE_EPS, floor=RV_FLOOR, missing=RV_FLOOR)
    return rv.select(*SNAPSHOT, *[F.log(c).alias(f"log_{c}") for c in ("rv_in", "rv_last_window", "rv_fut")])


def stock_har_oof(windows: DataFrame, assignment: DataFrame, min_train: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Out-of-fold HAR forecasts on training rows and full-fit forecasts on test rows, per stock.

    All stocks, folds and inner parts are fitted by one aggregate.  The published third
    regressor is the difference of the other two, so it is left out: same fitted values.
    Stocks with fewer than ``min_train`` training rows or no test row in a fold are dropped.
    """
    p = len(STOCK_HAR_X)
    rows = with_folds(windows, assignment)
    parts = ols.cross_sums(rows, ["fold", "stock_id", "inner"], STOCK_HAR_X, "log_rv_fut")
    train = parts.where("inner >= 0")
    sizes = parts.groupBy("fold", "stock_id").agg(
        F.sum(F.when(F.col("inner") >= 0, F.col("n"))).alias("_train"),
        F.sum(F.when(F.col("inner") < 0, F.col("n"))).alias("_test"),
    ).where((F.col("_train") >= min_train) & (F.col("_test") > 0)).select("fold", "stock_id")
    full = ols.add_up(train, ["fold", "stock_id"], p).withColumn("inner", F.lit(-1))
    keys = ["fold", "stock_id", "inner"]
    all_sums = ols.leave_part_out(train, ["fold", "stock_id"], "inner", p).unionByName(full)
    coefs = ols.solve(all_sums.join(sizes, ["fold", "stock_id"], "left_semi"), keys, p)
    scored = ols.predict(rows, coefs, keys, STOCK_HAR_X, "har_pred_log_rv")
    return scored.select(
        "time_id", "stock_id", "fold", "split", "log_rv_fut", "har_pred_log_rv",
        F.exp("har_pred_log_rv").alias("har_pred_rv"),
        (F.col("log_rv_fut") - F.col("har_pred_log_rv")).alias("har_residual"),
    )


def baseline_rv(rv_in, n_in, n_out):
    """Input RV scaled by the square root of the horizon ratio."""
    return F.when(n_in == 0, F.lit(1e-12)).otherwise(rv_in * F.sqrt(F.try_divide(n_out.cast("double"), n_in.cast("double"))))
