"""Dashboard master table and the queries behind each view, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltide.constants import REGIMES
from voltide.functions import columns as vc
from voltide.functions.aggregates import corr0, count_where
from voltide.functions.losses import dashboard_metrics, qlike, qlike_loss
from voltide.operators.eda import missing_report, range_histogram
from voltide.plans.ordered import exact_quantiles, lag_by_index, with_global_index

EPS = 1e-8
BUCKETS = ["rv_b0", "rv_b1", "rv_b2", "rv_b3"]
LOWER_BETTER, NEAR_ZERO_BETTER = ("qlike", "rmspe"), ("bias",)
HEAT_COLUMNS = 14


def build_master(buckets: DataFrame, models: dict[str, DataFrame | None]) -> DataFrame:
    """Bucket RVs joined with each model's predictions and labelled by regime.

    Inner joins on (stock_id, time_id); the first model that has ``actual_rv`` supplies it, a
    missing model gives a NULL column, and without any model the bucket target is used.
    """
    out = buckets
    have_actual = False
    for name, df in models.items():
        if df is None:
            out = out.withColumn(f"pred_{name}", F.lit(None).cast("float"))
            continue
        cols = [F.col("predicted_rv").alias(f"pred_{name}")]
        if not have_actual and "actual_rv" in df.columns:
            cols.append(F.col("actual_rv"))
            have_actual = True
        out = out.join(df.select("stock_id", "time_id", *cols), ["stock_id", "time_id"], "inner")
    if not have_actual:
        out = out.withColumn("actual_rv", F.col("rv_target"))
    floats = [*BUCKETS, "rv_target", "actual_rv", *[f"pred_{m}" for m in models]]
    return out.select(
        F.col("stock_id").cast("int").alias("stock_id"), F.col("time_id").cast("int").alias("time_id"),
        *[F.col(c).cast("float").alias(c) for c in floats],
        vc.regime_label("actual_rv").alias("regime"))


def available_models(master: DataFrame, models: Sequence[str]) -> list[str]:
    """Models with at least one prediction (one pass; the result has one flag per model)."""
    row = master.agg(*[F.count(F.col(f"pred_{m}")).alias(m) for m in models]).first()
    return [m for m in models if row[m] > 0]


def merge_report(master: DataFrame, models: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Regime distribution and missing predictions per model."""
    return (master.groupBy("regime").agg(F.count(F.lit(1)).alias("n")),
            missing_report(master, [f"pred_{m}" for m in models], only_missing=False))


def stack(master: DataFrame, models: Sequence[str]) -> DataFrame:
    """Long form: one row per (stock, snapshot, model)."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").cast("double").alias("pred"))
                                for m in models]))
    return master.select("stock_id", "time_id", "regime", F.col("actual_rv").cast("double").alias("actual_rv"),
                         cells.alias("_c")).select("stock_id", "time_id", "regime", "actual_rv", "_c.*")


def selected(df: DataFrame, regimes: Sequence[str] | None = None, stocks: Sequence[int] | None = None) -> DataFrame:
    if regimes:
        df = df.where(F.col("regime").isin(list(regimes)))
    if stocks:
        df = df.where(F.col("stock_id").isin(list(stocks)))
    return df


def _as_double(c: str) -> Column:
    return F.col(c).cast("double")


def _double_text(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


# ---- monitor --------------------------------------------------------------------

def snapshot_status(master: DataFrame, time_id: int | None = None) -> DataFrame:
    """Status badge of one snapshot, or of all."""
    rows = master if time_id is None else master.where(F.col("time_id") == time_id)
    agg = rows.groupBy("time_id").agg(count_where(F.col("regime") == "stressed").alias("n_stressed"),
                                      count_where(F.col("regime") == "elevated").alias("n_elevated"))
    status = F.when(F.col("n_stressed") > 5, "HIGH STRESS").when(F.col("n_elevated") > 10, "ELEVATED").otherwise("CALM")
    return agg.withColumn("status", status)


def snapshot_summary(master: DataFrame, model: str, time_id: int | None = None) -> DataFrame:
    rows = master if time_id is None else master.where(F.col("time_id") == time_id)
    actual, pred = _as_double("actual_rv"), _as_double(f"pred_{model}")
    return rows.groupBy("time_id").agg(
        F.avg(actual).alias("mean_rv"),
        (F.avg(F.col("regime").isin("elevated", "stressed").cast("double")) * 100.0).alias("pct_elevated"),
        F.avg(pred).alias("mean_pred"), qlike(_double_text("actual_rv"), _double_text(f"pred_{model}"), EPS).alias("qlike"))


def heatmap_cells(master: DataFrame, model: str, time_id: int | None = None) -> DataFrame:
    """Grid position, regime code and value of each stock; a snapshot has one row per stock."""
    rows = master if time_id is None else master.where(F.col("time_id") == time_id)
    pred = _as_double(f"pred_{model}")
    rank = F.row_number().over(W.partitionBy("time_id").orderBy(pred.desc_nulls_last(), "stock_id")) - 1
    return rows.select("time_id", "stock_id", F.coalesce(pred, F.lit(0.0)).alias("value"),
                       vc.regime_code("regime").alias("regime_code"), rank.alias("_r")).select(
        "time_id", F.floor(F.col("_r") / HEAT_COLUMNS).cast("int").alias("row"),
        (F.col("_r") % HEAT_COLUMNS).cast("int").alias("col"), "stock_id", "value", "regime_code")


def risk_table(master: DataFrame, time_id: int, model: str, watchlist: Sequence[int] = ()) -> DataFrame:
    pred, actual = _as_double(f"pred_{model}"), _as_double("actual_rv")
    watched = F.col("stock_id").isin(list(watchlist)) if watchlist else F.lit(False)
    rows = master.where(F.col("time_id") == time_id).select(
        "stock_id", "regime", pred.alias("pred_rv"), actual.alias("actual_rv"), (pred - actual).alias("error"),
        qlike_loss(_double_text("actual_rv"), _double_text(f"pred_{model}"), EPS).alias("qlike"), watched.alias("watched"))
    return rows.orderBy(F.col("watched").desc(), F.col("pred_rv").desc_nulls_last(), "stock_id")


def export_table(master: DataFrame, time_id: int, model: str) -> DataFrame:
    pred, actual = _as_double(f"pred_{model}"), _as_double("actual_rv")
    error = pred - actual
    return master.where(F.col("time_id") == time_id).select(
        "stock_id", "regime", pred.alias("pred_rv"), actual.alias("actual_rv"), error.alias("error"),
        (F.abs(error) / vc.at_least(actual, EPS) * 100.0).alias("rpe_pct"),
    ).orderBy(F.col("pred_rv").desc_nulls_last(), "stock_id")


def regime_counts(master: DataFrame, time_id: int | None = None) -> DataFrame:
    """Stocks per regime and snapshot, zero where a regime does not occur."""
    rows = master if time_id is None else master.where(F.col("time_id") == time_id)
    counts = rows.groupBy("time_id").agg(*[count_where(F.col("regime") == r).alias(r) for r in REGIMES])
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(r).alias("n")) for r in REGIMES]))
    return counts.select("time_id", cells.alias("c")).select("time_id", "c.*")


# ---- stock track record ---------------------------------------------------------

def track_axis(master: DataFrame, stock_id: int | None = None) -> DataFrame:
    """99th percentile of actual RV per stock (the axis bound of the scatter)."""
    rows = master if stock_id is None else master.where(F.col("stock_id") == stock_id)
    return exact_quantiles(rows, ["stock_id"], "actual_rv", {"rv_max": 0.99})


def track_scores(master: DataFrame, models: Sequence[str], stock_id: int | None = None) -> DataFrame:
    """QLIKE and correlation per stock and model."""
    rows = master if stock_id is None else master.where(F.col("stock_id") == stock_id)
    return stack(rows, models).groupBy("stock_id", "model").agg(
        qlike("actual_rv", "pred", EPS).alias("qlike"), corr0("pred", "actual_rv").alias("corr"))


def track_points(master: DataFrame, models: Sequence[str], stock_id: int) -> DataFrame:
    return stack(master.where(F.col("stock_id") == stock_id), models).where("pred IS NOT NULL").select(
        "model", "time_id", "pred", "actual_rv", "regime")


def residual_histogram(master: DataFrame, stock_id: int, model: str, bins: int = 40) -> DataFrame:
    rows = master.where(F.col("stock_id") == stock_id).select(
        (_as_double(f"pred_{model}") - _as_double("actual_rv")).alias("residual"))
    return range_histogram(rows, "residual", bins)


# ---- regimes and buckets --------------------------------------------------------

def regime_leaderboard(master: DataFrame, models: Sequence[str], stock_id: int | None = None) -> DataFrame:
    """QLIKE per regime and model with the best model of each regime."""
    rows = master if stock_id is None else master.where(F.col("stock_id") == stock_id)
    scores = stack(rows, models).groupBy("regime", "model").agg(qlike("actual_rv", "pred", EPS).alias("qlike"))
    best = scores.where("qlike IS NOT NULL").groupBy("regime").agg(
        F.min_by("model", F.struct("qlike", "model")).alias("best_model"))
    return scores.join(F.broadcast(best), "regime", "left")


def bucket_trajectory(master: DataFrame, stock_id: int, time_id: int, model: str) -> DataFrame:
    """Oldest-to-newest bucket RVs of one cell, then prediction, actual and target."""
    points = [("t-4", "rv_b3"), ("t-3", "rv_b2"), ("t-2", "rv_b1"), ("t-1", "rv_b0"), ("pred", f"pred_{model}"),
              ("actual", "actual_rv"), ("target", "rv_target")]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("label"), _as_double(c).alias("rv"))
                                for i, (n, c) in enumerate(points)]))
    row = master.where((F.col("stock_id") == stock_id) & (F.col("time_id") == time_id))
    return row.select(cells.alias("c")).select("c.*").where("rv IS NOT NULL")


def bucket_cross_section(master: DataFrame, time_id: int, stock_id: int) -> DataFrame:
    """Box summary of each bucket over the stocks of a snapshot, with one stock's value."""
    rows = master.where(F.col("time_id") == time_id)
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), _as_double(b).alias("rv")) for b in BUCKETS]))
    long = rows.select("stock_id", cells.alias("c")).select("stock_id", "c.*").where("rv IS NOT NULL")
    box = exact_quantiles(long, ["bucket"], "rv", {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})
    own = long.groupBy("bucket").agg(F.max(F.when(F.col("stock_id") == stock_id, F.col("rv"))).alias("stock_rv"),
                                     F.count(F.lit(1)).alias("n"))
    return box.join(F.broadcast(own), "bucket")


# ---- leaderboard ----------------------------------------------------------------

def hit_rates(stacked: DataFrame, pooled: bool = False) -> DataFrame:
    """Share of consecutive rows whose direction is predicted, per model.

    Rows with both values, in (stock, snapshot) order.  By default a difference stays within a
    stock; ``pooled=True`` also counts the step from one stock to the next, as published.
    """
    live = stacked.where("actual_rv IS NOT NULL AND pred IS NOT NULL").select(
        "model", "stock_id", "time_id", "actual_rv", "pred")
    indexed = with_global_index(live, ["model", "stock_id", "time_id"])
    pairs = lag_by_index(indexed, ["model"] if pooled else ["model", "stock_id"], ["actual_rv", "pred"])
    hit = (F.signum(F.col("actual_rv") - F.col("actual_rv_prev")) == F.signum(F.col("pred") - F.col("pred_prev")))
    return pairs.where("pred_prev IS NOT NULL").groupBy("model").agg((F.avg(hit.cast("double")) * 100.0).alias("hit"))


def leaderboard(master: DataFrame, models: Sequence[str], metric: str = "qlike", regimes: Sequence[str] | None = None,
                stocks: Sequence[int] | None = None, pooled_hits: bool = False) -> DataFrame:
    """All models ranked by one metric, with the distance to the best and the other metrics."""
    long = stack(selected(master, regimes, stocks), models)
    scores = long.groupBy("model").agg(*[c.alias(n) for n, c in dashboard_metrics("actual_rv", "pred", EPS).items()])
    scores = scores.join(F.broadcast(hit_rates(long, pooled_hits)), "model", "left")
    value = F.col(metric)
    badness = value if metric in LOWER_BETTER else F.abs(value) if metric in NEAR_ZERO_BETTER else -value
    everyone = W.partitionBy(F.lit(0))
    ranked = scores.withColumn("_bad", badness).withColumns({
        "rank": F.row_number().over(everyone.orderBy(F.col("_bad").asc_nulls_last(), "model")),
        "vs_best": F.col("_bad") - F.min("_bad").over(everyone),
    })
    return ranked.select("rank", "model", value.alias("score"), "vs_best", "qlike", "rmspe", "bias", "corr", "hit")


def metric_over_time(master: DataFrame, models: Sequence[str], metric: str = "qlike",
                     regimes: Sequence[str] | None = None, stocks: Sequence[int] | None = None) -> DataFrame:
    """One metric per snapshot and model."""
    long = stack(selected(master, regimes, stocks), models).where("actual_rv IS NOT NULL AND pred IS NOT NULL")
    if metric != "hit":
        return long.groupBy("time_id", "model").agg(dashboard_metrics("actual_rv", "pred", EPS)[metric].alias("score"))
    # Consecutive stocks of one snapshot: one row per stock of the universe.
    w = W.partitionBy("model", "time_id").orderBy("stock_id")
    steps = long.select("time_id", "model", F.signum(F.col("actual_rv") - F.lag("actual_rv").over(w)).alias("a"),
                        F.signum(F.col("pred") - F.lag("pred").over(w)).alias("p"))
    return steps.where("a IS NOT NULL").groupBy("time_id", "model").agg(
        (F.avg((F.col("a") == F.col("p")).cast("double")) * 100.0).alias("score"))
