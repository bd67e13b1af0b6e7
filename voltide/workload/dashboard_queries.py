"""Dashboard queries over the master table built from the book and three simple forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.constants import REGIMES
from voltide.operators import dashboard, rv
from voltide.session import cut_lineage
from voltide.workload.base import (
    DENSE_SQL, MODELS, PRED_SQL, Entry, book_runs, corr_sql, predictions, qlike_sql, r, returns_sql, rounded, rs, rv_sql, with_sql,
)

DAY, STOCK, MODEL = 7, 3, "ols"
ALL = [*MODELS, "absent"]


def master(spark, sf_dir):
    """The dashboard table, built and written once before it is queried."""
    long = cut_lineage(predictions(spark, sf_dir))
    per_model = {m: long.where(F.col("model") == m).drop("model", "fold") for m in MODELS}
    return cut_lineage(dashboard.build_master(rv.bucket_rv(book_runs(spark, sf_dir)), {**per_model, "absent": None}))


BK = ["rv_b0", "rv_b1", "rv_b2", "rv_b3", "rv_target"]
MASTER_SQL = PRED_SQL + f""",
dense AS ({DENSE_SQL.split('dense AS (', 1)[1].rsplit(')', 1)[0]})""" + returns_sql("dense", "dret", eps="1e-10") + f""",
bk AS (SELECT stock_id, time_id, {', '.join(f"{rv_sql(lo, hi, 'coalesce(lr, 0)')} AS {n}" for n, lo, hi in rv.BUCKETS_120)} FROM dret GROUP BY stock_id, time_id),
m0 AS (SELECT stock_id, time_id, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in [*BK, 'actual_rv', 'pred_naive', 'pred_scaled', 'pred_ols'])}, CAST(NULL AS FLOAT) AS pred_absent,
  CASE WHEN actual_rv < 0.001 THEN 'calm' WHEN actual_rv < 0.005 THEN 'normal' WHEN actual_rv < 0.02 THEN 'elevated' ELSE 'stressed' END AS regime
  FROM bk JOIN aligned USING (stock_id, time_id)),
m AS (SELECT stock_id, time_id, regime, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in [*BK, 'actual_rv', 'pred_naive', 'pred_scaled', 'pred_ols', 'pred_absent'])} FROM m0),
st AS ({' UNION ALL '.join(f"SELECT stock_id, time_id, regime, actual_rv, '{m}' AS model, pred_{m} AS pred FROM m" for m in MODELS)})"""

_Q = f"avg({qlike_sql('actual_rv', 'pred', '1e-8')})"
_R = "sqrt(avg(power((greatest(pred, 1e-8) - greatest(actual_rv, 1e-8)) / greatest(actual_rv, 1e-8), 2))) * 100"
_B = "avg((greatest(pred, 1e-8) - greatest(actual_rv, 1e-8)) / greatest(actual_rv, 1e-8)) * 100"
_C = corr_sql("pred", "actual_rv")


def _master(spark, sf_dir):
    return rounded(master(spark, sf_dir))


def _available(spark, sf_dir):
    """One row per model that has predictions."""
    m = master(spark, sf_dir)
    found = dashboard.available_models(m, ALL)
    counts = m.select(F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(f"pred_{x}").alias("p")) for x in found])).alias("c"))
    return counts.groupBy("c.model").agg(F.count("c.p").alias("n_predictions"))


def _report(which):
    def run(spark, sf_dir):
        return rounded(dashboard.merge_report(master(spark, sf_dir), ALL)[which])
    return run


def _risk(spark, sf_dir):
    return rounded(dashboard.risk_table(master(spark, sf_dir), DAY, MODEL, [2, 5]))


HIT_CTE = """,
hx AS (SELECT model, stock_id, actual_rv, pred, lag(actual_rv) OVER w AS a0, lag(pred) OVER w AS p0 FROM {src} WHERE pred IS NOT NULL
  WINDOW w AS (PARTITION BY {part} ORDER BY stock_id, time_id)),
hit AS (SELECT model, avg(CASE WHEN sign(actual_rv - a0) = sign(pred - p0) THEN 1e0 ELSE 0 END) * 100 AS hit FROM hx WHERE p0 IS NOT NULL GROUP BY model)"""


def _board_sql(metric: str, where: str = "TRUE", pooled: bool = False) -> str:
    bad = {"qlike": "qlike", "rmspe": "rmspe", "bias": "abs(bias)", "hit": "-hit", "corr": "-corr"}[metric]
    return with_sql(MASTER_SQL, f""", f AS (SELECT * FROM st WHERE {where})""" + HIT_CTE.format(src="f", part="model" if pooled else "model, stock_id") + f""",
sc AS (SELECT model, {_Q} AS qlike, {_R} AS rmspe, {_B} AS bias, {_C} AS corr FROM f GROUP BY model),
j AS (SELECT * FROM sc LEFT JOIN hit USING (model)),
k AS (SELECT *, {bad} AS bad, {metric} AS score FROM j)
SELECT CAST(row_number() OVER (ORDER BY bad NULLS LAST, model) AS INTEGER) AS "rank", model, {r('score')}, {r('bad - min(bad) OVER ()', 'vs_best')}, {rs('qlike', 'rmspe', 'bias', 'corr', 'hit')} FROM k""")


def _board(metric, regimes=None, stocks=None, pooled=False):
    def run(spark, sf_dir):
        return rounded(dashboard.leaderboard(master(spark, sf_dir), MODELS, metric, regimes, stocks, pooled))
    return run


def _chart(metric):
    def run(spark, sf_dir):
        return rounded(dashboard.metric_over_time(master(spark, sf_dir), MODELS, metric))
    return run


def _resid(spark, sf_dir):
    return rounded(dashboard.residual_histogram(master(spark, sf_dir), STOCK, MODEL).select("bin", "left_edge", "n"))


QUERIES: dict[str, Entry] = {
    "dashboard_master": (_master, with_sql(MASTER_SQL, f"SELECT stock_id, time_id, {rs(*BK, 'actual_rv', 'pred_naive', 'pred_scaled', 'pred_ols', 'pred_absent')}, regime FROM m")),
    "dashboard_available_models": (_available, with_sql(MASTER_SQL, "SELECT model, count(pred) AS n_predictions FROM st GROUP BY model")),
    "dashboard_regime_distribution": (_report(0), with_sql(MASTER_SQL, "SELECT regime, count(*) AS n FROM m GROUP BY regime")),
    "dashboard_missing_predictions": (_report(1), with_sql(MASTER_SQL, " UNION ALL ".join(
        f'SELECT \'pred_{x}\' AS "column", count(*) - count(pred_{x}) AS n_missing, {r(f"(count(*) - count(pred_{x})) * 100e0 / count(*)", "pct_missing")} FROM m' for x in ALL))),
    "dashboard_status": (lambda s, d: dashboard.snapshot_status(master(s, d)), with_sql(MASTER_SQL, """SELECT time_id, count(CASE WHEN regime = 'stressed' THEN 1 END) AS n_stressed,
  count(CASE WHEN regime = 'elevated' THEN 1 END) AS n_elevated, CASE WHEN count(CASE WHEN regime = 'stressed' THEN 1 END) > 5 THEN 'HIGH STRESS'
  WHEN count(CASE WHEN regime = 'elevated' THEN 1 END) > 10 THEN 'ELEVATED' ELSE 'CALM' END AS status FROM m GROUP BY time_id""")),
    "dashboard_summary": (lambda s, d: rounded(dashboard.snapshot_summary(master(s, d), MODEL)), with_sql(MASTER_SQL, f"""SELECT time_id, {r('avg(actual_rv)', 'mean_rv')},
  {r("avg(CASE WHEN regime IN ('elevated', 'stressed') THEN 1e0 ELSE 0 END) * 100", 'pct_elevated')}, {r('avg(pred)', 'mean_pred')}, {r(_Q, 'qlike')} FROM st WHERE model = '{MODEL}' GROUP BY time_id""")),
    "dashboard_heatmap": (lambda s, d: rounded(dashboard.heatmap_cells(master(s, d), MODEL)), with_sql(MASTER_SQL, f""", h AS (SELECT *, row_number() OVER (PARTITION BY time_id ORDER BY pred_{MODEL} DESC NULLS LAST, stock_id) - 1 AS k FROM m)
SELECT time_id, CAST(k // 14 AS INTEGER) AS "row", CAST(k % 14 AS INTEGER) AS col, stock_id, {r(f'coalesce(pred_{MODEL}, 0)', 'value')},
  CASE regime WHEN 'calm' THEN 0 WHEN 'normal' THEN 1 WHEN 'elevated' THEN 2 WHEN 'stressed' THEN 3 ELSE 1 END AS regime_code FROM h""")),
    "dashboard_risk_table": (_risk, with_sql(MASTER_SQL, f"""SELECT stock_id, regime, {r('pred', 'pred_rv')}, {r('actual_rv')}, {r('pred - actual_rv', 'error')}, {r(qlike_sql('actual_rv', 'pred', '1e-8'), 'qlike')},
  stock_id IN (2, 5) AS watched FROM st WHERE model = '{MODEL}' AND time_id = {DAY}""")),
    "dashboard_export": (lambda s, d: rounded(dashboard.export_table(master(s, d), DAY, MODEL)), with_sql(MASTER_SQL, f"""SELECT stock_id, regime, {r('pred', 'pred_rv')}, {r('actual_rv')}, {r('pred - actual_rv', 'error')},
  {r('abs(pred - actual_rv) / greatest(actual_rv, 1e-8) * 100', 'rpe_pct')} FROM st WHERE model = '{MODEL}' AND time_id = {DAY}""")),
    "dashboard_regime_counts": (lambda s, d: dashboard.regime_counts(master(s, d)), with_sql(MASTER_SQL, " UNION ALL ".join(
        f"SELECT time_id, '{g}' AS regime, count(CASE WHEN regime = '{g}' THEN 1 END) AS n FROM m GROUP BY time_id" for g in REGIMES))),
    "dashboard_track_axis": (lambda s, d: rounded(dashboard.track_axis(master(s, d))), with_sql(MASTER_SQL, f"SELECT stock_id, {r('quantile_cont(actual_rv, 0.99)', 'rv_max')} FROM m GROUP BY stock_id")),
    "dashboard_track_scores": (lambda s, d: rounded(dashboard.track_scores(master(s, d), MODELS)), with_sql(MASTER_SQL, f"SELECT stock_id, model, {r(_Q, 'qlike')}, {r(_C, 'corr')} FROM st GROUP BY stock_id, model")),
    "dashboard_track_points": (lambda s, d: rounded(dashboard.track_points(master(s, d), MODELS, STOCK)), with_sql(MASTER_SQL, f"SELECT model, time_id, {rs('pred', 'actual_rv')}, regime FROM st WHERE stock_id = {STOCK} AND pred IS NOT NULL")),
    "dashboard_residual_histogram": (_resid, with_sql(MASTER_SQL, f""", e AS (SELECT pred - actual_rv AS v FROM st WHERE model = '{MODEL}' AND stock_id = {STOCK}), b AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
h AS (SELECT lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 40e0)), 39) AS INTEGER) AS bin FROM e, b WHERE v IS NOT NULL)
SELECT bin, {r('max(lo) + (max(hi) - max(lo)) / 40e0 * bin', 'left_edge')}, count(*) AS n FROM h GROUP BY bin""")),
    "dashboard_regime_leaderboard": (lambda s, d: rounded(dashboard.regime_leaderboard(master(s, d), MODELS)), with_sql(MASTER_SQL, f""", q AS (SELECT regime, model, {_Q} AS q FROM st GROUP BY regime, model)
SELECT regime, model, {r('q', 'qlike')}, first_value(model) OVER (PARTITION BY regime ORDER BY q NULLS LAST, model) AS best_model FROM q""")),
    "dashboard_bucket_trajectory": (lambda s, d: rounded(dashboard.bucket_trajectory(master(s, d), STOCK, DAY, MODEL)), with_sql(MASTER_SQL, " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS label, {r(c, 'rv')} FROM m WHERE stock_id = {STOCK} AND time_id = {DAY} AND {c} IS NOT NULL" for i, (n, c) in enumerate(
            [("t-4", "rv_b3"), ("t-3", "rv_b2"), ("t-2", "rv_b1"), ("t-1", "rv_b0"), ("pred", f"pred_{MODEL}"), ("actual", "actual_rv"), ("target", "rv_target")])))),
    "dashboard_bucket_cross_section": (lambda s, d: rounded(dashboard.bucket_cross_section(master(s, d), DAY, STOCK)), with_sql(MASTER_SQL, " UNION ALL ".join(
        f"""SELECT '{b}' AS bucket, {', '.join(r(f'quantile_cont({b}, {p})', n) for n, p in (('q0', 0.0), ('q25', 0.25), ('q50', 0.5), ('q75', 0.75), ('q100', 1.0)))},
  {r(f'max(CASE WHEN stock_id = {STOCK} THEN {b} END)', 'stock_rv')}, count({b}) AS n FROM m WHERE time_id = {DAY}""" for b in BK[:4]))),
    "leaderboard_qlike": (_board("qlike"), _board_sql("qlike")),
    "leaderboard_rmspe_filtered": (_board("rmspe", ["elevated", "stressed"], [0, 1, 2, 3]), _board_sql("rmspe", "regime IN ('elevated', 'stressed') AND stock_id IN (0, 1, 2, 3)")),
    "leaderboard_bias": (_board("bias"), _board_sql("bias")),
    "leaderboard_corr": (_board("corr"), _board_sql("corr")),
    "leaderboard_hit": (_board("hit"), _board_sql("hit")),
    "leaderboard_hit_pooled": (_board("hit", pooled=True), _board_sql("hit", pooled=True)),
    **{f"metric_over_time_{k}": (_chart(k), with_sql(MASTER_SQL, f"SELECT time_id, model, {r(e, 'score')} FROM st WHERE pred IS NOT NULL GROUP BY time_id, model"))
       for k, e in {"qlike": _Q, "rmspe": _R, "bias": _B, "corr": _C}.items()},
    "metric_over_time_hit": (_chart("hit"), with_sql(MASTER_SQL, f""", x AS (SELECT time_id, model, sign(actual_rv - lag(actual_rv) OVER w) AS a, sign(pred - lag(pred) OVER w) AS p FROM st WHERE pred IS NOT NULL
  WINDOW w AS (PARTITION BY model, time_id ORDER BY stock_id))
SELECT time_id, model, {r('avg(CASE WHEN a = p THEN 1e0 ELSE 0 END) * 100', 'score')} FROM x WHERE a IS NOT NULL GROUP BY time_id, model""")),
}
