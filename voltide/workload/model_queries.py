"""Fold, regression, GARCH, booster and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions.losses import log_metrics
from voltide.operators import boost, folds, garch, har, har_models, lockstep, ols, rv, scoring, wide
from voltide.operators.folds import with_folds
from voltide.session import cut_lineage, tables_dropped
from voltide.workload.base import (
    DENSE_SQL, HAR_SQL, RAW_SQL, Entry, book_raw, book_runs, folds_sql, har_rows, hash_sql, ols_solve_sql,
    ols_sum_names, ols_sums_sql, qlike_sql, r, returns_sql, rounded, rs, rv_sql, sqpct_sql, with_sql,
)
from voltide.workload.book_queries import TENSOR_SQL

XS = har.FULL_FEATURES
P = len(XS)


def assignment(spark, sf_dir):
    return folds.shuffle_splits(folds.distinct_snapshots(book_raw(spark, sf_dir)))


def _fold_table(spark, sf_dir):
    return assignment(spark, sf_dir)


def _fold_sizes(spark, sf_dir):
    """Snapshots per fold and split, with the number of snapshots on both sides (must be 0)."""
    a = assignment(spark, sf_dir)
    both = folds.overlap_check(a).groupBy("fold").agg(F.count(F.lit(1)).alias("n_overlap"))
    sizes = folds.require_folds(a).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n_snapshots"))
    return sizes.join(both, "fold", "left").select("fold", "split", "n_snapshots", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))


def _split_rows(spark, sf_dir):
    book = book_raw(spark, sf_dir)
    rows = folds.split_rows(book, assignment(spark, sf_dir), 2, "test")
    return rows.groupBy("time_id").agg(F.count(F.lit(1)).alias("n_quotes"))


FOLDS_SQL = RAW_SQL + folds_sql("raw")
FOLDS_HAR_SQL = HAR_SQL + folds_sql("raw")


def _holdout(spark, sf_dir):
    return folds.holdout_split(har_rows(spark, sf_dir)).select("stock_id", "time_id", "split")


def _kfold(by_stock):
    def run(spark, sf_dir):
        return folds.kfold_parts(har_rows(spark, sf_dir), 5, by_stock).select("stock_id", "time_id", "part")
    return run


ROW_HASH = hash_sql("(CAST(stock_id AS BIGINT) * 1000003 + time_id)", 42)
HOLDOUT_CTE = f""",
held AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {ROW_HASH}, stock_id, time_id) <= greatest(1, round_even(count(*) OVER () * 2e-1, 0))
  THEN 'test' ELSE 'train' END AS split FROM har_rows)"""


def _parts_cte(by_stock: bool) -> str:
    if by_stock:
        src, pos = "SELECT DISTINCT stock_id FROM har_rows", f"row_number() OVER (ORDER BY {hash_sql('stock_id', 42)}, stock_id)"
    else:
        src, pos = "SELECT stock_id, time_id FROM har_rows", f"row_number() OVER (ORDER BY {ROW_HASH}, stock_id, time_id)"
    keys = "stock_id" if by_stock else "stock_id, time_id"
    return f""",
pos AS (SELECT {keys}, {pos} - 1 AS i, count(*) OVER () AS n FROM ({src}) q),
part_of AS (SELECT {keys}, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
  ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS INTEGER) AS part FROM pos),
parted AS (SELECT h.*, p.part FROM har_rows h JOIN part_of p USING ({keys}))"""


# ---- pooled HAR -------------------------------------------------------------------

def fold_forecasts(spark, sf_dir):
    return har_models.fold_forecasts(har_rows(spark, sf_dir), assignment(spark, sf_dir))


FOLD_FIT_SQL = FOLDS_HAR_SQL + f""",
rows5 AS (SELECT h.*, f.fold, f.split, f.inner_part FROM har_rows h JOIN folds f USING (time_id)),
sums AS (SELECT {ols_sums_sql(['fold'], XS, har.LOG_TARGET)} FROM rows5 WHERE split = 'train' GROUP BY fold),
{ols_solve_sql('sums', ['fold'], P, 'coef')},
scored AS (SELECT r.stock_id, r.time_id, r.fold, r.split, r.target_rv_480_600,
  greatest(exp(c.b_0 + {' + '.join(f'c.b_{k + 1} * r.{x}' for k, x in enumerate(XS))}) - 1e-12, 1e-4) AS pred,
  greatest(r.rv_360_480, 1e-4) AS naive FROM rows5 r JOIN coef c USING (fold)),
long_scored AS (SELECT fold, split, 'HAR' AS model, target_rv_480_600 AS t, pred AS p FROM scored
  UNION ALL SELECT fold, split, 'naive_last_2min', target_rv_480_600, naive FROM scored)"""

_METRICS3 = (f"sqrt(avg({sqpct_sql('t', 'p', '1e-12')}))", f"avg({qlike_sql('t', 'p', '1e-12')})", "avg(power(t - p, 2))")
M3 = ", ".join(r(e, n) for e, n in zip(_METRICS3, ("rmspe", "qlike", "mse")))
M3_RAW = ", ".join(f"{e} AS {n}" for e, n in zip(_METRICS3, ("rmspe", "qlike", "mse")))


def _coefficients(spark, sf_dir):
    _, coefs = fold_forecasts(spark, sf_dir)
    return rounded(ols.coefficient_table(coefs, ["fold"], XS))


def _coefficients_sql() -> str:
    items = " UNION ALL ".join(["SELECT fold, 'intercept' AS feature, b_0 AS coefficient, 0 AS s FROM coef"] + [
        f"SELECT fold, '{x}', b_{k + 1}, 1 FROM coef" for k, x in enumerate(XS)])
    return with_sql(FOLD_FIT_SQL, f"""SELECT fold, CAST(row_number() OVER (PARTITION BY fold ORDER BY s, abs(coefficient) DESC, feature) - 1 AS INTEGER) AS position,
  feature, {r('coefficient')} FROM ({items}) q""")


def _fold_metrics(spark, sf_dir):
    rows, _ = fold_forecasts(spark, sf_dir)
    return rounded(har_models.split_metrics(rows, ["fold", "split"]))


def _fold_summary(spark, sf_dir):
    rows, _ = fold_forecasts(spark, sf_dir)
    return rounded(har.fold_summary(har.long_scores(rows.where("split = 'test'"), ["fold"])))


FOLD_SUMMARY_SQL = with_sql(FOLD_FIT_SQL, f""", f AS (SELECT model, fold, CAST(count(*) AS DOUBLE) AS n_rows, {M3_RAW} FROM long_scored WHERE split = 'test' GROUP BY model, fold)
SELECT model, CAST(fold AS VARCHAR) AS fold_id, 'test' AS split, {rs('n_rows', 'rmspe', 'qlike', 'mse')} FROM f
UNION ALL SELECT model, 'all', 'test_pooled', {r('count(*)', 'n_rows')}, {M3} FROM long_scored WHERE split = 'test' GROUP BY model
UNION ALL SELECT model, 'mean', 'test_fold_mean', {', '.join(r(f'avg({c})', c) for c in ('n_rows', 'rmspe', 'qlike', 'mse'))} FROM f GROUP BY model
UNION ALL SELECT model, 'std', 'test_fold_std', {', '.join(r(f'stddev_pop({c})', c) for c in ('n_rows', 'rmspe', 'qlike', 'mse'))} FROM f GROUP BY model""")


def _error_columns(spark, sf_dir):
    rows, _ = fold_forecasts(spark, sf_dir)
    cols = ["stock_id", "time_id", "fold", har.TARGET, "predicted_rv_480_600", "naive_rv_360_480"]
    return rounded(har.with_error_columns(rows.where("split = 'test'").select(*cols)))


ERRORS_SQL = with_sql(FOLD_FIT_SQL, f"""SELECT stock_id, time_id, fold, {r('target_rv_480_600')}, {r('pred', 'predicted_rv_480_600')}, {r('naive', 'naive_rv_360_480')},
  {r('abs(target_rv_480_600 - pred)', 'absolute_error')}, {r('abs(target_rv_480_600 - pred) / target_rv_480_600', 'percentage_error')},
  {r('abs(target_rv_480_600 - naive)', 'naive_absolute_error')}, {r('abs(target_rv_480_600 - naive) / target_rv_480_600', 'naive_percentage_error')}
FROM scored WHERE split = 'test'""")


def _holdout_metrics(spark, sf_dir):
    rows, _ = har_models.holdout_forecasts(har.require_rows(har_rows(spark, sf_dir)), har.PURE_FEATURES)
    return rounded(har_models.split_metrics(rows, ["split"]))


HOLDOUT_SQL = with_sql(HAR_SQL + HOLDOUT_CTE, f""",
sums AS (SELECT {ols_sums_sql([], har.PURE_FEATURES, har.LOG_TARGET)} FROM held WHERE split = 'train'),
{ols_solve_sql('sums', [], 3, 'coef')},
s AS (SELECT h.split, h.target_rv_480_600 AS t, greatest(exp(b_0 + b_1 * log_rv_360_480 + b_2 * log_rv_240_480 + b_3 * log_rv_0_480) - 1e-12, 1e-4) AS p,
  greatest(rv_360_480, 1e-4) AS nv FROM held h, coef),
l AS (SELECT split, 'HAR' AS model, t, p FROM s UNION ALL SELECT split, 'naive_last_2min', t, nv FROM s)
SELECT split, model, count(*) AS n_rows, {M3} FROM l GROUP BY split, model""")


def _cv(by_stock):
    def run(spark, sf_dir):
        return rounded(har_models.cross_validate(har_rows(spark, sf_dir), 5, by_stock))
    return run


def _cv_sql(by_stock: bool) -> str:
    names = ols_sum_names(P)
    return with_sql(HAR_SQL + _parts_cte(by_stock), f""",
ps AS (SELECT {ols_sums_sql(['part'], XS, har.LOG_TARGET)} FROM parted GROUP BY part),
sums AS (SELECT part, {', '.join(f'(SELECT sum({c}) FROM ps) - {c} AS {c}' for c in names)} FROM ps),
{ols_solve_sql('sums', ['part'], P, 'coef')},
s AS (SELECT r.part, r.target_rv_480_600 AS t, greatest(exp(c.b_0 + {' + '.join(f'c.b_{k + 1} * r.{x}' for k, x in enumerate(XS))}) - 1e-12, 1e-4) AS p
  FROM parted r JOIN coef c USING (part))
SELECT part + 1 AS fold, count(*) AS n_rows, {M3} FROM s GROUP BY part""")


# ---- per-stock HAR ----------------------------------------------------------------

def stock_oof(spark, sf_dir):
    return har_models.stock_har_oof(har_models.stock_har_windows(book_runs(spark, sf_dir)), assignment(spark, sf_dir))


def _ex(lo, hi):
    return f"greatest(coalesce({rv_sql(lo, hi, f'(CASE WHEN prev_s >= {lo} THEN coalesce(lr, 0) ELSE 0 END)')}, 1e-4), 1e-4)"


_N2 = ols_sum_names(2)
OOF_SQL = DENSE_SQL + folds_sql("dense") + returns_sql("dense", "ret", eps="1e-10") + f""",
win AS (SELECT stock_id, time_id, ln({_ex(0, 480)}) AS log_rv_in, ln({_ex(360, 480)}) AS log_rv_last_window, ln({_ex(480, 600)}) AS log_rv_fut
  FROM ret GROUP BY stock_id, time_id),
wf AS (SELECT w.*, f.fold, f.split, f.inner_part FROM win w JOIN folds f USING (time_id)),
ps AS (SELECT {ols_sums_sql(['fold', 'stock_id', 'inner_part'], ['log_rv_in', 'log_rv_last_window'], 'log_rv_fut')} FROM wf
  WHERE inner_part >= 0 GROUP BY fold, stock_id, inner_part),
tot AS (SELECT fold, stock_id, {', '.join(f'sum({c}) AS {c}' for c in _N2)} FROM ps GROUP BY fold, stock_id),
ok AS (SELECT fold, stock_id FROM wf GROUP BY fold, stock_id HAVING count(CASE WHEN inner_part >= 0 THEN 1 END) >= 10 AND count(CASE WHEN inner_part < 0 THEN 1 END) > 0),
sums AS (SELECT ps.fold, ps.stock_id, ps.inner_part, {', '.join(f'tot.{c} - ps.{c} AS {c}' for c in _N2)} FROM ps JOIN tot USING (fold, stock_id) JOIN ok USING (fold, stock_id)
  UNION ALL SELECT fold, stock_id, -1, {', '.join(_N2)} FROM tot JOIN ok USING (fold, stock_id)),
{ols_solve_sql('sums', ['fold', 'stock_id', 'inner_part'], 2, 'coef')},
oof AS (SELECT w.time_id, w.stock_id, w.fold, w.split, w.log_rv_fut, c.b_0 + c.b_1 * w.log_rv_in + c.b_2 * w.log_rv_last_window AS har_pred_log_rv
  FROM wf w JOIN coef c USING (fold, stock_id, inner_part))"""


def _stock_oof(spark, sf_dir):
    return rounded(stock_oof(spark, sf_dir))


def _weights(spark, sf_dir):
    """Inverse-RV training weights capped at the 99th percentile of their fold and split."""
    oof = cut_lineage(stock_oof(spark, sf_dir))
    table = boost.training_table(oof.select("time_id", "stock_id").distinct(), oof)
    return rounded(table.select("fold", "split", "stock_id", "time_id", "sample_weight"))


WEIGHTS_SQL = with_sql(OOF_SQL, f""", w AS (SELECT *, 1 / greatest(exp(log_rv_fut), 1e-4) AS w FROM oof)
SELECT fold, split, stock_id, time_id, {r('least(w, cap)', 'sample_weight')} FROM w JOIN
 (SELECT fold, split, quantile_cont(w, 0.99) AS cap FROM w GROUP BY fold, split) c USING (fold, split)""")


# ---- GARCH ------------------------------------------------------------------------

GARCH_SQL = DENSE_SQL + returns_sql("dense", "ret") + f""",
cl AS (SELECT *, CASE WHEN lr IS NULL THEN 0 ELSE greatest(least(lr, 5e-2), -5e-2) END AS c FROM ret),
g AS (SELECT stock_id, time_id, {rv_sql(None, 480, 'c')} AS rv_in, {rv_sql(480, 600, 'c')} AS rv_fut,
  CAST(count(CASE WHEN seconds_in_bucket < 480 THEN 1 END) AS INTEGER) AS n_input_obs,
  CAST(count(CASE WHEN seconds_in_bucket >= 480 THEN 1 END) AS INTEGER) AS n_future_obs FROM cl GROUP BY stock_id, time_id),
gp AS (SELECT stock_id, time_id, greatest(rv_fut, 1e-4) AS true_rv, greatest(rv_in * sqrt(n_future_obs / CAST(n_input_obs AS DOUBLE)), 1e-12) AS pred_rv,
  greatest(rv_in, 1e-8) AS anchor, n_input_obs, n_future_obs FROM g),
gl AS (SELECT *, ln(true_rv + 1e-12) AS true_log_rv, ln(pred_rv + 1e-12) AS pred_log_rv, ln(anchor + 1e-12) AS anchor_log_rv FROM gp)"""


def _baseline(spark, sf_dir):
    return rounded(garch.garch_predictions(book_runs(spark, sf_dir), solver=False))


def _garch(spark, sf_dir):
    return rounded(garch.garch_predictions(book_runs(spark, sf_dir)))


def _garch_grid(spark, sf_dir):
    return rounded(garch.grid_forecasts(book_runs(spark, sf_dir)))


GARCH_GRID_SQL = with_sql(GARCH_SQL, f""",
y AS (SELECT stock_id, time_id, power(c * 100e0, 2) AS y2, c, row_number() OVER (PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket) AS i FROM cl WHERE seconds_in_bucket < 480),
st AS (SELECT stock_id, time_id, count(*) AS n, greatest(avg(y2), 1e-12) AS mean2, stddev_pop(c) AS sd,
  greatest(sum(CASE WHEN i <= 75 THEN power(94e-2, i - 1) * y2 END) / sum(CASE WHEN i <= 75 THEN power(94e-2, i - 1) END), 1e-12) AS s0 FROM y GROUP BY stock_id, time_id),
pg AS (SELECT p * 3 + q AS ord, [5e-1, 9e-1, 98e-2][p + 1] AS persist, [5e-2, 2e-1, 5e-1][q + 1] AS share FROM (SELECT unnest(range(3)) AS p) a, (SELECT unnest(range(3)) AS q) b),
fs AS (SELECT st.*, ord, persist, mean2 * (1 - persist) AS omega, persist * share AS alpha, persist * (1 - share) AS beta FROM st, pg WHERE sd >= 1e-8),
steps AS (
  SELECT stock_id, time_id, ord, 1::BIGINT AS i, least(greatest(omega + (alpha + beta) * s0, 1e-12), 1e12) AS var, 0e0 AS nll FROM fs
  UNION ALL
  SELECT v.stock_id, v.time_id, v.ord, v.i + 1, least(greatest(f.omega + f.alpha * y.y2 + f.beta * v.var, 1e-12), 1e12), v.nll + 5e-1 * (ln(v.var) + y.y2 / v.var)
  FROM steps v JOIN y ON y.stock_id = v.stock_id AND y.time_id = v.time_id AND y.i = v.i JOIN fs f ON f.stock_id = v.stock_id AND f.time_id = v.time_id AND f.ord = v.ord),
done AS (SELECT f.*, v.var, v.nll, row_number() OVER (PARTITION BY f.stock_id, f.time_id ORDER BY v.nll, f.ord) AS place
  FROM fs f JOIN steps v ON v.stock_id = f.stock_id AND v.time_id = f.time_id AND v.ord = f.ord AND v.i = f.n + 1),
fc AS (SELECT stock_id, time_id, nll, sqrt(120 * mean2 + (var - mean2) * (1 - power(persist, 120)) / (1 - persist)) / 100 AS rv FROM done WHERE place = 1)
SELECT g.stock_id, g.time_id, {r('fc.rv', 'garch_rv')}, {r('fc.nll', 'neg_log_likelihood')}, n_input_obs FROM g LEFT JOIN fc ON fc.stock_id = g.stock_id AND fc.time_id = g.time_id
WHERE n_input_obs >= 5 AND n_future_obs >= 1""").replace("WITH ", "WITH RECURSIVE ", 1)


def garch_test_rows(spark, sf_dir, solver):
    pred = garch.garch_predictions(book_runs(spark, sf_dir), solver)
    return with_folds(pred, assignment(spark, sf_dir)).where("split = 'test'")


def _m7_items(p: str, eps: str, t: str) -> dict[str, str]:
    pl = f"greatest(least({p}, 5), -20)"
    pr, tr = f"greatest(exp({pl}), {eps})", f"greatest(exp({t}), {eps})"
    return {
        "qlike": f"avg({tr} / {pr} - ln({tr} / {pr}) - 1)", "rmspe_pct": f"sqrt(avg(power(({pr} - {tr}) / {tr}, 2))) * 100",
        "mape_pct": f"avg(abs({pr} - {tr}) / {tr}) * 100", "rmse": f"sqrt(avg(power({pr} - {tr}, 2)))",
        "mse_rv": f"avg(power({pr} - {tr}, 2))", "mae_log": f"avg(abs({pl} - {t}))", "mse_log_rv": f"avg(power({pl} - {t}, 2))"}


def _m7(p: str, prefix: str = "", eps: str = "1e-12", t: str = "true_log_rv") -> str:
    return ", ".join(r(e, prefix + n) for n, e in _m7_items(p, eps, t).items())


def _m7_raw(p: str, prefix: str = "", eps: str = "1e-12", t: str = "true_log_rv") -> str:
    return ", ".join(f"{e} AS {prefix}{n}" for n, e in _m7_items(p, eps, t).items())


def _baseline_report(spark, sf_dir):
    return rounded(garch.fold_report(garch_test_rows(spark, sf_dir, False)))


def _garch_report(spark, sf_dir):
    return rounded(garch.fold_report(garch_test_rows(spark, sf_dir, True)))


def _garch_per_stock(spark, sf_dir):
    return rounded(garch.per_stock_report(garch_test_rows(spark, sf_dir, True), ["fold", "stock_id"]))


def _baseline_per_stock(spark, sf_dir):
    return rounded(garch.per_stock_report(garch_test_rows(spark, sf_dir, False), ["fold", "stock_id"]))


GARCH_FOLD_SQL = GARCH_SQL + folds_sql("dense") + ", gt AS (SELECT * FROM gl JOIN folds USING (time_id) WHERE split = 'test')"


# ---- scoring ----------------------------------------------------------------------

_SEVEN = ["qlike", "rmspe_pct", "mape_pct", "rmse", "mse_rv", "mae_log", "mse_log_rv"]


def _fold_aggregate(spark, sf_dir):
    """Mean and std over folds of the seven metrics."""
    report = garch.fold_report(garch_test_rows(spark, sf_dir, False))
    return rounded(scoring.fold_aggregate(report, [f"garch_{m}" for m in _SEVEN]))


def log_pred(spark, sf_dir):
    """The scaled-RV forecast in log form, all samples."""
    return garch.garch_predictions(book_runs(spark, sf_dir), solver=False)


def _tiers(spark, sf_dir):
    return rounded(scoring.tier_report(log_pred(spark, sf_dir)))


def _dispersion(spark, sf_dir):
    return rounded(scoring.dispersion(log_pred(spark, sf_dir)))


def _extremes(spark, sf_dir):
    per = garch.per_stock_report(log_pred(spark, sf_dir))
    return rounded(scoring.stock_extremes(per, 5).select("side", "stock_id", "n_rows", "rmspe_pct"))


def _fold_dropped(spark, sf_dir):
    """Rows that the minimum target drops, by fold and split."""
    rows = har.add_model_columns(har.features_from_raw(book_raw(spark, sf_dir)))
    return har.target_filter_report(with_folds(rows, assignment(spark, sf_dir)), keys=["fold", "split"])


def _fold_tiers(spark, sf_dir):
    return rounded(scoring.tier_report(garch_test_rows(spark, sf_dir, False), keys=["fold"]))


def _fold_dispersion(spark, sf_dir):
    return rounded(scoring.dispersion(garch_test_rows(spark, sf_dir, False), ["fold"]))


def _fold_extremes(spark, sf_dir):
    per = garch.per_stock_report(garch_test_rows(spark, sf_dir, False), ["fold", "stock_id"])
    return rounded(scoring.stock_extremes(per, 5, keys=["fold"]).select("fold", "side", "stock_id", "n_rows", "rmspe_pct"))


def _bias(spark, sf_dir):
    return rounded(scoring.stock_bias(log_pred(spark, sf_dir)))


def _bias_summary(spark, sf_dir):
    bias = scoring.stock_bias(log_pred(spark, sf_dir))
    return rounded(scoring.bias_summary(bias))


def _bias_extremes(spark, sf_dir):
    return rounded(scoring.bias_extremes(scoring.stock_bias(log_pred(spark, sf_dir))))


def _bias_scored(spark, sf_dir):
    """Stock effects learned on the training snapshots of each fold, applied to its test snapshots."""
    rows = with_folds(log_pred(spark, sf_dir), assignment(spark, sf_dir)).drop("inner")
    bias = scoring.stock_bias(rows.where("split = 'train'"), ["fold"])
    return rounded(scoring.apply_stock_bias(rows.where("split = 'test'"), bias, ["fold"]).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), *log_metrics("pred_log_rv", "true_log_rv", 1e-8)))


def _spread_weights(spark, sf_dir):
    return rounded(scoring.spread_weights(log_pred(spark, sf_dir)))


def _combined(spark, sf_dir):
    pred = log_pred(spark, sf_dir)
    return rounded(scoring.combined_loss(pred, scoring.spread_weights(pred)))


SPREAD_SQL = GARCH_SQL + """,
sp AS (SELECT stock_id, count(*) AS n, stddev_pop(pred_log_rv) AS ps, stddev_pop(true_log_rv) AS ts FROM gl WHERE true_log_rv <> 0 AND true_log_rv > -10 GROUP BY stock_id),
sw AS (SELECT stock_id, CASE WHEN n >= 3 AND ts >= 1e-6 THEN least(greatest(2 - ps / ts, 25e-2), 4) ELSE 1 END AS w FROM (SELECT DISTINCT stock_id FROM gl) s LEFT JOIN sp USING (stock_id)),
spread_w AS (SELECT stock_id, w / (SELECT avg(w) FROM sw) AS spread_weight FROM sw)"""

_T, _PR = "greatest(exp(true_log_rv), 1e-8)", "greatest(exp(greatest(least(pred_log_rv, 5), -20)), 1e-8)"
COMBINED_SQL = with_sql(SPREAD_SQL, f""",
live AS (SELECT stock_id, count(*) AS n, sum(power(({_PR} - {_T}) / {_T}, 2)) AS sq, sum({_T} / {_PR} - ln({_T} / {_PR}) - 1) AS ql,
  stddev_samp(greatest(least(pred_log_rv, 5), -20)) AS ps, stddev_samp(true_log_rv) AS ts FROM gl WHERE true_log_rv <> 0 AND true_log_rv > -10 GROUP BY stock_id),
one AS (SELECT sqrt(sum(sq) / sum(n)) AS rmspe, sum(ql) / sum(n) AS qlike,
  coalesce(avg(CASE WHEN n >= 3 THEN spread_weight * power(greatest(ts - ps, 0), 2) END), 0) AS spread FROM live JOIN spread_w USING (stock_id))
SELECT {rs('rmspe', 'qlike', 'spread')}, {r('3e-1 * rmspe + 5e-1 * qlike + 2e-1 * spread', 'loss')} FROM one""")


_LB = [f"lb_{b}" for b in range(8)]


def _bucket_har_rows(spark, sf_dir):
    """The tensor is written once: fitting and scoring both read it."""
    tensor = cut_lineage(rv.bucket_tensor(book_runs(spark, sf_dir)))
    return scoring.bucket_har_forecast(with_folds(tensor, assignment(spark, sf_dir)).drop("inner"), keys=["fold"])


def _bucket_har(spark, sf_dir):
    return rounded(_bucket_har_rows(spark, sf_dir))


def _blend_rows(spark, sf_dir):
    har_side = _bucket_har_rows(spark, sf_dir).where("split = 'train'").withColumnRenamed("pred_log_rv", "a")
    other = log_pred(spark, sf_dir).select("stock_id", "time_id", F.col("pred_log_rv").alias("b"))
    return har_side.join(other, ["stock_id", "time_id"])


def _blend_grid(spark, sf_dir):
    return rounded(scoring.blend_weight_grid(_blend_rows(spark, sf_dir), "a", "b", keys=["fold"]))


def _blend_best(spark, sf_dir):
    rows = cut_lineage(_blend_rows(spark, sf_dir))
    grid = scoring.best_blend(scoring.blend_weight_grid(rows, "a", "b", keys=["fold"]), ["fold"])
    return rounded(grid.select("fold", F.lit("qlike_grid").alias("method"), "weight").unionByName(
        scoring.least_squares_blend(rows, "a", "b", keys=["fold"]).select("fold", F.lit("least_squares").alias("method"), "weight")))


BUCKET_HAR_SQL = TENSOR_SQL + folds_sql("dense") + f""",
tw AS (SELECT fo.fold, f.stock_id, f.time_id, fo.split, CAST(CAST(t.y AS FLOAT) AS DOUBLE) AS true_log_rv,
  {', '.join(f'ln(greatest(CAST(max(CASE WHEN f.bucket = {b} THEN CAST(f.rv AS FLOAT) END) AS DOUBLE), 1e-4)) AS lb_{b}' for b in range(8))}
  FROM feats f JOIN target t ON t.stock_id = f.stock_id AND t.time_id = f.time_id JOIN folds fo ON fo.time_id = f.time_id
  GROUP BY fo.fold, f.stock_id, f.time_id, fo.split, t.y),
sums AS (SELECT {ols_sums_sql(['fold'], _LB, 'true_log_rv')} FROM tw WHERE split = 'train' GROUP BY fold),
{ols_solve_sql('sums', ['fold'], 8, 'coef')},
bh AS (SELECT fold, stock_id, time_id, split, true_log_rv, b_0 + {' + '.join(f'b_{b + 1} * lb_{b}' for b in range(8))} AS pred_log_rv FROM tw JOIN coef USING (fold))"""

BLEND_SQL = BUCKET_HAR_SQL + returns_sql("dense", "ret2") + f""",
cl AS (SELECT *, CASE WHEN lr IS NULL THEN 0 ELSE greatest(least(lr, 5e-2), -5e-2) END AS c FROM ret2),
sc AS (SELECT stock_id, time_id, ln(greatest({rv_sql(None, 480, 'c')} * sqrt(120 / 480e0), 1e-12) + 1e-12) AS b FROM cl GROUP BY stock_id, time_id),
bl AS (SELECT fold, true_log_rv AS t, pred_log_rv AS a, b FROM bh JOIN sc USING (stock_id, time_id) WHERE split = 'train'),
grid AS (SELECT fold, w, avg(greatest(exp(t), 1e-8) / greatest(exp(m), 1e-8) - ln(greatest(exp(t), 1e-8) / greatest(exp(m), 1e-8)) - 1) AS q FROM (
  SELECT fold, s / 100e0 AS w, t, greatest(least(s / 100e0 * a + (1 - s / 100e0) * b, 5), -20) AS m FROM bl, (SELECT unnest(range(101)) AS s) g) z GROUP BY fold, w)"""


# ---- booster ----------------------------------------------------------------------

# Rounds and patience as published: early stopping decides. Tree settings come from the search, in every fold.
BOOST = boost.BoostParams(rounds=5000, patience=50, max_bins=64)
FOLDS, TRIALS, PARTS = range(5), 10, 5
FEATURES = boost.FINAL_FEATURES
_tuned: dict[tuple[str, str, int], tuple] = {}


def boost_table(spark, sf_dir):
    features = wide.add_zscores(wide.wide_features(book_runs(spark, sf_dir)))
    return boost.training_table(cut_lineage(features), cut_lineage(stock_oof(spark, sf_dir)))


def tuned(spark, sf_dir):
    """(training table with inner parts, result rows of the search, best settings by fold, bin edges), made once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, tables_dropped())
    if key not in _tuned:
        parts = assignment(spark, sf_dir).where("split = 'train'").select("fold", "time_id", "inner")
        table = cut_lineage(boost_table(spark, sf_dir).join(parts, ["fold", "time_id"], "left"))
        train = table.where("split = 'train'")
        edges = lockstep.bin_edges(train, FEATURES, BOOST.max_bins)
        _tuned[key] = table, *lockstep.search(train, FOLDS, FEATURES, BOOST, TRIALS, PARTS, edges), edges
    return _tuned[key]


def _boosters(spark, sf_dir):
    table, _, best, edges = tuned(spark, sf_dir)
    models, _ = lockstep.fit_folds(table.where("split = 'train'"), best, FEATURES, edges)
    return table.where("split = 'test'"), models, edges


def _boost_all(spark, sf_dir):
    test, models, edges = _boosters(spark, sf_dir)
    return boost.with_predictions(lockstep.forecast(test.drop("split", "inner"), models, FEATURES, edges))


def _boost_predictions(spark, sf_dir):
    return rounded(_boost_all(spark, sf_dir))


def _boost_report(spark, sf_dir):
    return rounded(boost.stacker_report(_boost_all(spark, sf_dir)))


def _importance(spark, sf_dir):
    return rounded(lockstep.importance(*_boosters(spark, sf_dir)[:2], FEATURES, tuned(spark, sf_dir)[3]))


def _search(spark, sf_dir):
    return rounded(tuned(spark, sf_dir)[1])


QUERIES: dict[str, Entry] = {
    "fold_assignment": (_fold_table, with_sql(FOLDS_SQL, 'SELECT fold, time_id, split, inner_part AS "inner" FROM folds')),
    "fold_sizes_and_overlap": (_fold_sizes, with_sql(FOLDS_SQL, "SELECT fold, split, count(*) AS n_snapshots, 0 AS n_overlap FROM folds GROUP BY fold, split")),
    "fold_membership_rows": (_split_rows, with_sql(FOLDS_SQL, """SELECT time_id, count(*) AS n_quotes FROM raw
  WHERE time_id IN (SELECT time_id FROM folds WHERE fold = 2 AND split = 'test') GROUP BY time_id""")),
    "row_holdout_split": (_holdout, with_sql(HAR_SQL + HOLDOUT_CTE, "SELECT stock_id, time_id, split FROM held")),
    "kfold_parts_by_row": (_kfold(False), with_sql(HAR_SQL + _parts_cte(False), "SELECT stock_id, time_id, part FROM parted")),
    "kfold_parts_by_stock": (_kfold(True), with_sql(HAR_SQL + _parts_cte(True), "SELECT stock_id, time_id, part FROM parted")),
    "har_fold_coefficients": (_coefficients, _coefficients_sql()),
    "har_fold_metrics": (_fold_metrics, with_sql(FOLD_FIT_SQL, f"SELECT fold, split, model, count(*) AS n_rows, {M3} FROM long_scored GROUP BY fold, split, model")),
    "har_fold_summary": (_fold_summary, FOLD_SUMMARY_SQL),
    "har_forecast_errors": (_error_columns, ERRORS_SQL),
    "har_holdout_metrics": (_holdout_metrics, HOLDOUT_SQL),
    "har_cross_validation_by_row": (_cv(False), _cv_sql(False)),
    "har_cross_validation_by_stock": (_cv(True), _cv_sql(True)),
    "stock_har_out_of_fold": (_stock_oof, with_sql(OOF_SQL, f"""SELECT time_id, stock_id, fold, split, {rs('log_rv_fut', 'har_pred_log_rv')},
  {r('exp(har_pred_log_rv)', 'har_pred_rv')}, {r('log_rv_fut - har_pred_log_rv', 'har_residual')} FROM oof""")),
    "training_sample_weights": (_weights, WEIGHTS_SQL),
    "scaled_rv_baseline": (_baseline, with_sql(GARCH_SQL, f"""SELECT stock_id, time_id, {rs('true_rv', 'pred_rv', 'true_log_rv', 'pred_log_rv', 'anchor_log_rv')},
  {r('true_log_rv - anchor_log_rv', 'true_log_rv_diff')}, {r('pred_log_rv - anchor_log_rv', 'pred_log_rv_diff')}, 1 AS fallback, n_input_obs, n_future_obs FROM gl""")),
    "scaled_rv_fold_report": (_baseline_report, with_sql(GARCH_FOLD_SQL, f"""SELECT fold, count(*) AS rows_eval, {r('100', 'fallback_pct')},
  {_m7('pred_log_rv', 'garch_')}, {_m7('anchor_log_rv', 'last_')} FROM gt GROUP BY fold""")),
    "scaled_rv_per_stock": (_baseline_per_stock, with_sql(GARCH_FOLD_SQL, f"SELECT fold, stock_id, count(*) AS n_rows, {_m7('pred_log_rv')} FROM gt GROUP BY fold, stock_id HAVING count(*) >= 5")),
    "fold_metric_aggregate": (_fold_aggregate, with_sql(GARCH_FOLD_SQL, f""", fm AS (SELECT fold, {_m7_raw('pred_log_rv', 'garch_')} FROM gt GROUP BY fold)
""" + " UNION ALL ".join(f"SELECT 'garch_{m}' AS metric, {r(f'avg(garch_{m})', 'mean')}, {r(f'stddev_pop(garch_{m})', 'std')} FROM fm" for m in _SEVEN))),
    "garch_grid_forecast": (_garch_grid, GARCH_GRID_SQL),
    "garch_predictions": (_garch, None),
    "garch_fold_report": (_garch_report, None),
    "garch_per_stock": (_garch_per_stock, None),
    "tier_report": (_tiers, with_sql(GARCH_SQL, f"""SELECT CASE WHEN exp(true_log_rv) < 0.001 THEN 'Very low (<0.001)' WHEN exp(true_log_rv) < 0.005 THEN 'Low (0.001-0.005)'
  WHEN exp(true_log_rv) < 0.02 THEN 'Mid (0.005-0.02)' ELSE 'High (>=0.02)' END AS tier, count(*) AS n_rows, {_m7('pred_log_rv', eps='1e-8')} FROM gl GROUP BY 1 HAVING count(*) >= 10""")),
    "dispersion_ratio": (_dispersion, with_sql(GARCH_SQL, f"SELECT {r('stddev_pop(pred_log_rv)', 'pred_std')}, {r('stddev_pop(true_log_rv)', 'true_std')}, {r('stddev_pop(pred_log_rv) / stddev_pop(true_log_rv)', 'spread_ratio')} FROM gl")),
    "stock_extremes": (_extremes, with_sql(GARCH_SQL, f""", e AS (SELECT stock_id, count(*) AS n_rows, sqrt(avg(power((exp(pred_log_rv) - exp(true_log_rv)) / exp(true_log_rv), 2))) * 100 AS m
  FROM gl GROUP BY stock_id HAVING count(*) >= 5)
SELECT * FROM (SELECT 'best' AS side, stock_id, n_rows, {r('m', 'rmspe_pct')} FROM e ORDER BY m, stock_id LIMIT 5) a
UNION ALL SELECT * FROM (SELECT 'worst', stock_id, n_rows, {r('m', 'rmspe_pct')} FROM e ORDER BY m DESC, stock_id LIMIT 5) b""")),
    "har_fold_dropped_rows": (_fold_dropped, with_sql(FOLDS_HAR_SQL, """SELECT fold, split, count(CASE WHEN target_rv_480_600 > 1e-4 THEN 1 END) AS kept_rows,
  count(CASE WHEN NOT target_rv_480_600 > 1e-4 THEN 1 END) AS dropped_rows FROM model_rows JOIN folds USING (time_id) GROUP BY fold, split""")),
    "test_fold_tiers": (_fold_tiers, with_sql(GARCH_FOLD_SQL, f"""SELECT fold, CASE WHEN exp(true_log_rv) < 0.001 THEN 'Very low (<0.001)' WHEN exp(true_log_rv) < 0.005 THEN 'Low (0.001-0.005)'
  WHEN exp(true_log_rv) < 0.02 THEN 'Mid (0.005-0.02)' ELSE 'High (>=0.02)' END AS tier, count(*) AS n_rows, {_m7('pred_log_rv', eps='1e-8')} FROM gt GROUP BY 1, 2 HAVING count(*) >= 10""")),
    "test_fold_dispersion": (_fold_dispersion, with_sql(GARCH_FOLD_SQL, f"""SELECT fold, {r('stddev_pop(pred_log_rv)', 'pred_std')}, {r('stddev_pop(true_log_rv)', 'true_std')},
  {r('stddev_pop(pred_log_rv) / stddev_pop(true_log_rv)', 'spread_ratio')} FROM gt GROUP BY fold""")),
    "test_fold_extremes": (_fold_extremes, with_sql(GARCH_FOLD_SQL, f""", e AS (SELECT fold, stock_id, count(*) AS n_rows, {_m7_items('pred_log_rv', '1e-12', 'true_log_rv')['rmspe_pct']} AS m
  FROM gt GROUP BY fold, stock_id HAVING count(*) >= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m, stock_id) AS up, row_number() OVER (PARTITION BY fold ORDER BY m DESC, stock_id) AS down FROM e)
SELECT fold, 'best' AS side, stock_id, n_rows, {r('m', 'rmspe_pct')} FROM k WHERE up <= 5 UNION ALL SELECT fold, 'worst', stock_id, n_rows, {r('m', 'rmspe_pct')} FROM k WHERE down <= 5""")),
    "stock_fixed_effects": (_bias, with_sql(GARCH_SQL, f"SELECT stock_id, {r('avg(true_log_rv - pred_log_rv)', 'stock_bias')} FROM gl GROUP BY stock_id")),
    "stock_effect_summary": (_bias_summary, with_sql(GARCH_SQL, f""", b AS (SELECT avg(true_log_rv - pred_log_rv) AS b FROM gl GROUP BY stock_id)
SELECT {r('avg(b)', 'mean')}, {r('stddev_pop(b)', 'std')}, {r('min(b)', 'min')}, {r('max(b)', 'max')} FROM b""")),
    "stock_effect_extremes": (_bias_extremes, with_sql(GARCH_SQL, f""", b AS (SELECT stock_id, avg(true_log_rv - pred_log_rv) AS b FROM gl GROUP BY stock_id)
SELECT * FROM (SELECT stock_id, {r('b', 'stock_bias')}, 'largest' AS side FROM b ORDER BY b DESC, stock_id LIMIT 3) x
UNION ALL SELECT * FROM (SELECT stock_id, {r('b', 'stock_bias')}, 'smallest' FROM b ORDER BY b, stock_id LIMIT 3) y""")),
    "spread_weights": (_spread_weights, with_sql(SPREAD_SQL, f"SELECT stock_id, {r('spread_weight')} FROM spread_w")),
    "combined_loss": (_combined, COMBINED_SQL),
    "stock_effect_scored": (_bias_scored, with_sql(GARCH_SQL + folds_sql("dense"), f""", z AS (SELECT g.*, f.fold, f.split FROM gl g JOIN folds f USING (time_id)),
b AS (SELECT fold, stock_id, avg(true_log_rv - pred_log_rv) AS b FROM z WHERE split = 'train' GROUP BY fold, stock_id),
y AS (SELECT fold, true_log_rv, pred_log_rv + coalesce(b, 0) AS p FROM z LEFT JOIN b USING (fold, stock_id) WHERE split = 'test')
SELECT fold, count(*) AS n_rows, {_m7('p', eps='1e-8')} FROM y GROUP BY fold""")),
    "bucket_har_forecast": (_bucket_har, with_sql(BUCKET_HAR_SQL, f"SELECT fold, stock_id, time_id, split, {rs('true_log_rv', 'pred_log_rv')} FROM bh")),
    "blend_weight_grid": (_blend_grid, with_sql(BLEND_SQL, f"SELECT fold, {r('w', 'weight')}, {r('q', 'qlike')} FROM grid")),
    "blend_best_weight": (_blend_best, with_sql(BLEND_SQL, f"""SELECT fold, 'qlike_grid' AS method, {r('min_by(w, (q, w))', 'weight')} FROM grid GROUP BY fold
UNION ALL SELECT fold, 'least_squares', {r('least(greatest(sum((t - b) * (a - b)) / sum(power(a - b, 2)), 0), 1)', 'weight')} FROM bl GROUP BY fold""")),
    "boost_predictions": (_boost_predictions, None),
    "boost_report": (_boost_report, None),
    "boost_permutation_importance": (_importance, None),
    "boost_parameter_search": (_search, None),
}
