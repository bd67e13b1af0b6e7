"""Book, realised-volatility, bucket and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.functions import columns as vc
from voltide.functions.losses import volatility_metrics
from voltide.operators import har, rv, wide
from voltide.operators.book import clipped_returns, with_book_columns
from voltide.operators.folds import distinct_snapshots
from voltide.sources.readers import limit_stocks
from voltide.workload.base import (
    COLS_SQL, DENSE_SQL, HAR_COLUMNS, HAR_SQL, RAW_SQL, Entry, book_raw, book_runs, book_sec, har_features_sql, qlike_sql, r,
    returns_sql, rounded, rs, rv_sql, sqpct_sql, with_sql,
)

KEYS = "stock_id, time_id"


def naive_scores(spark, sf_dir):
    """Naive two-minute forecast of the target RV, scored per stock."""
    rows = har.drop_small_targets(har.features_from_raw(book_raw(spark, sf_dir)))
    return rounded(rows.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(har.TARGET).alias("mean_target_rv"),
        *volatility_metrics(har.TARGET, har.naive_last_two_minutes())))


def _naive_sql() -> str:
    t, p = "target_rv_480_600", "greatest(rv_360_480, 1e-4)"
    return with_sql(HAR_SQL, f"""
SELECT stock_id, count(*) AS n_rows, {r(f'avg({t})', 'mean_target_rv')}, {r(f'sqrt(avg({sqpct_sql(t, p, "1e-12")}))', 'rmspe')},
       {r(f'avg({qlike_sql(t, p, "1e-12")})', 'qlike')}, {r(f'avg(power({t} - {p}, 2))', 'mse')}
FROM har WHERE {t} > 1e-4 GROUP BY stock_id""")


def _derived(spark, sf_dir, wap):
    return rounded(with_book_columns(book_raw(spark, sf_dir), wap))


def _prefixed(spark, sf_dir):
    text = book_raw(spark, sf_dir).select(F.concat(F.lit("stock_"), F.col("stock_id")).alias("raw_id"))
    return text.groupBy(vc.stock_number("raw_id").alias("stock_id")).agg(F.count(F.lit(1)).alias("n_quotes"))


def _second_buckets(spark, sf_dir):
    rows = book_raw(spark, sf_dir).where("seconds_in_bucket < 480")
    return rows.groupBy(vc.second_bucket(60, 8).alias("b60"), vc.second_bucket(120, 4).alias("b120"),
                        vc.second_bucket(30, 16).alias("b30")).agg(F.count(F.lit(1)).alias("n"))


def _clipped(spark, sf_dir):
    return rounded(clipped_returns(with_book_columns(book_raw(spark, sf_dir))).select(
        "stock_id", "time_id", "seconds_in_bucket", "log_return"))


WINDOWS = [("rv_in", 0, 480), ("rv_last", 360, 480), ("rv_fut", 480, 600)]


def _rv_windows(edge):
    def run(spark, sf_dir):
        return rounded(rv.realised_vol(book_runs(spark, sf_dir), WINDOWS, edge=edge, first=0.0))
    return run


def _rv_windows_sql(edge: str) -> str:
    lr = {"include": lambda lo: "coalesce(lr, 0)", "exclude": lambda lo: f"CASE WHEN prev_s >= {lo} THEN coalesce(lr, 0) ELSE 0 END"}[edge]
    cols = ", ".join(r(rv_sql(lo, hi, f"({lr(lo)})"), name) for name, lo, hi in WINDOWS)
    return with_sql(DENSE_SQL + returns_sql("dense", "ret"), f"SELECT {KEYS}, {cols} FROM ret GROUP BY {KEYS}")


def _regimes(spark, sf_dir):
    labelled = rv.bucket_rv(book_runs(spark, sf_dir)).select(
        vc.regime_label("rv_target").alias("regime"), vc.tier_label("rv_target").alias("tier"))
    return labelled.groupBy("regime", "tier").agg(F.count(F.lit(1)).alias("n"))


def _case_labels(labels) -> str:
    cuts = ("0.001", "0.005", "0.02")
    return "CASE " + " ".join(f"WHEN rv_target < {c} THEN '{lab}'" for c, lab in zip(cuts, labels)) + f" ELSE '{labels[-1]}' END"


BUCKET_RV_SQL = DENSE_SQL + returns_sql("dense", "ret", eps="1e-10") + f""",
bucket_rv AS (SELECT {KEYS}, {', '.join(f"{rv_sql(lo, hi, 'coalesce(lr, 0)')} AS {n}" for n, lo, hi in rv.BUCKETS_120)}
  FROM ret GROUP BY {KEYS})"""

_FEATS = """sum(coalesce(lr, 0)) AS log_ret_sum, sqrt(sum(coalesce(lr, 0) * coalesce(lr, 0))) AS rv, avg(wap) AS wap_mean,
  avg(bid_ask_spread) AS spread_mean, sum(total_volume) AS volume_sum, avg(price_spread) AS pspread_mean,
  avg(depth_imbalance) AS dimbal_mean"""
TENSOR_SQL = DENSE_SQL + returns_sql("dense", "ret", eps="1e-8") + f""",
feats AS (SELECT {KEYS}, CAST(floor(seconds_in_bucket / 60) AS INTEGER) AS bucket, {_FEATS}
  FROM ret WHERE seconds_in_bucket < 480 GROUP BY {KEYS}, floor(seconds_in_bucket / 60)),
target AS (SELECT {KEYS}, ln(greatest({rv_sql(480, None, 'coalesce(lr, 0)')}, 1e-4)) AS y FROM ret
  WHERE seconds_in_bucket >= 480 GROUP BY {KEYS})"""


def _flat_tensor(tensor):
    cells = tensor.select("time_id", "stock_id", "y", F.posexplode("x").alias("bucket", "f"))
    return rounded(cells.select("time_id", "stock_id", "y", "bucket",
                                *[F.col("f")[i].alias(n) for i, n in enumerate(rv.BUCKET_FEATURES)]))


def _tensor(spark, sf_dir):
    return _flat_tensor(rv.bucket_tensor(book_runs(spark, sf_dir)))


def _dense_tensor(spark, sf_dir):
    tensor = rv.bucket_tensor(book_runs(spark, sf_dir))
    return _flat_tensor(rv.dense_tensor(tensor))


def _weights(spark, sf_dir):
    w = rv.sampling_weights(rv.log_target_rv(book_runs(spark, sf_dir)))
    return rounded(w)


def _tensor_sql(dense: bool) -> str:
    feats = [f"CAST(f.{n} AS FLOAT)" for n in rv.BUCKET_FEATURES]
    if not dense:
        cols = ", ".join(r(e, n) for e, n in zip(feats, rv.BUCKET_FEATURES))
        return with_sql(TENSOR_SQL, f"""SELECT f.time_id, f.stock_id, f.bucket, {r('CAST(t.y AS FLOAT)', 'y')}, {cols}
FROM feats f JOIN target t ON t.stock_id = f.stock_id AND t.time_id = f.time_id""")
    cols = ", ".join(r(f"coalesce({e}, 0)", n) for e, n in zip(feats, rv.BUCKET_FEATURES))
    return with_sql(TENSOR_SQL, f"""SELECT g.time_id, g.stock_id, CAST(g.b AS INTEGER) AS bucket, {r('coalesce(CAST(t.y AS FLOAT), 0)', 'y')}, {cols}
FROM (SELECT a.time_id, b.stock_id, c.b FROM (SELECT DISTINCT time_id FROM feats) a, (SELECT DISTINCT stock_id FROM feats) b,
      (SELECT unnest(range(8)) AS b) c) g
LEFT JOIN feats f
  ON f.stock_id = g.stock_id AND f.time_id = g.time_id AND f.bucket = g.b
LEFT JOIN target t ON t.stock_id = g.stock_id AND t.time_id = g.time_id""")


WEIGHTS_SQL = with_sql(TENSOR_SQL, f""", w AS (SELECT time_id, 1 / greatest(avg(exp(y)), 1e-8) AS w FROM target WHERE y > -10 GROUP BY time_id),
c AS (SELECT time_id, least(w, (SELECT quantile_cont(w, 0.99) FROM w)) AS w FROM w)
SELECT time_id, {r('w / (SELECT sum(w) FROM c)', 'weight')} FROM c""")


def _har_dense(spark, sf_dir):
    return rounded(har.features_from_preprocessed(book_runs(spark, sf_dir)))


HAR_DENSE_SQL = DENSE_SQL + """,
norm AS (SELECT stock_id, time_id, seconds_in_bucket, greatest(wap, 1e-12) AS wap, greatest(bid_ask_spread, 0) AS bid_ask_spread,
  greatest(total_volume, 0) AS total_volume, depth_imbalance AS volume_imbalance FROM dense)""" + returns_sql("norm", "ret") \
    + har_features_sql("norm", "ret", "har")


def _har_model(spark, sf_dir):
    rows = har.model_rows(har.features_from_raw(book_raw(spark, sf_dir)))
    return rounded(rows.select("stock_id", "time_id", *har.FULL_FEATURES, har.LOG_TARGET))


def _filter_report(spark, sf_dir):
    return har.target_filter_report(har.add_model_columns(har.features_from_raw(book_raw(spark, sf_dir))))


# ---- wide features ----------------------------------------------------------------

def _wide(spark, sf_dir):
    return wide.wide_features(book_runs(spark, sf_dir))


def _wide_part(cols):
    def run(spark, sf_dir):
        return rounded(_wide(spark, sf_dir).select("stock_id", "time_id", *cols))
    return run


def _zscores(spark, sf_dir):
    z = wide.add_zscores(_wide(spark, sf_dir))
    return rounded(z.select("stock_id", "time_id", *[f"{c}_zscore" for c in ZSCORED]))


# Features whose z-score is well conditioned in the test view (others divide by rounding noise).
ZSCORED = list(wide.SELECTED_FEATURES)


def _moment(x: str, k: int) -> str:
    return f"sum(power({x} - m_{x}, {k}))"


def _skew_sql(x: str) -> str:
    n, m2, m3 = "count(*)", _moment(x, 2), _moment(x, 3)
    return (f"CASE WHEN {n} < 3 OR {m2} < 1e-14 THEN 0 ELSE sqrt({n} * ({n} - 1)) / ({n} - 2) * ({m3} / {n}) / power({m2} / {n}, 15e-1) END")


def _kurt_sql(x: str) -> str:
    n, m2, m4 = "CAST(count(*) AS DOUBLE)", _moment(x, 2), _moment(x, 4)
    g2 = f"(({m4} / {n}) / power({m2} / {n}, 2) - 3)"
    return (f"CASE WHEN {n} < 4 OR {m2} < 1e-14 THEN 0 ELSE ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * {g2} + 6) END")


def _wide_sql() -> str:
    g = "(PARTITION BY stock_id, time_id)"
    o = "(PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket)"
    ac = ("CASE WHEN count({x}_lag) >= 2 THEN count({x}_lag) * covar_pop({x}, {x}_lag) / (sqrt(count({x}_lag) * var_pop({x}_lag) "
          "* count({x}_lag) * var_pop(CASE WHEN {x}_lag IS NOT NULL THEN {x} END)) + 1e-10) ELSE 0 END")
    std = "CASE WHEN count(*) > 1 THEN sqrt(sum(power({0} - m_{0}, 2)) / (count(*) - 1)) END"
    cov_s = "sum((sec - m_sec) * (spread - m_spread))"
    corr = corr_centred("spread", "abs_r", "r_lag IS NOT NULL")
    lags = ", ".join(f"coalesce({rv_sql(30 * i, 30 * (i + 1), 'r')}, 0) AS rv_lag_{i + 1}" for i in range(16))
    bkts = ", ".join(f"coalesce({rv_sql(120 * b, 120 * (b + 1), 'r')}, 0) AS past_rv_bkt{b}" for b in range(4))
    order = sorted(range(1, 17), key=str)
    mid = 7.5
    slope = " + ".join(f"(log_rv_lag_{i} - log_rv_long) * ({k - mid:.1e})" for k, i in enumerate(order))
    var = " + ".join(f"power(log_rv_lag_{i} - log_rv_long, 2)" for i in range(1, 17))

    def mean(ids):
        return "(" + " + ".join(f"log_rv_lag_{i}" for i in ids) + f") / {len(ids)}e0"

    lg = lambda x: f"ln(greatest({x}, 1e-10))"
    lf = lambda x: f"ln(greatest({x}, 1e-4))"
    over = lambda a, b: f"coalesce({a}, 0) / greatest({b}, 1e-10)"
    return DENSE_SQL + f""",
w0 AS (SELECT stock_id, time_id, seconds_in_bucket, CAST(seconds_in_bucket AS DOUBLE) AS sec, bid_ask_spread AS spread, total_volume AS vol,
  ln(greatest(wap, 1e-10)) AS lw, ln(greatest(bid_ask_spread, 1e-10)) AS lspread, ln(greatest(total_volume, 1)) AS lvol
  FROM dense WHERE seconds_in_bucket < 480),
w1 AS (SELECT *, coalesce(lw - lag(lw) OVER {o}, 0) AS r, row_number() OVER {o} AS rn FROM w0),
w2 AS (SELECT *, abs(r) AS abs_r, CASE WHEN rn > 1 THEN lag(r) OVER {o} END AS r_lag, CASE WHEN rn > 1 THEN abs(lag(r) OVER {o}) END AS abs_r_lag FROM w1),
w3 AS (SELECT *, avg(r) OVER {g} AS m_r, avg(spread) OVER {g} AS m_spread, avg(vol) OVER {g} AS m_vol, avg(sec) OVER {g} AS m_sec,
  avg(lspread) OVER {g} AS m_lspread, avg(lvol) OVER {g} AS m_lvol,
  avg(CASE WHEN r_lag IS NOT NULL THEN spread END) OVER {g} AS mc_spread, avg(CASE WHEN r_lag IS NOT NULL THEN abs_r END) OVER {g} AS mc_abs_r FROM w2),
w4 AS (SELECT stock_id, time_id, CAST(count(*) AS DOUBLE) AS n, sum(r * r) AS sum_sq, avg(abs_r * abs_r_lag) AS adj,
  {rv_sql(None, None, 'r')} AS rv_full, coalesce({rv_sql(420, None, 'r')}, 0) AS rv_last60, coalesce({rv_sql(360, None, 'r')}, 0) AS rv_last120,
  coalesce({rv_sql(240, None, 'r')}, 0) AS rv_last240, coalesce({rv_sql(None, 240, 'r')}, 0) AS rv_first_half,
  coalesce({rv_sql(240, None, 'r')}, 0) AS rv_second_half, {lags}, {bkts},
  avg(r) AS ret_mean, {std.format('r')} AS ret_std, {_skew_sql('r')} AS ret_skew, {_kurt_sql('r')} AS ret_kurt, min(r) AS ret_min, max(r) AS ret_max,
  quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS ret_iqr, avg(abs_r) AS abs_ret_mean, max(abs_r) AS abs_ret_max,
  quantile_cont(abs_r, 0.95) AS abs_ret_p95, {ac.format(x='r')} AS ret_ac1, {ac.format(x='abs_r')} AS abs_ret_ac1,
  avg(spread) AS spread_mean, {std.format('spread')} AS spread_std, max(spread) AS spread_max, min(spread) AS spread_min,
  avg(lspread) AS log_spread_mean, {std.format('lspread')} AS log_spread_std, avg(CASE WHEN seconds_in_bucket >= 420 THEN spread END) AS spread_last60,
  {_skew_sql('spread')} AS spread_skew,
  CASE WHEN count(*) >= 3 AND sum(power(sec - m_sec, 2)) >= 1e-10 THEN {cov_s} / sum(power(sec - m_sec, 2)) ELSE 0 END AS spread_trend,
  avg(CASE WHEN seconds_in_bucket < 60 THEN spread END) AS first60, CASE WHEN count(*) >= 4 THEN {corr} ELSE 0 END AS spread_rv_corr,
  avg(vol) AS vol_mean, {std.format('vol')} AS vol_std, sum(vol) AS vol_sum, max(vol) AS vol_max, avg(lvol) AS log_vol_mean,
  {std.format('lvol')} AS log_vol_std, avg(CASE WHEN seconds_in_bucket >= 420 THEN vol END) AS vol_last60, {_skew_sql('vol')} AS vol_skew,
  sum(sign(r) * vol) AS ofi, sum(r * vol) AS vwr, sum(spread * vol) AS vws,
  coalesce(sum(CASE WHEN r > 0 THEN r * r END), 0) AS up2, coalesce(sum(CASE WHEN r < 0 THEN r * r END), 0) AS down2
  FROM w3 GROUP BY stock_id, time_id),
w5 AS (SELECT *, {', '.join(f'{lg(f"rv_lag_{i}")} AS log_rv_lag_{i}' for i in range(1, 17))}, pi() / 2 * adj * n AS bpv2 FROM w4),
w6 AS (SELECT *, {mean((14, 15, 16))} AS log_rv_short, {mean(range(9, 17))} AS log_rv_medium, {mean(range(1, 17))} AS log_rv_long,
  greatest(sum_sq - bpv2, 0) AS jump2, {over('rv_last60', 'rv_full')} AS rv_ratio_60, {over('rv_last120', 'rv_full')} AS rv_ratio_120 FROM w5),
widef AS (SELECT *, {', '.join(f'{lg(c)} AS log_{c}' for c in ('rv_full', 'rv_last60', 'rv_last120', 'rv_last240', 'rv_first_half', 'rv_second_half'))},
  {over('rv_last240', 'rv_full')} AS rv_ratio_240, {over('rv_second_half', 'rv_first_half')} AS rv_ratio_halves,
  {lg('rv_ratio_60')} AS log_rv_ratio_60, {lg('rv_ratio_120')} AS log_rv_ratio_120, rv_second_half - rv_first_half AS rv_accel,
  sqrt(bpv2) AS bpv, sqrt(jump2) AS jump, {lf('bpv2')} AS log_bpv, {lf('jump2')} AS log_jump, jump2 / (sum_sq + 1e-10) AS jump_ratio,
  CASE WHEN jump2 > 0 THEN 1e0 ELSE 0e0 END AS jump_frac, ret_max - ret_min AS ret_range, spread_max - spread_min AS spread_range,
  {over('spread_std', 'spread_mean')} AS spread_cv, {over('spread_last60', 'spread_mean')} AS spread_ratio,
  coalesce(spread_last60, 0) / greatest(coalesce(first60, 1e-10), 1e-10) AS spread_change_ratio,
  {over('vol_std', 'vol_mean')} AS vol_cv, {over('vol_last60', 'vol_mean')} AS vol_ratio, {over('vwr', 'vol_sum')} AS vwap_ret,
  {over('vws', 'vol_sum')} AS vw_spread, sqrt(up2) AS rv_up, sqrt(down2) AS rv_down, {lf('sqrt(up2)')} AS log_rv_up, {lf('sqrt(down2)')} AS log_rv_down,
  (up2 - down2) / (up2 + down2 + 1e-10) AS rv_asymmetry, log_rv_short - log_rv_long AS har_short_long, log_rv_short - log_rv_medium AS har_short_med,
  log_rv_medium - log_rv_long AS har_med_long, ({slope}) / (340 + 1e-10) AS rv_trend_slope, sqrt(({var}) / 15) AS rv_lag_std,
  {', '.join(f'{lf(f"past_rv_bkt{b}")} AS past_log_rv_bkt{b}' for b in range(4))}, {over('past_rv_bkt3', 'past_rv_bkt0')} AS rv_trend_ratio FROM w6)"""


def corr_centred(x: str, y: str, cond: str) -> str:
    c = f"CASE WHEN {cond} THEN {{}} END"
    sxx = f"sum({c.format(f'power({x} - mc_{x}, 2)')})"
    syy = f"sum({c.format(f'power({y} - mc_{y}, 2)')})"
    sxy = f"sum({c.format(f'({x} - mc_{x}) * ({y} - mc_{y})')})"
    return f"CASE WHEN {sxx} > 1e-20 AND {syy} > 1e-20 THEN {sxy} / sqrt({sxx} * {syy}) ELSE 0 END"


WIDE_SQL = _wide_sql()


def _wide_part_sql(cols) -> str:
    return with_sql(WIDE_SQL, f"SELECT {KEYS}, {', '.join(r(f'coalesce({c}, 0)', c) for c in cols)} FROM widef")


def _zscore_sql() -> str:
    w = "(PARTITION BY time_id)"
    z = ", ".join(r(f"coalesce((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER {w}) / greatest(stddev_samp(coalesce({c}, 0)) OVER {w}, 1e-10), 0)",
                    f"{c}_zscore") for c in ZSCORED)
    return with_sql(WIDE_SQL, f"SELECT {KEYS}, {z} FROM widef")


def _clusters(spark, sf_dir):
    stocks = book_raw(spark, sf_dir).groupBy("stock_id").agg(F.count(F.lit(1)).alias("n_quotes"))
    shifted = stocks.select((F.col("stock_id") * 7 + 13).alias("stock_id"), "n_quotes")
    return wide.add_cluster(shifted).select("stock_id", "n_quotes", "cluster_id")


def _clusters_sql() -> str:
    pairs = ", ".join(f"({s}, {c})" for s, c in wide.STOCK_CLUSTERS.items())
    return with_sql(RAW_SQL, f""", dim(sid, cluster_id) AS (VALUES {pairs})
SELECT q.stock_id, q.n_quotes, dim.cluster_id FROM (SELECT stock_id * 7 + 13 AS stock_id, count(*) AS n_quotes FROM raw GROUP BY stock_id) q
LEFT JOIN dim ON dim.sid = q.stock_id""")


def _deviation(spark, sf_dir):
    table = rv.log_target_rv(book_runs(spark, sf_dir))
    return rounded(wide.deviation_from_mean(table, "y", "deviation"))


QUERIES: dict[str, Entry] = {
    "naive_rv_scores_by_stock": (naive_scores, _naive_sql()),
    "book_columns_level1": (
        lambda s, d: _derived(s, d, "level1"),
        with_sql(COLS_SQL, f"SELECT {KEYS}, seconds_in_bucket, {rs('wap', 'bid_ask_spread', 'total_volume', 'price_spread', 'depth_imbalance', 'volume_imbalance')} FROM cols")),
    "book_columns_best_level": (
        lambda s, d: _derived(s, d, "best").select("stock_id", "time_id", "seconds_in_bucket", "wap"),
        with_sql(COLS_SQL, f"SELECT {KEYS}, seconds_in_bucket, {r('wap_best', 'wap')} FROM cols")),
    "book_gap_fill": (
        lambda s, d: rounded(book_sec(s, d)),
        with_sql(DENSE_SQL, f"SELECT {KEYS}, seconds_in_bucket, {rs('wap', 'bid_ask_spread', 'total_volume', 'price_spread', 'depth_imbalance')} FROM dense")),
    "stock_id_normalise": (_prefixed, with_sql(RAW_SQL, "SELECT stock_id, count(*) AS n_quotes FROM raw GROUP BY stock_id")),
    "time_buckets": (_second_buckets, with_sql(RAW_SQL, """SELECT least(seconds_in_bucket // 60, 7) AS b60, least(seconds_in_bucket // 120, 3) AS b120,
  least(seconds_in_bucket // 30, 15) AS b30, count(*) AS n FROM raw WHERE seconds_in_bucket < 480 GROUP BY 1, 2, 3""")),
    "first_stocks": (
        lambda s, d: limit_stocks(book_raw(s, d), 3).groupBy("stock_id").agg(F.count(F.lit(1)).alias("n_quotes")),
        with_sql(RAW_SQL, "SELECT stock_id, count(*) AS n_quotes FROM raw WHERE stock_id IN (SELECT DISTINCT stock_id FROM raw ORDER BY stock_id LIMIT 3) GROUP BY stock_id")),
    "distinct_snapshots": (lambda s, d: distinct_snapshots(book_raw(s, d)), with_sql(RAW_SQL, "SELECT DISTINCT time_id FROM raw")),
    "returns_clipped": (_clipped, with_sql(
        COLS_SQL + returns_sql("cols", "ret"),
        f"SELECT {KEYS}, seconds_in_bucket, {r('coalesce(CASE WHEN lr IS NOT NULL THEN greatest(least(lr, 5e-2), -5e-2) END, 0)', 'log_return')} FROM ret")),
    "rv_windows_edge_included": (_rv_windows("include"), _rv_windows_sql("include")),
    "rv_windows_edge_excluded": (_rv_windows("exclude"), _rv_windows_sql("exclude")),
    "bucket_rv_120s": (lambda s, d: rounded(rv.bucket_rv(book_runs(s, d))),
                       with_sql(BUCKET_RV_SQL, f"SELECT {KEYS}, {rs(*[n for n, _, _ in rv.BUCKETS_120])} FROM bucket_rv")),
    "regime_and_tier_counts": (_regimes, with_sql(BUCKET_RV_SQL, f"""SELECT {_case_labels(vc.REGIMES)} AS regime, {_case_labels(vc.TIERS)} AS tier,
  count(*) AS n FROM bucket_rv GROUP BY 1, 2""")),
    "bucket_features_60s": (lambda s, d: rounded(rv.bucket_features(book_runs(s, d))),
                            with_sql(TENSOR_SQL, f"SELECT {KEYS}, bucket, {rs(*rv.BUCKET_FEATURES)} FROM feats")),
    "log_target_rv": (lambda s, d: rounded(rv.log_target_rv(book_runs(s, d))), with_sql(TENSOR_SQL, f"SELECT {KEYS}, {r('y')} FROM target")),
    "bucket_tensor": (_tensor, _tensor_sql(False)),
    "bucket_tensor_dense": (_dense_tensor, _tensor_sql(True)),
    "snapshot_sampling_weights": (_weights, WEIGHTS_SQL),
    "har_features_raw": (lambda s, d: rounded(har.features_from_raw(book_raw(s, d))),
                         with_sql(HAR_SQL, f"SELECT {KEYS}, {rs(*HAR_COLUMNS)} FROM har")),
    "har_features_dense": (_har_dense, with_sql(HAR_DENSE_SQL, f"SELECT {KEYS}, {rs(*HAR_COLUMNS)} FROM har")),
    "har_model_rows": (_har_model, with_sql(HAR_SQL, f"SELECT {KEYS}, {rs(*har.FULL_FEATURES, har.LOG_TARGET)} FROM har_rows")),
    "har_target_filter_report": (_filter_report, with_sql(HAR_SQL, """SELECT count(CASE WHEN target_rv_480_600 > 1e-4 THEN 1 END) AS kept_rows,
  count(CASE WHEN NOT target_rv_480_600 > 1e-4 THEN 1 END) AS dropped_rows FROM model_rows""")),
    "wide_block_features": (_wide_part(wide.BLOCK_FEATURES), _wide_part_sql(wide.BLOCK_FEATURES)),
    "wide_interval_features": (_wide_part(wide.LAG_FEATURES), _wide_part_sql(wide.LAG_FEATURES)),
    "wide_bucket_features": (_wide_part(wide.BUCKET_FEATURES), _wide_part_sql(wide.BUCKET_FEATURES)),
    "cross_section_zscores": (_zscores, _zscore_sql()),
    "stock_clusters": (_clusters, _clusters_sql()),
    "cross_section_deviation": (_deviation, with_sql(
        TENSOR_SQL, f"SELECT {KEYS}, {r('y')}, {r('y - avg(y) OVER (PARTITION BY time_id)', 'deviation')} FROM target")),
}
