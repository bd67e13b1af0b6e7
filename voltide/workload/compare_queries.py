"""Model comparison, co-movement and exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltide.functions.distributions import two_sided_normal_text, upper_binomial_text, upper_f_text, upper_normal_text
from voltide.functions.losses import qlike_text as qlike_term
from voltide.operators import compare, eda, interaction, rv
from voltide.operators.book import with_book_columns
from voltide.session import cut_lineage
from voltide.sources.readers import limit_stocks
from voltide.workload.base import (
    COLS_SQL, DENSE_SQL, MODELS, PRED_SQL, Entry, book_raw, book_runs, book_sec, corr_sql, ols_solve_sql, ols_sums_sql, predictions, hash_sql,
    qlike_sql, r, returns_sql, rounded, rs, rv_sql, sqpct_sql, with_sql,
)

KEYS = "stock_id, time_id"


def aligned(spark, sf_dir):
    return compare.align(predictions(spark, sf_dir), MODELS)


def _aligned(spark, sf_dir):
    return rounded(aligned(spark, sf_dir))


def _consistency(spark, sf_dir):
    """Actual RV of the second model is taken from the dense book, so it differs from the first's."""
    long = predictions(spark, sf_dir)
    other = rv.bucket_rv(book_runs(spark, sf_dir)).select("stock_id", "time_id", F.col("rv_target").alias("other_rv"))
    mixed = long.join(other, ["stock_id", "time_id"]).withColumn(
        "actual_rv", F.when(F.col("model") == "scaled", F.col("other_rv")).otherwise(F.col("actual_rv"))).drop("other_rv")
    return rounded(compare.actual_consistency(mixed, MODELS))


CONSISTENCY_SQL = with_sql(PRED_SQL + f""",
dense AS ({DENSE_SQL.split('dense AS (', 1)[1].rsplit(')', 1)[0]})""" + returns_sql("dense", "dret", eps="1e-10") + f""",
other AS (SELECT stock_id, time_id, {rv_sql(480, 600, 'coalesce(lr, 0)')} AS rv FROM dret GROUP BY stock_id, time_id)""", f"""
SELECT 'scaled' AS model, {r('max(abs(a.actual_rv - o.rv))', 'max_diff')}, max(abs(a.actual_rv - o.rv)) < 1e-6 AS consistent
FROM aligned a JOIN other o USING (stock_id, time_id)
UNION ALL SELECT 'ols', 0e0, TRUE""")


def _counts(spark, sf_dir):
    return compare.row_count_report(predictions(spark, sf_dir), "naive")


def _pooled(spark, sf_dir):
    return rounded(compare.pooled_metrics(compare.long_predictions(aligned(spark, sf_dir), MODELS)))


_RM, _QL = f"sqrt(avg({sqpct_sql('actual_rv', 'predicted_rv')}))", f"avg({qlike_sql('actual_rv', 'predicted_rv')})"


def _intervals(spark, sf_dir):
    metrics = compare.pooled_metrics(compare.long_predictions(aligned(spark, sf_dir), MODELS))
    return rounded(compare.confidence_intervals(metrics))


# Two-sided 95 % Student t quantile with 4 degrees of freedom (five folds).
_T4 = "2.7764451051977987e0"


def _dm(spark, sf_dir):
    return compare.diebold_mariano(aligned(spark, sf_dir), MODELS, block_rows=64)


def _dm_stats(spark, sf_dir):
    return rounded(_dm(spark, sf_dir).select("metric", "model_1", "model_2", "dm_stat"))


def _dm_ctes() -> str:
    rows, loss = [], {"RMSPE": sqpct_sql, "QLIKE": qlike_sql}
    for metric, fn in loss.items():
        for a, b in (("naive", "scaled"), ("naive", "ols"), ("scaled", "ols")):
            rows.append(f"SELECT '{metric}' AS metric, '{a}' AS model_1, '{b}' AS model_2, i, "
                        f"{fn('actual_rv', f'pred_{a}')} - {fn('actual_rv', f'pred_{b}')} AS d FROM ix")
    return f""",
ix AS (SELECT *, row_number() OVER (ORDER BY fold, stock_id, time_id) AS i FROM aligned),
d AS ({' UNION ALL '.join(rows)}),
st AS (SELECT metric, model_1, model_2, count(*) AS n, avg(d) AS m, var_samp(d) AS g0, floor(power(count(*), 1e0 / 3)) AS h FROM d GROUP BY ALL),
lg AS (SELECT a.metric, a.model_1, a.model_2, b.i - a.i AS k, covar_samp(a.d, b.d) AS c FROM d a JOIN d b
  ON a.metric = b.metric AND a.model_1 = b.model_1 AND a.model_2 = b.model_2 AND b.i > a.i AND b.i - a.i <= (SELECT max(h) FROM st) GROUP BY ALL),
w AS (SELECT l.metric, l.model_1, l.model_2, sum((1 - l.k / (s.h + 1)) * l.c) AS w FROM lg l JOIN st s USING (metric, model_1, model_2) GROUP BY ALL),
dm AS (SELECT metric, model_1, model_2, m / sqrt(greatest((g0 + 2 * w) / n, 1e-10)) AS z FROM st JOIN w USING (metric, model_1, model_2)),
tests AS (SELECT *, {two_sided_normal_text('z', duck=True)} AS p_value FROM dm),
{_bh_ctes('metric')}"""


def _stars_sql(p: str) -> str:
    return f"CASE WHEN {p} < 1e-3 THEN '***' WHEN {p} < 1e-2 THEN '**' WHEN {p} < 5e-2 THEN '*' ELSE '' END"


def _bh_ctes(family: str) -> str:
    """Step-up correction of tests.p_value within each family, as corrected.pc."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY p_value) AS k, count(*) OVER (PARTITION BY {family}) AS m FROM tests),
corrected AS (SELECT *, least(1, min(p_value * m / k) OVER (PARTITION BY {family} ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pc FROM ranked)"""


def _dm_row_sql(where: str = "true") -> str:
    return with_sql(PRED_SQL + _dm_ctes(), f"""SELECT metric, model_1, model_2, {r('z', 'dm_stat')}, {r('p_value')}, {_stars_sql('p_value')} AS sig,
  {r('pc', 'p_value_corrected')}, pc <= 5e-2 AS rejected_corrected, {_stars_sql('pc')} AS sig_corrected FROM corrected WHERE {where}""")


def _dm_full(spark, sf_dir):
    return rounded(compare.pair_winner(compare.benjamini_hochberg(_dm(spark, sf_dir))))


def _dm_lookup(spark, sf_dir):
    tests = compare.benjamini_hochberg(_dm(spark, sf_dir))
    return rounded(compare.lookup_pair(tests, "QLIKE", "ols", "naive"))


def _bh(spark, sf_dir):
    """Correction of the p values of each model's QLIKE against the naive one's, by fold: families are folds."""
    rows = aligned(spark, sf_dir)
    loss = lambda m: qlike_term("actual_rv", f"pred_{m}", 1e-10)
    d = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(f"{loss('naive')} - {loss(m)}").alias("d")) for m in MODELS if m != "naive"]))
    z = F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d")))
    tests = rows.select("fold", d.alias("t")).select("fold", "t.*").groupBy("fold", "model").agg(z.alias("z"))
    return rounded(compare.benjamini_hochberg(tests.withColumn("p_value", F.expr(two_sided_normal_text("z"))), "fold"))


BH_SQL = with_sql(PRED_SQL, f""", d AS ({' UNION ALL '.join(f"SELECT fold, '{m}' AS model, {qlike_sql('actual_rv', 'pred_naive')} - {qlike_sql('actual_rv', f'pred_{m}')} AS d FROM aligned" for m in ('scaled', 'ols'))}),
zs AS (SELECT fold, model, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS z FROM d GROUP BY fold, model),
tests AS (SELECT *, {two_sided_normal_text('z', duck=True)} AS p_value FROM zs),
{_bh_ctes('fold')}
SELECT fold, model, {rs('z', 'p_value')}, {r('pc', 'p_value_corrected')}, pc <= 5e-2 AS rejected_corrected, {_stars_sql('pc')} AS sig_corrected FROM corrected""")


# ---- co-movement ------------------------------------------------------------------

def panel(spark, sf_dir):
    """Live log-RV cells, written once."""
    live = interaction.live_panel(rv.target_rv_panel(book_runs(spark, sf_dir)))
    return cut_lineage(live)


EDA_RV_SQL = DENSE_SQL + returns_sql("dense", "ret") + f""",
eda_rv AS (SELECT stock_id, time_id, {rv_sql(480, 600, '(CASE WHEN prev_s >= 480 THEN coalesce(lr, 0) ELSE 0 END)')} AS rv FROM ret GROUP BY stock_id, time_id),
rvl AS (SELECT *, CASE WHEN rv > 0 THEN ln(rv) END AS log_rv FROM eda_rv)"""
PANEL_SQL = EDA_RV_SQL + """,
panel AS (SELECT time_id, stock_id, log_rv FROM rvl WHERE log_rv > -18)"""


def covered_cte(share: str) -> str:
    return f""",
cov AS (SELECT * FROM panel WHERE stock_id IN (SELECT stock_id FROM panel GROUP BY stock_id
  HAVING count(*) >= (SELECT count(DISTINCT time_id) FROM panel) * {share}))"""


COMPLETE_CTE = """,
comp AS (SELECT * FROM cov WHERE time_id IN (SELECT time_id FROM cov GROUP BY time_id HAVING count(*) = (SELECT count(DISTINCT stock_id) FROM cov)))"""


def pairs_cte(src: str, out: str) -> str:
    return f""",
{out} AS (SELECT a.stock_id AS stock_a, b.stock_id AS stock_b, count(*) AS n, {corr_sql('a.log_rv', 'b.log_rv')} AS corr
  FROM {src} a JOIN {src} b ON a.time_id = b.time_id AND a.stock_id < b.stock_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


LAGGED_CTE = f""",
tix AS (SELECT time_id, row_number() OVER (ORDER BY time_id) AS t FROM (SELECT DISTINCT time_id FROM comp) q),
ci AS (SELECT c.*, t.t FROM comp c JOIN tix t USING (time_id)),
lagp AS (SELECT a.stock_id AS stock_a, b.stock_id AS stock_b, count(*) AS n, {corr_sql('a.log_rv', 'b.log_rv')} AS corr
  FROM ci a JOIN ci b ON b.t = a.t + 1 AND a.stock_id < b.stock_id GROUP BY 1, 2 HAVING count(*) >= 10)"""


def _pairs(spark, sf_dir):
    return rounded(interaction.correlation_pairs(panel(spark, sf_dir)))


def _matrix(spark, sf_dir):
    return rounded(interaction.correlation_matrix(interaction.correlation_pairs(panel(spark, sf_dir))))


def _corr_summary(spark, sf_dir):
    return rounded(interaction.correlation_summary(interaction.correlation_pairs(panel(spark, sf_dir))))


def _covered(spark, sf_dir):
    p = panel(spark, sf_dir)
    done = interaction.complete_snapshots(interaction.well_covered(p, 0.7))
    return rounded(done)


def _lead_lag(spark, sf_dir):
    return rounded(interaction.lead_lag(panel(spark, sf_dir)))


def _granger(spark, sf_dir):
    p = panel(spark, sf_dir)
    return interaction.granger(p, interaction.random_pairs(p, 200))


def _granger_stats(spark, sf_dir):
    return rounded(_granger(spark, sf_dir).select("pair", "cause", "effect", "n", "f_stat", "p_value"))


def _granger_summary(spark, sf_dir):
    return rounded(interaction.granger_summary(_granger(spark, sf_dir)))


GRANGER_CTE = f""",
sl AS (SELECT list(stock_id ORDER BY stock_id) AS s FROM (SELECT DISTINCT stock_id FROM panel) q),
dr AS (SELECT i AS pair, s[CAST({hash_sql('(i * 7919 + 13)', 42)} % len(s) AS INTEGER) + 1] AS cause,
  s[CAST({hash_sql('(i * 6271 + 101)', 43)} % len(s) AS INTEGER) + 1] AS effect FROM (SELECT unnest(range(600)) AS i) g, sl),
pr AS (SELECT * FROM dr WHERE cause <> effect ORDER BY pair LIMIT 200),
bo AS (SELECT p.pair, y.time_id, y.log_rv AS y, x.log_rv AS x, row_number() OVER (PARTITION BY p.pair ORDER BY y.time_id) AS i
  FROM pr p JOIN panel y ON y.stock_id = p.effect JOIN panel x ON x.stock_id = p.cause AND x.time_id = y.time_id),
lg AS (SELECT a.pair, a.y, b.y AS y1, b.x AS x1 FROM bo a JOIN bo b ON a.pair = b.pair AND b.i = a.i - 3),
su AS (SELECT {ols_sums_sql(['pair'], ['y1', 'x1'], 'y')} FROM lg GROUP BY pair),
sr AS (SELECT {ols_sums_sql(['pair'], ['y1'], 'y')} FROM lg GROUP BY pair),
{ols_solve_sql('su', ['pair'], 2, 'u')},
{ols_solve_sql('sr', ['pair'], 1, 'w')},
gr AS (SELECT p.pair, p.cause, p.effect, u.n, ((w.rss - u.rss) / 3e0) / (u.rss / (u.n - 3)) AS f_stat, u.n - 3e0 AS df2
  FROM pr p JOIN u USING (pair) JOIN w USING (pair) WHERE u.n >= 10 AND u.rss > 0),
gp AS (SELECT *, {upper_f_text('f_stat', '3e0', 'df2', duck=True)} AS p_value FROM gr),
gs AS (SELECT count(*) AS n_pairs_tested, count(CASE WHEN p_value < 5e-2 THEN 1 END) AS n_significant, avg(CASE WHEN p_value < 5e-2 THEN 1e0 ELSE 0 END) AS pct_significant,
  avg(p_value) AS mean_pvalue, quantile_cont(p_value, 0.5) AS median_pvalue, 5e-2 AS expected_by_chance FROM gp WHERE p_value IS NOT NULL),
gb AS (SELECT *, {upper_binomial_text('n_significant', 'n_pairs_tested', '5e-2', duck=True)} AS binom_pvalue FROM gs)"""
GRANGER_SQL = with_sql(PANEL_SQL + GRANGER_CTE, f"SELECT pair, cause, effect, n, {rs('f_stat', 'p_value')} FROM gp")
PERMUTED_CTE = f""",
drawn AS (SELECT p, time_id, stock_id, log_rv, row_number() OVER (PARTITION BY p, time_id ORDER BY stock_id) AS place,
  row_number() OVER (PARTITION BY p, time_id ORDER BY {hash_sql('(p * 1000003 * 1009 + time_id * 1009 + stock_id)', 5)}, stock_id) AS draw
  FROM cov, (SELECT unnest(range(100)) AS p) g),
moved AS (SELECT a.p, a.time_id, a.stock_id, b.log_rv FROM drawn a JOIN drawn b ON a.p = b.p AND a.time_id = b.time_id AND a.place = b.draw),
nullp AS (SELECT a.p, {corr_sql('a.log_rv', 'b.log_rv')} AS corr FROM moved a JOIN moved b ON a.p = b.p AND a.time_id = b.time_id AND a.stock_id < b.stock_id
  GROUP BY a.p, a.stock_id, b.stock_id HAVING count(*) >= 2),
nullm AS (SELECT p, avg(corr) AS m FROM nullp GROUP BY p),
pm AS (SELECT (SELECT avg(corr) FROM realp) AS real_mean_corr, avg(m) AS null_mean_corr, stddev_pop(m) AS null_std_corr, count(*) AS n_permutations FROM nullm),
pz AS (SELECT *, real_mean_corr - null_mean_corr AS excess_corr, (real_mean_corr - null_mean_corr) / (null_std_corr + 1e-10) AS z_score FROM pm),
pp AS (SELECT *, {upper_normal_text('z_score', duck=True)} AS p_value FROM pz)"""


def _permutation(spark, sf_dir):
    return rounded(interaction.permutation_test(panel(spark, sf_dir), 100))


def _verdict(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(interaction.verdict(
        interaction.correlation_summary(interaction.correlation_pairs(p)),
        interaction.granger_summary(interaction.granger(p, interaction.random_pairs(p, 200))),
        interaction.permutation_test(p, 100), interaction.lead_lag(p)))


def _peers(spark, sf_dir):
    return rounded(interaction.peer_graph(panel(spark, sf_dir), 10))


def _peer_average(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(interaction.peer_average(p, interaction.peer_graph(p, 10)))


PEERS_CTE = """,
bothp AS (SELECT stock_a AS src, stock_b AS dst, corr FROM pairs WHERE corr IS NOT NULL UNION ALL SELECT stock_b, stock_a, corr FROM pairs WHERE corr IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY corr DESC, dst) AS "rank" FROM bothp),
peers AS (SELECT src, dst, corr, "rank", exp(corr) / sum(exp(corr)) OVER (PARTITION BY src) AS weight FROM rk WHERE "rank" <= 10)"""


# ---- exploratory ------------------------------------------------------------------

def eda_book(spark, sf_dir):
    return book_runs(spark, sf_dir).withColumnRenamed("depth_imbalance", "volume_imbalance")


def quotes(spark, sf_dir):
    """Sparse quotes with derived columns; some prices are missing."""
    return with_book_columns(book_raw(spark, sf_dir)).drop("volume_imbalance").withColumnRenamed("depth_imbalance", "volume_imbalance")


Q = eda.FEATURES
QUOTES_SQL = COLS_SQL + """,
q AS (SELECT stock_id, time_id, seconds_in_bucket, wap, bid_ask_spread, total_volume, price_spread, depth_imbalance AS volume_imbalance FROM cols)"""
LONG_CTE = ",\nlong AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM q" for c in Q) + ")"


def _describe(spark, sf_dir):
    return rounded(eda.describe(quotes(spark, sf_dir), Q))


DESCRIBE_SQL = with_sql(QUOTES_SQL + LONG_CTE, f"""SELECT feature, count(v) AS "count", {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')},
  {', '.join(r(f'quantile_cont(v, {p})', n) for n, p in eda.PERCENTILES.items())} FROM long GROUP BY feature""")


def _hist(spark, sf_dir):
    return rounded(eda.clipped_histogram(quotes(spark, sf_dir), Q, 100).select("feature", "bin", "n", "density"))


HIST_SQL = with_sql(QUOTES_SQL + LONG_CTE, f""", b AS (SELECT feature, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM long
  GROUP BY feature),
h AS (SELECT feature, lo, hi, CAST(least(floor((least(greatest(v, lo), hi) - lo) / ((hi - lo) / 100e0)), 99) AS INTEGER) AS bin FROM long JOIN b USING (feature) WHERE v IS NOT NULL),
c AS (SELECT feature, bin, count(*) AS n, max(lo) AS lo, max(hi) AS hi FROM h GROUP BY feature, bin)
SELECT feature, bin, n, {r('CAST(n AS DOUBLE) / (sum(n) OVER (PARTITION BY feature) * ((hi - lo) / 100e0))', 'density')} FROM c""")


def rv_panel(spark, sf_dir):
    return rv.target_rv_panel(book_runs(spark, sf_dir))


def _log_hist(spark, sf_dir):
    return rounded(eda.log_spaced_histogram(rv_panel(spark, sf_dir), "rv"))


LOG_HIST_SQL = with_sql(EDA_RV_SQL, f""", p AS (SELECT log10(rv) AS v FROM rvl WHERE rv > 0), b AS (SELECT floor(min(v)) AS lo, ceil(max(v)) AS hi FROM p),
h AS (SELECT lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 79e0)), 78) AS INTEGER) AS bin FROM p, b)
SELECT bin, {r('power(10e0, max(lo) + (max(hi) - max(lo)) / 79e0 * bin)', 'left_edge')}, count(*) AS n FROM h GROUP BY bin""")


def _volume_hist(spark, sf_dir):
    volume = quotes(spark, sf_dir).select(F.log1p("total_volume").alias("v"))
    return rounded(eda.range_histogram(volume, "v", 100).select("bin", "left_edge", "n", "density"))


def _log_rv_hist(spark, sf_dir):
    """Between the 0.1 % tails, 120 edges."""
    return rounded(eda.clipped_histogram(rv_panel(spark, sf_dir), ["log_rv"], 119, 0.001).select("bin", "left_edge", "n", "density"))


def _rv_hist(spark, sf_dir):
    panel = rv_panel(spark, sf_dir).where("log_rv IS NOT NULL").select(F.exp("log_rv").alias("v"))
    return rounded(eda.capped_histogram(panel, "v", 80).select("bin", "left_edge", "n", "density"))


def _hist_sql(ctes: str, values: str, lo: str, hi: str, bins: int) -> str:
    """Equal-width bins of ``values`` (column v) between two aggregates of it."""
    return with_sql(ctes, f""", hv AS ({values}), hb AS (SELECT {lo} AS lo, {hi} AS hi FROM hv),
hh AS (SELECT lo, hi, CAST(least(floor((least(greatest(v, lo), hi) - lo) / ((hi - lo) / {bins}e0)), {bins - 1}) AS INTEGER) AS bin FROM hv, hb),
hc AS (SELECT bin, count(*) AS n, max(lo) AS lo, max(hi) AS hi FROM hh GROUP BY bin)
SELECT bin, {r(f'lo + (hi - lo) / {bins}e0 * bin', 'left_edge')}, n, {r(f'CAST(n AS DOUBLE) / (sum(n) OVER () * ((hi - lo) / {bins}e0))', 'density')} FROM hc""")


def _kde(spark, sf_dir):
    return rounded(eda.kernel_density(rv_panel(spark, sf_dir), "log_rv"))


KDE_SQL = with_sql(EDA_RV_SQL, f""", b AS (SELECT quantile_cont(log_rv, 0.001) AS lo, quantile_cont(log_rv, 0.999) AS hi FROM rvl WHERE log_rv IS NOT NULL),
c AS (SELECT lo, hi, least(greatest(log_rv, lo), hi) AS v FROM rvl, b WHERE log_rv IS NOT NULL), s AS (SELECT stddev_samp(v) * 1e-1 AS h FROM c),
g AS (SELECT p AS point, lo + (hi - lo) * p / 499e0 AS x, v, h FROM c, s, (SELECT unnest(range(500)) AS p) z)
SELECT CAST(point AS INTEGER) AS point, {r('max(x)', 'x')}, {r('avg(exp(-5e-1 * power((x - v) / h, 2)) / (h * sqrt(2 * pi())))', 'density')} FROM g GROUP BY point""")


def _samples(spark, sf_dir):
    return eda.input_window_samples(eda_book(spark, sf_dir))


SAMPLE_FEATURES = [f"{c}_{m}" for c in Q for m in ("mean", "std")] + ["log_rv_input"]
SAMPLES_SQL = EDA_RV_SQL + f""",
inr AS (SELECT * , CASE WHEN seconds_in_bucket > 0 THEN coalesce(lr, 0) ELSE 0 END AS c FROM ret WHERE seconds_in_bucket < 480),
smp AS (SELECT stock_id, time_id, {', '.join(f"avg({s}) AS {c}_mean, stddev_samp({s}) AS {c}_std" for c, s in zip(Q, ['wap', 'bid_ask_spread', 'total_volume', 'price_spread', 'depth_imbalance']))},
  ln(greatest(sqrt(sum(c * c)), 1e-12)) AS log_rv_input FROM inr GROUP BY stock_id, time_id)"""


def _feature_corr(spark, sf_dir):
    # Written apart, so that no task sorts the book for both sides of the join.
    merged = cut_lineage(_samples(spark, sf_dir)).join(rv_panel(spark, sf_dir).select("stock_id", "time_id", "log_rv"), ["stock_id", "time_id"]).where("log_rv IS NOT NULL")
    # Features are rounded before ranking so that ties are the same in every engine.
    merged = merged.select("stock_id", "time_id", *[F.round(c, 9).alias(c) for c in (*CORR_FEATURES, "log_rv")])
    return rounded(interaction.feature_target_correlations(merged, CORR_FEATURES))


CORR_FEATURES = SAMPLE_FEATURES


def _feature_corr_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, stock_id, time_id, round({f}, 9) AS x, round(log_rv, 9) AS y FROM m" for f in CORR_FEATURES)
    return with_sql(SAMPLES_SQL, f""", m AS (SELECT * FROM smp JOIN rvl USING (stock_id, time_id) WHERE log_rv IS NOT NULL), l AS ({long}),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2e0 AS ry FROM l WHERE x IS NOT NULL)
SELECT feature, count(*) AS n, {r(corr_sql('x', 'y'), 'pearson')}, {r(corr_sql('rx', 'ry'), 'spearman')} FROM k GROUP BY feature HAVING count(*) >= 50""")


def _hash_sample(spark, sf_dir):
    s = eda.hash_sample(quotes(spark, sf_dir), ["stock_id", "time_id", "seconds_in_bucket"], 5000)
    return rounded(s.select("stock_id", "time_id", "seconds_in_bucket", "wap"))


def _profile(spark, sf_dir):
    return rounded(eda.second_profile(limit_stocks(eda_book(spark, sf_dir), 20)))


PROFILE_SQL = with_sql(DENSE_SQL + returns_sql("dense", "ret"), f"""SELECT seconds_in_bucket, {', '.join(r(f'avg({s})', f'{c}_mean') + ', ' + r(f'stddev_samp({s})', f'{c}_std')
  for c, s in zip(Q, ['wap', 'bid_ask_spread', 'total_volume', 'price_spread', 'depth_imbalance']))}, {r('stddev_samp(coalesce(lr, 0))', 'lr_std')}
FROM ret WHERE stock_id IN (SELECT DISTINCT stock_id FROM ret ORDER BY stock_id LIMIT 20) GROUP BY seconds_in_bucket""")


VERDICT_SQL = with_sql(PANEL_SQL + GRANGER_CTE + covered_cte("5e-1") + pairs_cte("cov", "realp") + PERMUTED_CTE + covered_cte("7e-1").replace("cov AS", "cov7 AS")
                       + COMPLETE_CTE.replace("cov", "cov7") + LAGGED_CTE, f""",
v AS (SELECT (SELECT avg(corr) FROM realp) AS mean_corr, (SELECT pct_significant FROM gb) AS pct_significant, (SELECT binom_pvalue < 5e-2 FROM gb) AS interaction_significant,
  (SELECT z_score FROM pp) AS z_score, (SELECT p_value < 5e-2 FROM pp) AS spatial_significant,
  (SELECT avg(corr) FROM lagp WHERE corr IS NOT NULL) AS lagged_mean_corr, (SELECT avg(corr) > 5e-2 FROM lagp WHERE corr IS NOT NULL) AS predictive_value),
n AS (SELECT *, CAST(mean_corr > 3e-1 AS INTEGER) + CAST(interaction_significant AS INTEGER) + CAST(spatial_significant AS INTEGER) + CAST(predictive_value AS INTEGER) AS n_positive FROM v)
SELECT {rs('mean_corr', 'pct_significant', 'z_score', 'lagged_mean_corr')}, interaction_significant, spatial_significant, predictive_value, n_positive,
  CASE WHEN n_positive >= 3 THEN 'strong' WHEN n_positive >= 2 THEN 'moderate' ELSE 'weak' END AS verdict FROM n""")


QUERIES: dict[str, Entry] = {
    "predictions_aligned": (_aligned, with_sql(PRED_SQL, f"SELECT {KEYS}, fold, {rs('actual_rv', 'pred_naive', 'pred_scaled', 'pred_ols')} FROM aligned")),
    "actual_consistency": (_consistency, CONSISTENCY_SQL),
    "prediction_row_counts": (_counts, with_sql(PRED_SQL, """, c AS (SELECT model, CAST(fold AS VARCHAR) AS fold, count(*) AS n_rows FROM long_pred GROUP BY model, fold
  UNION ALL SELECT model, 'all', count(*) FROM long_pred GROUP BY model)
SELECT c.model, c.fold, c.n_rows, c.n_rows - coalesce(b.n_rows, 0) AS vs_base FROM c LEFT JOIN c b ON b.fold = c.fold AND b.model = 'naive'""")),
    "pooled_and_fold_metrics": (_pooled, with_sql(PRED_SQL, f"""SELECT model, CAST(fold AS VARCHAR) AS fold, count(*) AS n_rows, {r(_RM, 'rmspe')}, {r(_QL, 'qlike')} FROM long_aligned GROUP BY model, fold
UNION ALL SELECT model, 'all', count(*), {r(_RM, 'rmspe')}, {r(_QL, 'qlike')} FROM long_aligned GROUP BY model""")),
    "metric_confidence_intervals": (_intervals, with_sql(PRED_SQL, f""", f AS (SELECT model, fold, {_RM} AS a, {_QL} AS b FROM long_aligned GROUP BY model, fold),
l AS (SELECT model, 'RMSPE' AS metric, a AS v FROM f UNION ALL SELECT model, 'QLIKE', b FROM f)
SELECT model, metric, count(*) AS n_folds, {r('avg(v)', 'mean')}, {r(f'avg(v) - {_T4} * stddev_samp(v) / sqrt(count(*))', 'ci_low')},
  {r(f'avg(v) + {_T4} * stddev_samp(v) / sqrt(count(*))', 'ci_high')} FROM l GROUP BY model, metric""")),
    "diebold_mariano_statistics": (_dm_stats, with_sql(PRED_SQL + _dm_ctes(), f"SELECT metric, model_1, model_2, {r('z', 'dm_stat')} FROM dm")),
    "diebold_mariano_corrected": (_dm_full, _dm_row_sql().replace(" FROM corrected", ", CASE WHEN z > 0 THEN model_2 ELSE model_1 END AS winner FROM corrected")),
    "diebold_mariano_pair": (_dm_lookup, _dm_row_sql("metric = 'QLIKE' AND least(model_1, model_2) = 'naive' AND greatest(model_1, model_2) = 'ols'")),
    "benjamini_hochberg": (_bh, BH_SQL),
    "correlation_pairs": (_pairs, with_sql(PANEL_SQL + covered_cte("5e-1") + pairs_cte("cov", "pairs"), f"SELECT stock_a, stock_b, n, {r('corr')} FROM pairs")),
    "correlation_matrix": (_matrix, with_sql(PANEL_SQL + covered_cte("5e-1") + pairs_cte("cov", "pairs"), f"""SELECT stock_a, stock_b, {r('corr')} FROM pairs
UNION ALL SELECT stock_b, stock_a, {r('corr')} FROM pairs UNION ALL SELECT DISTINCT s, s, 1e0 FROM (SELECT stock_a AS s FROM pairs UNION SELECT stock_b FROM pairs) q""")),
    "correlation_summary": (_corr_summary, with_sql(PANEL_SQL + covered_cte("5e-1") + pairs_cte("cov", "pairs"), f"""SELECT count(*) AS n_pairs, {r('avg(corr)', 'mean_corr')}, {r('stddev_pop(corr)', 'std_corr')},
  {r('avg(CASE WHEN corr > 0 THEN 1e0 ELSE 0 END)', 'pct_positive')}, {r('avg(CASE WHEN corr > 3e-1 THEN 1e0 ELSE 0 END)', 'pct_gt_03')}, {r('avg(CASE WHEN corr > 5e-1 THEN 1e0 ELSE 0 END)', 'pct_gt_05')},
  {r('quantile_cont(corr, 0.5)', 'median_corr')}, (SELECT count(DISTINCT s) FROM (SELECT stock_a AS s FROM pairs UNION ALL SELECT stock_b FROM pairs) z) AS n_stocks,
  CASE WHEN avg(corr) > 3e-1 THEN 'strong' WHEN avg(corr) > 1e-1 THEN 'moderate' ELSE 'weak' END AS finding FROM pairs WHERE corr IS NOT NULL""")),
    "complete_panel": (_covered, with_sql(PANEL_SQL + covered_cte("7e-1") + COMPLETE_CTE, f"SELECT time_id, stock_id, {r('log_rv')} FROM comp")),
    "lead_lag_correlation": (_lead_lag, with_sql(PANEL_SQL + covered_cte("7e-1") + COMPLETE_CTE + pairs_cte("comp", "pairs") + LAGGED_CTE, f""",
a AS (SELECT avg(corr) AS sm, stddev_pop(corr) AS ss FROM pairs WHERE corr IS NOT NULL),
b AS (SELECT avg(corr) AS lm, stddev_pop(corr) AS ls, avg(CASE WHEN abs(corr) > 1e-1 THEN 1e0 ELSE 0 END) AS sg FROM lagp WHERE corr IS NOT NULL)
SELECT {r('sm', 'same_time_mean_corr')}, {r('ss', 'same_time_std')}, {r('lm', 'lagged_mean_corr')}, {r('ls', 'lagged_std')}, {r('sg', 'pct_lag_significant')},
  {r('lm / greatest(sm, 1e-8)', 'lag_decay_ratio')}, lm > 5e-2 AS predictive_value FROM a, b""")),
    "granger_statistics": (_granger_stats, GRANGER_SQL),
    "granger_summary": (_granger_summary, with_sql(PANEL_SQL + GRANGER_CTE, f"""SELECT n_pairs_tested, n_significant, {rs('pct_significant', 'mean_pvalue', 'median_pvalue', 'expected_by_chance', 'binom_pvalue')},
  binom_pvalue < 5e-2 AS interaction_significant FROM gb""")),
    "permutation_test": (_permutation, with_sql(PANEL_SQL + covered_cte("5e-1") + pairs_cte("cov", "realp") + PERMUTED_CTE, f"""SELECT {rs('real_mean_corr', 'null_mean_corr', 'null_std_corr')}, n_permutations,
  {rs('excess_corr', 'z_score', 'p_value')}, p_value < 5e-2 AS spatial_significant FROM pp""")),
    "interaction_verdict": (_verdict, VERDICT_SQL),
    "peer_graph": (_peers, with_sql(PANEL_SQL + pairs_cte("panel", "pairs") + PEERS_CTE, f'SELECT src, dst, {r("corr")}, "rank", {r("weight")} FROM peers')),
    "peer_average": (_peer_average, with_sql(PANEL_SQL + pairs_cte("panel", "pairs") + PEERS_CTE, f"""SELECT p.time_id, e.src AS stock_id, {r('sum(p.log_rv * e.weight) / sum(e.weight)', 'peer_log_rv')}, count(*) AS n_peers
FROM panel p JOIN peers e ON e.dst = p.stock_id GROUP BY p.time_id, e.src""")),
    "book_overview": (lambda s, d: eda.overview(book_sec(s, d)), with_sql(DENSE_SQL, """SELECT count(*) AS n_rows, count(DISTINCT stock_id) AS n_stocks, count(DISTINCT time_id) AS n_time_ids,
  min(seconds_in_bucket) AS min_second, max(seconds_in_bucket) AS max_second FROM dense""")),
    "missing_values": (lambda s, d: rounded(eda.missing_report(quotes(s, d), Q, False)), with_sql(QUOTES_SQL, " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS n_missing, {r(f"(count(*) - count({c})) * 100e0 / count(*)", "pct_missing")} FROM q' for c in Q))),
    "rows_per_sample": (lambda s, d: rounded(eda.rows_per_sample(quotes(s, d))), with_sql(QUOTES_SQL, f""", z AS (SELECT count(*) AS c FROM q GROUP BY stock_id, time_id)
SELECT count(*) AS n_samples, {r('avg(c)', 'mean_rows')}, {r('stddev_samp(c)', 'std_rows')}, min(c) AS min_rows, max(c) AS max_rows, count(CASE WHEN c < 600 THEN 1 END) AS n_short,
  bool_and(c = 600) AS all_complete, {r('quantile_cont(c, 0.25)', 'q25')}, {r('quantile_cont(c, 0.5)', 'median_rows')}, {r('quantile_cont(c, 0.75)', 'q75')} FROM z""")),
    "describe_features": (_describe, DESCRIBE_SQL),
    "clipped_histogram": (_hist, HIST_SQL),
    "log_spaced_histogram": (_log_hist, LOG_HIST_SQL),
    "kernel_density": (_kde, KDE_SQL),
    "volume_log_histogram": (_volume_hist, _hist_sql(QUOTES_SQL, "SELECT ln(1 + total_volume) AS v FROM q WHERE total_volume IS NOT NULL", "min(v)", "max(v)", 100)),
    "log_rv_histogram": (_log_rv_hist, _hist_sql(EDA_RV_SQL, "SELECT log_rv AS v FROM rvl WHERE log_rv IS NOT NULL", "quantile_cont(v, 0.001)", "quantile_cont(v, 0.999)", 119)),
    "rv_capped_histogram": (_rv_hist, _hist_sql(EDA_RV_SQL, "SELECT exp(log_rv) AS v FROM rvl WHERE log_rv IS NOT NULL", "min(v)", "quantile_cont(v, 0.99)", 80)),
    "stock_summary": (lambda s, d: rounded(eda.stock_summary(quotes(s, d))), with_sql(QUOTES_SQL, f"""SELECT stock_id, {r('avg(wap)', 'wap_mean')}, {r('stddev_samp(wap)', 'wap_std')}, {r('avg(bid_ask_spread)', 'spread_mean')},
  {r('avg(total_volume)', 'volume_mean')}, {r('avg(price_spread)', 'price_spread_mean')}, {r('avg(volume_imbalance)', 'vol_imbal_mean')}, count(*) AS n_rows,
  {r('quantile_cont(bid_ask_spread, 0.5)', 'spread_median')}, {r('avg(bid_ask_spread) / avg(wap)', 'relative_spread')} FROM q GROUP BY stock_id""")),
    "target_overview": (lambda s, d: rounded(eda.target_overview(rv_panel(s, d))), with_sql(EDA_RV_SQL, f"""SELECT count(*) AS n_total, count(CASE WHEN rv = 0 THEN 1 END) AS n_zero, count(CASE WHEN rv > 0 THEN 1 END) AS n_pos,
  {r('avg(CASE WHEN rv = 0 THEN 1e0 ELSE 0 END) * 100', 'pct_zero')}, {r('avg(log_rv)', 'mean_log_rv')}, {r('stddev_samp(log_rv)', 'std_log_rv')},
  {r('avg(CASE WHEN log_rv < ln(1e-4) THEN 1e0 WHEN log_rv IS NOT NULL THEN 0 END) * 100', 'pct_below_floor')} FROM rvl""")),
    "stock_target_summary": (lambda s, d: rounded(eda.stock_target_summary(rv_panel(s, d))), with_sql(EDA_RV_SQL, f"""SELECT stock_id, {r('avg(log_rv)', 'log_rv_mean')}, {r('stddev_samp(log_rv)', 'log_rv_std')},
  count(log_rv) AS n_samples, {r('avg(CASE WHEN coalesce(log_rv, -999) <= ln(1e-4) THEN 1e0 ELSE 0 END)', 'frac_at_floor')} FROM rvl GROUP BY stock_id""")),
    "floor_counts": (lambda s, d: eda.floor_counts(eda.stock_target_summary(rv_panel(s, d))), with_sql(EDA_RV_SQL, """, z AS (SELECT avg(CASE WHEN coalesce(log_rv, -999) <= ln(1e-4) THEN 1e0 ELSE 0 END) AS f FROM rvl GROUP BY stock_id)
SELECT count(CASE WHEN f > 5e-1 THEN 1 END) AS n_above_50pct, count(CASE WHEN f > 9e-1 THEN 1 END) AS n_above_90pct FROM z""")),
    "second_profile": (_profile, PROFILE_SQL),
    "input_window_samples": (lambda s, d: rounded(_samples(s, d)), with_sql(SAMPLES_SQL, f"SELECT {KEYS}, {rs(*SAMPLE_FEATURES)} FROM smp")),
    "feature_target_correlations": (_feature_corr, _feature_corr_sql()),
    "hash_sample": (_hash_sample, with_sql(QUOTES_SQL, f""", h1 AS (SELECT *, {hash_sql("stock_id", 42)} AS h FROM q), h2 AS (SELECT * REPLACE ({hash_sql("(h + time_id)", 42)} AS h) FROM h1),
h3 AS (SELECT * REPLACE ({hash_sql("(h + seconds_in_bucket)", 42)} AS h) FROM h2)
SELECT {KEYS}, seconds_in_bucket, {r("wap")} FROM h3 ORDER BY h, stock_id, time_id, seconds_in_bucket LIMIT 5000""")),
}
