"""Co-movement of stocks: correlation, Granger, permutation and lead-lag tests.

The panel is long: time_id, stock_id, log_rv, one row per live (snapshot, stock).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltide.constants import LIVE_LOG_RV
from voltide.functions.aggregates import corr0
from voltide.functions.columns import mixed_hash
from voltide.functions.distributions import upper_binomial_text, upper_f_text, upper_normal_text
from voltide.operators import ols
from voltide.plans.ordered import average_ranks, exact_quantiles, lag_by_index, with_global_index
from voltide.plans.pairs import pair_correlations
from voltide.session import cut_lineage

MIN_PAIR_ROWS = 10


def live_panel(rv: DataFrame, floor: float = LIVE_LOG_RV) -> DataFrame:
    return rv.where(F.col("log_rv").isNotNull() & (F.col("log_rv") > floor)).select("time_id", "stock_id", "log_rv")


def well_covered(panel: DataFrame, share: float) -> DataFrame:
    """Rows of stocks present in at least ``share`` of the snapshots."""
    totals = panel.agg(F.count_distinct("time_id").alias("_snapshots")).withColumn("_k", F.lit(0))
    good = (
        panel.groupBy("stock_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
        .join(F.broadcast(totals), "_k").where(F.col("_n") >= F.col("_snapshots") * F.lit(float(share)))
        .select("stock_id")
    )
    return panel.join(good, "stock_id", "left_semi")


def complete_snapshots(panel: DataFrame) -> DataFrame:
    """Rows of snapshots where every stock of the panel is present."""
    total = panel.agg(F.count_distinct("stock_id").alias("_stocks")).withColumn("_k", F.lit(0))
    full = (
        panel.groupBy("time_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
        .join(F.broadcast(total), "_k").where(F.col("_n") == F.col("_stocks")).select("time_id")
    )
    return panel.join(full, "time_id", "left_semi")


def _as_pairs_input(panel: DataFrame, *extra: str) -> DataFrame:
    return panel.select(*extra, F.col("time_id").alias("t"), F.col("stock_id").alias("sid"), F.col("log_rv").alias("v"))


def correlation_pairs(panel: DataFrame, share: float = 0.5) -> DataFrame:
    """Correlation of log RV for every pair a < b of well-covered stocks (the matrix, long form)."""
    return pair_correlations(_as_pairs_input(well_covered(panel, share)))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Full symmetric matrix in long form, ones on the diagonal."""
    flipped = pairs.select(F.col("stock_b").alias("stock_a"), F.col("stock_a").alias("stock_b"), "corr")
    stocks = pairs.select(F.explode(F.array("stock_a", "stock_b")).alias("stock_a")).distinct()
    diagonal = stocks.select("stock_a", F.col("stock_a").alias("stock_b"), F.lit(1.0).alias("corr"))
    return pairs.select("stock_a", "stock_b", "corr").unionByName(flipped).unionByName(diagonal)


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """Mean, median, std and shares of the pair correlations."""
    live = pairs.where(F.col("corr").isNotNull()).withColumn("_k", F.lit(0))
    stocks = live.select("_k", F.explode(F.array("stock_a", "stock_b")).alias("s")).groupBy("_k").agg(
        F.count_distinct("s").alias("n_stocks"))
    stats = live.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("corr").alias("mean_corr"), F.stddev_pop("corr").alias("std_corr"),
        *[F.avg((F.col("corr") > cut).cast("double")).alias(name)
          for name, cut in (("pct_positive", 0.0), ("pct_gt_03", 0.3), ("pct_gt_05", 0.5))])
    median = exact_quantiles(live, ["_k"], "corr", {"median_corr": 0.5})
    out = stats.join(F.broadcast(median), "_k").join(F.broadcast(stocks), "_k").drop("_k")
    finding = F.when(F.col("mean_corr") > 0.3, "strong").when(F.col("mean_corr") > 0.1, "moderate").otherwise("weak")
    return out.withColumn("finding", finding)


# ---- lead-lag -------------------------------------------------------------------

def snapshot_index(panel: DataFrame) -> DataFrame:
    """Dense position of each snapshot in id order."""
    return with_global_index(panel.select("time_id").distinct(), ["time_id"], "t")


def lagged_pairs(panel: DataFrame) -> DataFrame:
    """Correlation of stock a at one snapshot with stock b (a < b) at the next."""
    indexed = panel.join(snapshot_index(panel), "time_id").select("t", F.col("stock_id").alias("sid"), F.col("log_rv").alias("v"))
    later = indexed.withColumn("t", F.col("t") - 1)
    return pair_correlations(indexed, later, min_rows=MIN_PAIR_ROWS)


def lead_lag(panel: DataFrame, share: float = 0.7) -> DataFrame:
    complete = complete_snapshots(well_covered(panel, share))
    same = pair_correlations(_as_pairs_input(complete)).where("corr IS NOT NULL").groupBy(F.lit(0).alias("_k")).agg(
        F.avg("corr").alias("same_time_mean_corr"), F.stddev_pop("corr").alias("same_time_std"))
    lagged = lagged_pairs(complete).where("corr IS NOT NULL").groupBy(F.lit(0).alias("_k")).agg(
        F.avg("corr").alias("lagged_mean_corr"), F.stddev_pop("corr").alias("lagged_std"),
        F.avg((F.abs("corr") > 0.1).cast("double")).alias("pct_lag_significant"))
    return same.join(F.broadcast(lagged), "_k").drop("_k").withColumns({
        "lag_decay_ratio": F.col("lagged_mean_corr") / F.greatest(F.col("same_time_mean_corr"), F.lit(1e-8)),
        "predictive_value": F.col("lagged_mean_corr") > 0.05,
    })


# ---- Granger --------------------------------------------------------------------

def random_pairs(panel: DataFrame, n_pairs: int = 200, seed: int = 42) -> DataFrame:
    """Up to ``n_pairs`` ordered stock pairs (cause, effect), picked by hash.

    Draws index into the sorted stock list; draws of a stock with itself are discarded, as in
    sampling with replacement.  The list has ``n_pairs`` rows whatever the data size.
    """
    stocks = panel.groupBy(F.lit(0).alias("_k")).agg(F.sort_array(F.collect_set("stock_id")).alias("s"))
    draws = panel.sparkSession.range(n_pairs * 3).select(
        F.lit(0).alias("_k"), F.col("id").alias("draw"),
        mixed_hash(F.col("id") * 7919 + 13, seed).alias("h1"), mixed_hash(F.col("id") * 6271 + 101, seed + 1).alias("h2"))
    picked = draws.join(F.broadcast(stocks), "_k").select(
        "draw", F.col("s")[(F.col("h1") % F.size("s")).cast("int")].alias("cause"),
        F.col("s")[(F.col("h2") % F.size("s")).cast("int")].alias("effect"),
    ).where("cause <> effect")
    return picked.orderBy("draw").limit(n_pairs).select(F.col("draw").alias("pair"), "cause", "effect")


def granger(panel: DataFrame, pairs: DataFrame, lags: int = 3, parity: bool = True) -> DataFrame:
    """F test that the cause's value ``lags`` snapshots back improves the effect's own lag.

    Each pair is aligned on snapshots where both are present and indexed in order; lagged values
    come from an equi-join on the index.  ``parity=True`` uses q = lags as published, although
    one lagged regressor is added; ``False`` uses q = 1.
    """
    left = panel.select("time_id", F.col("stock_id").alias("effect"), F.col("log_rv").alias("y"))
    right = panel.select("time_id", F.col("stock_id").alias("cause"), F.col("log_rv").alias("x"))
    both = F.broadcast(pairs).join(left, "effect").join(right, ["cause", "time_id"])
    indexed = with_global_index(both.select("pair", "time_id", "y", "x"), ["pair", "time_id"])
    rows = lag_by_index(indexed, ["pair"], ["y", "x"], lags).where("y_prev IS NOT NULL")
    sums = ols.cross_sums(rows, ["pair"], ["y_prev", "x_prev"], "y")
    # Elimination order makes the restricted fit a by-product: drop the second regressor's sums.
    restricted = sums.select("pair", "n", "s_0", F.col("s_2").alias("s_1"), "p_0_0", F.col("p_0_2").alias("p_0_1"),
                             F.col("p_2_2").alias("p_1_1"))
    rss_r = ols.solve(restricted, ["pair"], 1).select("pair", F.col("rss").alias("rss_r"))
    rss_u = ols.solve(sums, ["pair"], 2).select("pair", "n", F.col("rss").alias("rss_u"))
    q = F.lit(float(lags if parity else 1))
    df2 = (F.col("n") - 3).cast("double")
    f_stat = F.try_divide((F.col("rss_r") - F.col("rss_u")) / q, F.col("rss_u") / df2)
    tested = rss_u.join(rss_r, "pair").where((F.col("n") >= 10) & (F.col("rss_u") > 0))
    scored = tested.select("pair", "n", f_stat.alias("f_stat"), q.alias("q"), df2.alias("df2"))
    return F.broadcast(pairs).join(scored, "pair").withColumn("p_value", F.expr(upper_f_text("f_stat", "q", "df2")))


def granger_summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    rows = tests.where("p_value IS NOT NULL").withColumn("_k", F.lit(0))
    stats = rows.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n_pairs_tested"), F.count_if(F.col("p_value") < alpha).alias("n_significant"),
        F.avg((F.col("p_value") < alpha).cast("double")).alias("pct_significant"), F.avg("p_value").alias("mean_pvalue"))
    median = exact_quantiles(rows, ["_k"], "p_value", {"median_pvalue": 0.5})
    out = stats.join(F.broadcast(median), "_k").drop("_k").withColumns({
        "expected_by_chance": F.lit(alpha),
        "binom_pvalue": F.expr(upper_binomial_text("n_significant", "n_pairs_tested", f"{alpha!r}D")),
    })
    return out.withColumn("interaction_significant", F.col("binom_pvalue") < 0.05)


# ---- permutation ----------------------------------------------------------------

def permuted_panels(panel: DataFrame, n_perm: int = 100) -> DataFrame:
    """``perm, time_id, stock_id, log_rv``: values shuffled among the stocks of each snapshot.

    A snapshot is one array of at most one entry per stock, so the panel is shuffled once and
    the permutations are made map-side, in hash order.
    """
    snap = panel.groupBy("time_id").agg(F.sort_array(F.collect_list(F.struct("stock_id", "log_rv"))).alias("cells"))
    perms = snap.select("time_id", "cells", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    shuffled = F.sort_array(F.transform("cells", lambda c: F.struct(
        mixed_hash(F.col("perm") * F.lit(1000003).cast("bigint") * 1009 + F.col("time_id") * F.lit(1009).cast("bigint") + c["stock_id"], 5).alias("h"),
        c["stock_id"].alias("s"), c["log_rv"].alias("v"))))
    cell = F.explode(F.arrays_zip(F.transform("cells", lambda c: c["stock_id"]).alias("s"),
                                  F.transform(shuffled, lambda c: c["v"]).alias("v")))
    return perms.select("perm", "time_id", cell.alias("c")).select(
        "perm", "time_id", F.col("c.s").alias("stock_id"), F.col("c.v").alias("log_rv"))


def null_means(panel: DataFrame, n_perm: int = 100) -> DataFrame:
    """``perm, m``: the mean pair correlation of each permuted panel.

    Holes stay where they are under a permutation. For the S stocks that are present everywhere, the correlations of all
    pairs add up to the sum over snapshots of (sum of z)^2 - sum of z^2, over 2 n, with z the values standardised by
    stock: no pairs are made. Only pairs with a gappy stock are multiplied out.
    """
    shuffled = cut_lineage(permuted_panels(panel, n_perm))
    one = F.lit(0).alias("_k")
    size = panel.select(one, "time_id").groupBy("_k").agg(F.count_distinct("time_id").alias("n"))
    per_stock = panel.select(one, "stock_id").groupBy("_k", "stock_id").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(size), "_k")
    present = per_stock.select("stock_id", "n", (F.col("c") == F.col("n")).alias("whole"))
    moments = shuffled.groupBy("perm", "stock_id").agg(F.avg("log_rv").alias("mean"), F.stddev_pop("log_rv").alias("sd")).join(
        F.broadcast(present.where("whole")), "stock_id").where("sd > 0")
    z = (F.col("log_rv") - F.col("mean")) / F.col("sd")
    rows = shuffled.join(moments, ["perm", "stock_id"]).groupBy("perm", "time_id").agg(
        F.sum(z).alias("s"), F.sum(z * z).alias("q"), F.first("n").alias("n"), F.count(F.lit(1)).alias("k"))
    whole = rows.groupBy("perm").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / (2 * F.first("n"))).alias("total"),
                                     (F.max("k") * (F.max("k") - 1) / 2).alias("pairs"))
    gappy = [r["stock_id"] for r in present.where("NOT whole").select("stock_id").collect()]     # at most the stock universe
    if gappy:
        mixed = pair_correlations(_as_pairs_input(shuffled, "perm"), extra=["perm"], touching=gappy).where("corr IS NOT NULL")
        whole = whole.unionByName(mixed.groupBy("perm").agg(F.sum("corr").alias("total"), F.count(F.lit(1)).cast("double").alias("pairs")))
    return whole.groupBy("perm").agg((F.sum("total") / F.sum("pairs")).alias("m"))


def permutation_test(panel: DataFrame, n_perm: int = 100, share: float = 0.5) -> DataFrame:
    """Mean pair correlation against its distribution under within-snapshot shuffles."""
    good = well_covered(panel, share)
    real = pair_correlations(_as_pairs_input(good)).groupBy(F.lit(0).alias("_k")).agg(F.avg("corr").alias("real_mean_corr"))
    dist = null_means(good, n_perm).groupBy(F.lit(0).alias("_k")).agg(
        F.avg("m").alias("null_mean_corr"), F.stddev_pop("m").alias("null_std_corr"), F.count(F.lit(1)).alias("n_permutations"))
    out = real.join(F.broadcast(dist), "_k").drop("_k")
    out = out.withColumn("excess_corr", F.col("real_mean_corr") - F.col("null_mean_corr"))
    out = out.withColumn("z_score", F.col("excess_corr") / (F.col("null_std_corr") + 1e-10))
    out = out.withColumn("p_value", F.expr(upper_normal_text("z_score")))
    return out.withColumn("spatial_significant", F.col("p_value") < 0.05)


def verdict(corr: DataFrame, granger_row: DataFrame, perm: DataFrame, lag: DataFrame) -> DataFrame:
    """One row joining the four test results and the overall finding."""
    def keyed(df: DataFrame, *cols) -> DataFrame:
        return df.select(F.lit(0).alias("_k"), *cols)

    joined = (
        keyed(corr, "mean_corr").join(F.broadcast(keyed(granger_row, "pct_significant", "interaction_significant")), "_k")
        .join(F.broadcast(keyed(perm, "z_score", "spatial_significant")), "_k")
        .join(F.broadcast(keyed(lag, "lagged_mean_corr", "predictive_value")), "_k").drop("_k")
    )
    votes = ((F.col("mean_corr") > 0.3).cast("int") + F.col("interaction_significant").cast("int")
             + F.col("spatial_significant").cast("int") + F.col("predictive_value").cast("int"))
    return joined.withColumn("n_positive", votes).withColumn(
        "verdict", F.when(F.col("n_positive") >= 3, "strong").when(F.col("n_positive") >= 2, "moderate").otherwise("weak"))


# ---- peers ----------------------------------------------------------------------

def peer_graph(panel: DataFrame, k: int = 10) -> DataFrame:
    """Edges to the ``k`` most correlated peers of each stock with softmax weights.

    The ranking window holds one row per stock of the universe.
    """
    pairs = pair_correlations(_as_pairs_input(panel)).where("corr IS NOT NULL")
    both = pairs.select("stock_a", "stock_b", "corr").unionByName(
        pairs.select(F.col("stock_b").alias("stock_a"), F.col("stock_a").alias("stock_b"), "corr"))
    by_src = W.partitionBy("src")
    top = both.select(F.col("stock_a").alias("src"), F.col("stock_b").alias("dst"), "corr").withColumn(
        "rank", F.row_number().over(by_src.orderBy(F.col("corr").desc(), "dst"))).where(F.col("rank") <= k)
    e = F.exp(F.col("corr") - F.max("corr").over(by_src))
    return top.withColumn("weight", e / F.sum(e).over(by_src))


def peer_average(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted mean of the peers' values at the same snapshot, for every stock of the graph."""
    joined = panel.select("time_id", F.col("stock_id").alias("dst"), "log_rv").join(edges.select("src", "dst", "weight"), "dst")
    return joined.groupBy("time_id", F.col("src").alias("stock_id")).agg(
        F.try_divide(F.sum(F.col("log_rv") * F.col("weight")), F.sum("weight")).alias("peer_log_rv"),
        F.count(F.lit(1)).alias("n_peers"))


# ---- feature-target correlation -------------------------------------------------

def feature_target_correlations(samples: DataFrame, features: Sequence[str], target: str = "log_rv",
                                keys: Sequence[str] = ("stock_id", "time_id"), min_rows: int = 50) -> DataFrame:
    """Pearson and Spearman of each feature with the target, sorted by |Spearman|.

    Features are unpivoted, ranks come from a distributed sort per feature, and Spearman is the
    Pearson correlation of average ranks. The samples are written once: both ranks and the join read them.
    """
    samples = cut_lineage(samples.select(*keys, *features, target))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = samples.select(*keys, F.col(target).alias("y"), cells.alias("c")).select(*keys, "y", "c.*").where(
        "x IS NOT NULL AND y IS NOT NULL")
    rx = average_ranks(long, ["feature"], "x", "rx")
    ry = average_ranks(long, ["feature"], "y", "ry")
    ranked = long.join(rx, ["feature", "x"]).join(ry, ["feature", "y"])
    out = ranked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), corr0("x", "y").alias("pearson"), corr0("rx", "ry").alias("spearman"))
    return out.where(F.col("n") >= min_rows).orderBy(F.abs("spearman").desc_nulls_last(), "feature")
