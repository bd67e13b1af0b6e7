"""Shared inputs of the registered queries: the book view over ``events`` and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators import book, har
from voltide.operators.book import last_quote_per_second, preprocess_book
from voltide.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
Entry = tuple[Query, str | None]

MODELS = ["naive", "scaled", "ols"]
PRICE_DIVISOR = 20011  # not a round number, so that rounded prices never sit on a tie


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def book_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level book from the event feed: 8 stocks, one snapshot a day for every 150 users, 144 s per book second.

    The number of snapshots grows with the feed, so nearly every event stays a quote at any size.
    """
    feed = events(spark, sf_dir).selectExpr(
        "event_id", "event_id AS e", "user_id", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "CAST(user_id % 8 AS INT) AS stock_id", "CAST(datediff(ts, DATE'2024-01-01') + 30 * (user_id DIV 150) AS INT) AS time_id",
        "CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 144) AS INT) AS seconds_in_bucket")
    last = last_quote_per_second(feed, "event_id", ["e", "user_id", "value", "k"])
    quotes = last.selectExpr("*", f"1D + value / {float(PRICE_DIVISOR)}D AS mid")

    def price(sign: str, steps: str, name: str) -> str:
        return f"mid * (1D {sign} 1e-4D * (1 + {steps})) AS {name}"

    return quotes.selectExpr(
        "stock_id", "time_id", "seconds_in_bucket",
        price("-", "e % 5", "bid_price1"), price("-", "(e * 3) % 7", "bid_price2"),
        price("+", "(e * 5) % 6", "ask_price1"), price("+", "(e * 11 + k) % 9", "ask_price2"),
        "k AS bid_size1", "e % 50 AS bid_size2", "(e * 7) % 100 AS ask_size1", "user_id % 50 AS ask_size2")


def book_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense per-second book (600 rows per stock and snapshot)."""
    return preprocess_book(book_raw(spark, sf_dir))


def book_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense book as runs of equal seconds, one per quote."""
    return book.book_runs(book_raw(spark, sf_dir))


def har_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAR feature table of the sparse book, model columns added, small targets dropped.

    Written once: fitting and scoring both read it.
    """
    return cut_lineage(har.model_rows(har.features_from_raw(book_raw(spark, sf_dir))))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three simple forecasts of every sample in the shared long layout."""
    rows = har_rows(spark, sf_dir).select(
        "stock_id", "time_id", (F.col("time_id") % 5).alias("fold"), F.col(har.TARGET).alias("actual_rv"),
        "rv_360_480", "rv_0_480", F.lit(0).alias("_k"), F.col("log_rv_0_480").alias("x"), F.col(har.LOG_TARGET).alias("y"))
    line = rows.groupBy("_k").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icpt"))
    scored = rows.join(F.broadcast(line), "_k")
    cells = F.explode(F.array(
        F.struct(F.lit("naive").alias("model"), F.greatest("rv_360_480", F.lit(1e-4)).alias("predicted_rv")),
        F.struct(F.lit("scaled").alias("model"),
                 F.when(F.col("rv_360_480") > 0, F.greatest(F.col("rv_0_480") * F.lit(0.5), F.lit(1e-4))).alias("predicted_rv")),
        F.struct(F.lit("ols").alias("model"), F.exp(F.col("icpt") + F.col("slope") * F.col("x")).alias("predicted_rv")),
    )).alias("c")
    return scored.select("stock_id", "time_id", "fold", "actual_rv", cells).select(
        "c.model", "stock_id", "time_id", "fold", "actual_rv", "c.predicted_rv").where("predicted_rv IS NOT NULL")


# ---- rounding, the same on both sides -------------------------------------------

def rounded(df: DataFrame) -> DataFrame:
    """Round every floating column so that summation order cannot show."""
    def one(f: T.StructField) -> str:
        name = f"`{f.name}`"
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return name
        x = f"CAST({name} AS DOUBLE)"
        return (f"(CASE WHEN abs({x}) < 1e3 THEN round({x}, 6) WHEN abs({x}) < 1e7 THEN round({x}, 2) "
                f"ELSE round({x}, -3) END + 0D) AS {name}")
    return df.selectExpr(*[one(f) for f in df.schema.fields])


def r(expr: str, name: str | None = None) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    body = (f"(CASE WHEN abs({x}) < 1e3 THEN round({x}, 6) WHEN abs({x}) < 1e7 THEN round({x}, 2) "
            f"ELSE round({x}, -3) END + CAST(0 AS DOUBLE))")
    return f"{body} AS {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


# ---- SQL twins ------------------------------------------------------------------

RAW_SQL = f"""
raw AS (
  SELECT stock_id, time_id, seconds_in_bucket,
         mid * (1e0 - 1e-4 * (1 + e % 5))              AS bid_price1,
         mid * (1e0 - 1e-4 * (1 + (e * 3) % 7))        AS bid_price2,
         mid * (1e0 + 1e-4 * (1 + (e * 5) % 6))        AS ask_price1,
         mid * (1e0 + 1e-4 * (1 + (e * 11 + k) % 9))   AS ask_price2,
         k AS bid_size1, e % 50 AS bid_size2, (e * 7) % 100 AS ask_size1, user_id % 50 AS ask_size2
  FROM (
    SELECT event_id AS e, user_id, 1e0 + value / {PRICE_DIVISOR}e0 AS mid,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           CAST(user_id % 8 AS INTEGER) AS stock_id,
           CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) + 30 * (user_id // 150) AS INTEGER) AS time_id,
           CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 144e0) AS INTEGER) AS seconds_in_bucket,
           row_number() OVER (PARTITION BY user_id % 8, user_id // 150, date_diff('day', TIMESTAMP '2024-01-01', ts),
             floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 144e0) ORDER BY event_id DESC) AS rn
    FROM events) q
  WHERE rn = 1)"""

_BEST_BID, _BEST_ASK = "greatest(bid_price1, bid_price2)", "least(ask_price1, ask_price2)"
_BB_SIZE = "CASE WHEN bid_price1 >= bid_price2 THEN bid_size1 ELSE bid_size2 END"
_BA_SIZE = "CASE WHEN ask_price1 <= ask_price2 THEN ask_size1 ELSE ask_size2 END"

COLS_SQL = RAW_SQL + f""",
cols AS (
  SELECT stock_id, time_id, seconds_in_bucket,
         (bid_price1 * ask_size1 + ask_price1 * bid_size1) / nullif(CAST(bid_size1 + ask_size1 AS DOUBLE), 0) AS wap,
         ({_BEST_BID} * bas + {_BEST_ASK} * bbs) / nullif(CAST(bbs + bas AS DOUBLE), 0) AS wap_best,
         {_BEST_ASK} / {_BEST_BID} - 1e0 AS bid_ask_spread,
         CAST(bid_size1 + bid_size2 + ask_size1 + ask_size2 AS DOUBLE) AS total_volume,
         greatest(bid_price1, bid_price2, ask_price1, ask_price2) - least(bid_price1, bid_price2, ask_price1, ask_price2) AS price_spread,
         CAST(bid_size1 + bid_size2 - ask_size1 - ask_size2 AS DOUBLE)
           / nullif(CAST(bid_size1 + bid_size2 + ask_size1 + ask_size2 AS DOUBLE), 0) AS depth_imbalance,
         CAST(bbs - bas AS DOUBLE) / nullif(CAST(bbs + bas AS DOUBLE), 0) AS volume_imbalance
  FROM (SELECT *, {_BB_SIZE} AS bbs, {_BA_SIZE} AS bas FROM raw) q)"""


def _fill(c: str) -> str:
    w = "(PARTITION BY g.stock_id, g.time_id ORDER BY g.s ROWS BETWEEN {})"
    return (f"coalesce(last_value(c.{c} IGNORE NULLS) OVER {w.format('UNBOUNDED PRECEDING AND CURRENT ROW')}, "
            f"first_value(c.{c} IGNORE NULLS) OVER {w.format('CURRENT ROW AND UNBOUNDED FOLLOWING')}) AS {c}")


DENSE_SQL = COLS_SQL + f""",
dense AS (
  SELECT g.stock_id, g.time_id, CAST(g.s AS INTEGER) AS seconds_in_bucket,
         {', '.join(_fill(c) for c in ('wap', 'bid_ask_spread', 'total_volume', 'price_spread', 'depth_imbalance'))}
  FROM (SELECT stock_id, time_id, s FROM (SELECT DISTINCT stock_id, time_id FROM cols) k, (SELECT unnest(range(600)) AS s) n) g
  LEFT JOIN cols c ON c.stock_id = g.stock_id AND c.time_id = g.time_id AND c.seconds_in_bucket = g.s)"""

_BY_SECOND = "(PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket)"


def returns_sql(src: str, name: str, wap: str = "wap", eps: str | None = "1e-12") -> str:
    """CTE with ``lr``, NULL on the first row of a snapshot."""
    p = f"greatest({wap}, {eps})" if eps else wap
    lw = f"CASE WHEN {wap} IS NOT NULL THEN ln({p}) END"
    return f""",
{name} AS (SELECT *, {lw} - lag({lw}) OVER {_BY_SECOND} AS lr, lag(seconds_in_bucket) OVER {_BY_SECOND} AS prev_s FROM {src})"""


def rv_sql(lo: int | None, hi: int | None, col: str = "lr") -> str:
    cond = " AND ".join([f"seconds_in_bucket >= {lo}"] * (lo is not None) + [f"seconds_in_bucket < {hi}"] * (hi is not None))
    return f"sqrt(sum(CASE WHEN {cond or 'TRUE'} THEN {col} * {col} END))"


HAR_COLUMNS = [*har.RV_FEATURES, har.TARGET, *har.LIQUIDITY]


def har_features_sql(src: str, ret: str, out: str) -> str:
    """CTE of the HAR feature table over a returns CTE."""
    e = "CASE WHEN seconds_in_bucket < 480 THEN {} END"
    return f""",
{out} AS (
  SELECT stock_id, time_id,
         coalesce({rv_sql(360, 480)}, 0) AS rv_360_480, coalesce({rv_sql(240, 480)}, 0) AS rv_240_480,
         coalesce({rv_sql(0, 480)}, 0) AS rv_0_480, coalesce({rv_sql(480, 600)}, 0) AS target_rv_480_600,
         coalesce(avg({e.format('bid_ask_spread')}), 0) AS spread_mean_0_480,
         coalesce(max({e.format('bid_ask_spread')}), 0) AS spread_max_0_480,
         coalesce(sum({e.format('total_volume')}), 0) AS volume_sum_0_480,
         coalesce(avg({e.format('volume_imbalance')}), 0) AS volume_imbalance_mean_0_480
  FROM {ret} GROUP BY stock_id, time_id)"""


HAR_SQL = COLS_SQL + returns_sql("cols", "ret", "wap_best", None) + har_features_sql("cols", "ret", "har") + """,
model_rows AS (
  SELECT *, ln(greatest(rv_360_480, 1e-12)) AS log_rv_360_480, ln(greatest(rv_240_480, 1e-12)) AS log_rv_240_480,
         ln(greatest(rv_0_480, 1e-12)) AS log_rv_0_480, ln(greatest(target_rv_480_600, 1e-12)) AS log_target_rv_480_600,
         ln(greatest(spread_mean_0_480, 1e-12)) AS log_spread_mean_0_480,
         ln(greatest(spread_max_0_480, 1e-12)) AS log_spread_max_0_480,
         ln(1 + volume_sum_0_480) AS log_volume_sum_0_480
  FROM har),
har_rows AS (SELECT * FROM model_rows WHERE target_rv_480_600 > 1e-4)"""

PRED_SQL = HAR_SQL + """,
line AS (SELECT regr_slope(log_target_rv_480_600, log_rv_0_480) AS slope,
                regr_intercept(log_target_rv_480_600, log_rv_0_480) AS icpt FROM har_rows),
wide_pred AS (
  SELECT stock_id, time_id, CAST(time_id % 5 AS INTEGER) AS fold, target_rv_480_600 AS actual_rv,
         greatest(rv_360_480, 1e-4) AS pred_naive,
         CASE WHEN rv_360_480 > 0 THEN greatest(rv_0_480 * 5e-1, 1e-4) END AS pred_scaled,
         exp(icpt + slope * log_rv_0_480) AS pred_ols
  FROM har_rows, line),
aligned AS (SELECT * FROM wide_pred WHERE pred_scaled IS NOT NULL),
long_pred AS (
  SELECT * FROM (
    SELECT 'naive' AS model, stock_id, time_id, fold, actual_rv, pred_naive AS predicted_rv FROM wide_pred
    UNION ALL SELECT 'scaled', stock_id, time_id, fold, actual_rv, pred_scaled FROM wide_pred
    UNION ALL SELECT 'ols', stock_id, time_id, fold, actual_rv, pred_ols FROM wide_pred) q
  WHERE predicted_rv IS NOT NULL),
long_aligned AS (
  SELECT 'naive' AS model, stock_id, time_id, fold, actual_rv, pred_naive AS predicted_rv FROM aligned
  UNION ALL SELECT 'scaled', stock_id, time_id, fold, actual_rv, pred_scaled FROM aligned
  UNION ALL SELECT 'ols', stock_id, time_id, fold, actual_rv, pred_ols FROM aligned)"""


def with_sql(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


def qlike_sql(true: str, pred: str, eps: str = "1e-10") -> str:
    t, p = f"greatest({true}, {eps})", f"greatest({pred}, {eps})"
    return f"({t} / {p} - ln({t} / {p}) - 1)"


def sqpct_sql(true: str, pred: str, eps: str = "1e-10") -> str:
    t, p = f"greatest({true}, {eps})", f"greatest({pred}, {eps})"
    return f"power(({t} - {p}) / {t}, 2)"


def corr_sql(x: str, y: str) -> str:
    """Pearson correlation, NULL for a flat side, with centring by the pair means."""
    b = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN"
    return (f"CASE WHEN count({b} 1 END) * var_pop({b} {x} END) > 1e-20 AND count({b} 1 END) * var_pop({b} {y} END) > 1e-20 "
            f"THEN covar_pop({x}, {y}) / sqrt(var_pop({b} {x} END) * var_pop({b} {y} END)) END")


# ---- linear fits in SQL ---------------------------------------------------------

def ols_sums_sql(keys: list[str], xs: list[str], y: str) -> str:
    """Select list of the sums of a linear fit."""
    v = [*xs, y]
    p = len(xs)
    parts = [*keys, "CAST(count(*) AS DOUBLE) AS n", *[f"sum({c}) AS s_{i}" for i, c in enumerate(v)],
             *[f"sum({v[i]} * {v[j]}) AS p_{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)]]
    return ", ".join(parts)


def ols_sum_names(p: int) -> list[str]:
    return ["n", *[f"s_{i}" for i in range(p + 1)], *[f"p_{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)]]


def ols_solve_sql(sums: str, keys: list[str], p: int, out: str) -> str:
    """CTEs that eliminate one regressor at a time and substitute back; ``out`` has b_0..b_p, rss."""
    tri = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    key_list = "".join(k + ", " for k in keys)
    ctes = [f"{out}_e0 AS (SELECT {key_list}n, {', '.join(f's_{i}' for i in range(p + 1))}, "
            + ", ".join(f"p_{i}_{j} - s_{i} * s_{j} / n AS a_{i}_{j}" for i, j in tri)
            + "".join(f", p_{i}_{i} AS scale_{i}" for i in range(p)) + f" FROM {sums})"]
    for k in range(p):
        us = ", ".join(f"CASE WHEN a_{k}_{k} > 1e-10 * scale_{k} THEN a_{k}_{j} / a_{k}_{k} ELSE 0 END AS u_{k}_{j}"
                       for j in range(k + 1, p + 1))
        ctes.append(f"{out}_u{k} AS (SELECT *, {us} FROM {out}_e{k})")
        changed = [(i, j) for i in range(k + 1, p + 1) for j in range(i, p + 1)]
        repl = ", ".join(f"a_{i}_{j} - u_{k}_{i} * a_{k}_{j} AS a_{i}_{j}" for i, j in changed)
        ctes.append(f"{out}_e{k + 1} AS (SELECT * REPLACE ({repl}) FROM {out}_u{k})")
    prev = f"{out}_e{p}"
    for k in reversed(range(p)):
        slope = f"u_{k}_{p}" + "".join(f" - u_{k}_{j} * b_{j + 1}" for j in range(k + 1, p))
        ctes.append(f"{out}_b{k} AS (SELECT *, {slope} AS b_{k + 1} FROM {prev})")
        prev = f"{out}_b{k}"
    icpt = f"(s_{p}" + "".join(f" - b_{k + 1} * s_{k}" for k in range(p)) + ") / n"
    ctes.append(f"{out} AS (SELECT {key_list}CAST(n AS BIGINT) AS n, {icpt} AS b_0, "
                + ", ".join(f"b_{k + 1}" for k in range(p)) + f", greatest(a_{p}_{p}, 0) AS rss FROM {prev})")
    return ",\n".join(ctes)


# ---- folds in SQL ---------------------------------------------------------------

def hash_sql(key: str, salt: int) -> str:
    from voltide.functions.columns import mixed_hash_sql
    return mixed_hash_sql(key, salt)


def folds_sql(src: str, out: str = "folds", n_splits: int = 5, seed: int = 42) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {k} AS fold, time_id, {hash_sql('time_id', seed + k)} AS h FROM (SELECT DISTINCT time_id FROM {src}) d{k}"
        for k in range(n_splits))
    return f""",
{out} AS (
  SELECT fold, time_id, CASE WHEN pos < k THEN 'test' ELSE 'train' END AS split,
         CAST(CASE WHEN pos < k THEN -1 ELSE (pos - k) % 5 END AS INTEGER) AS inner_part
  FROM (SELECT fold, time_id, row_number() OVER (PARTITION BY fold ORDER BY h, time_id) - 1 AS pos,
               ceil(count(*) OVER (PARTITION BY fold) * 2e-1) AS k FROM ({parts}) q) r)"""
