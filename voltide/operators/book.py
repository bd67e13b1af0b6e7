"""Book table operators: last quote per second, derived columns, gap fill, returns.

Rows are keyed by (stock_id, time_id, seconds_in_bucket).  With 600 seconds per snapshot a
(stock_id, time_id) group has at most 600 rows however much data there is, which bounds every
per-snapshot window and array in this package.  ``last_quote_per_second`` establishes the key
for sources that do not guarantee it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.constants import PRICE_EPS, RETURN_CLIP, SECONDS_PER_SNAPSHOT
from voltide.functions import columns as vc

SNAPSHOT = ["stock_id", "time_id"]
SECOND_KEY = [*SNAPSHOT, "seconds_in_bucket"]
DERIVED = ["wap", "bid_ask_spread", "total_volume", "price_spread", "depth_imbalance"]

# Window text: rows of one snapshot in time order (at most 600).
BY_SECOND = "PARTITION BY stock_id, time_id ORDER BY seconds_in_bucket"
WHOLE = f"({BY_SECOND} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def last_quote_per_second(df: DataFrame, order_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Keep the latest quote of each second.

    A ``max_by`` per primitive column combines map-side, so a stock or second that holds a
    large share of the feed is reduced before the shuffle.
    """
    return df.groupBy(*SECOND_KEY).agg(*[F.max_by(c, order_col).alias(c) for c in value_cols])


def with_book_columns(raw: DataFrame, wap: str = "level1") -> DataFrame:
    """Derived columns of each quote.  ``wap`` is 'level1' or 'best' (better of two levels)."""
    items = {
        "wap": vc.WAP_LEVEL1 if wap == "level1" else vc.WAP_BEST, "bid_ask_spread": vc.BID_ASK_SPREAD,
        "total_volume": vc.TOTAL_VOLUME, "price_spread": vc.PRICE_SPREAD, "depth_imbalance": vc.DEPTH_IMBALANCE,
        "volume_imbalance": vc.VOLUME_IMBALANCE,
    }
    return raw.selectExpr(*SECOND_KEY, *[f"{text} AS {name}" for name, text in items.items()])


def fill_runs(df: DataFrame, value_cols: Sequence[str] = DERIVED) -> DataFrame:
    """Runs of equal seconds of the dense book: ``seconds_in_bucket`` to ``last_second``, filled forward, then backward at the start.

    Each observed row is stretched up to the next observed second, so the fill needs one
    shuffle and no grid join.  Missing values inside observed rows are filled the same way.
    """
    # what is missing in front takes the first value of the whole snapshot, so both frames are linear
    back = f"({BY_SECOND} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return df.where(F.col("seconds_in_bucket").between(0, SECONDS_PER_SNAPSHOT - 1)).selectExpr(
        *SNAPSHOT,
        f"CASE WHEN row_number() OVER ({BY_SECOND}) = 1 THEN 0 ELSE seconds_in_bucket END AS seconds_in_bucket",
        f"coalesce(lead(seconds_in_bucket) OVER ({BY_SECOND}), {SECONDS_PER_SNAPSHOT}) - 1 AS last_second",
        *[f"coalesce(last({c}, true) OVER {back}, first({c}, true) OVER {WHOLE}) AS {c}" for c in value_cols],
    )


def fill_seconds(df: DataFrame, value_cols: Sequence[str] = DERIVED) -> DataFrame:
    """One row per second 0..599: the runs of :func:`fill_runs`, second by second."""
    return fill_runs(df, value_cols).selectExpr(
        *SNAPSHOT, "explode(sequence(seconds_in_bucket, last_second)) AS seconds_in_bucket", *value_cols)


def book_runs(raw: DataFrame, wap: str = "level1") -> DataFrame:
    """Raw quotes to runs of the dense book, one per quote: the same content as :func:`preprocess_book` in fewer rows."""
    return fill_runs(with_book_columns(raw, wap).select(*SECOND_KEY, *DERIVED))


def preprocess_book(raw: DataFrame, wap: str = "level1") -> DataFrame:
    """Raw quotes to the dense per-second book."""
    return fill_seconds(with_book_columns(raw, wap).select(*SECOND_KEY, *DERIVED))


def add_log_price(df: DataFrame, eps: float | None = PRICE_EPS, price: str = "wap") -> DataFrame:
    p = price if eps is None else vc.floor_text(price, eps)
    return df.withColumn("log_wap", F.expr(f"ln({p})"))


def log_return(first: float | None = None, clip: float | None = None) -> Column:
    """Difference of log price within the snapshot; ``first`` replaces a missing return."""
    r = f"log_wap - lag(log_wap) OVER ({BY_SECOND})"
    if clip is not None:
        r = vc.clip_text(r, -clip, clip)
    return F.expr(r if first is None else f"coalesce({r}, {float(first)}D)")


def with_returns(df: DataFrame, eps: float | None = PRICE_EPS, first: float | None = None,
                 clip: float | None = None) -> DataFrame:
    return add_log_price(df, eps).withColumn("log_return", log_return(first, clip))


def returns_by_piece(df: DataFrame, eps: float | None = PRICE_EPS, first: float | None = None,
                     clip: float | None = None, every: int = SECONDS_PER_SNAPSHOT) -> DataFrame:
    """Returns of runs, cut at multiples of ``every`` seconds, or of single seconds; ``seconds`` is the length of a row.

    Inside a run the price stands still, so only its first second has a return. The returns are taken before the cut
    and nothing is sorted after it: a task sorts one row per quote, not one per second.
    """
    rows = with_returns(df, eps, first, clip)
    if "last_second" not in df.columns:
        return rows.withColumn("seconds", F.lit(1))
    begin, end = f"greatest(seconds_in_bucket, _part * {every})", f"least(last_second, _part * {every} + {every - 1})"
    still = "CASE WHEN log_wap IS NOT NULL THEN 0D END"
    if first is not None:
        still = f"coalesce({still}, {float(first)}D)"
    cut = rows.selectExpr("*", f"explode(sequence(seconds_in_bucket DIV {every}, last_second DIV {every})) AS _part")
    return cut.selectExpr(
        *[c for c in rows.columns if c not in ("seconds_in_bucket", "last_second", "log_return")],
        f"CAST({begin} AS INT) AS seconds_in_bucket", f"CAST({end} - {begin} + 1 AS INT) AS seconds",
        f"CASE WHEN _part * {every} > seconds_in_bucket THEN {still} WHEN {end} > seconds_in_bucket THEN coalesce(log_return, {still}) "
        "ELSE log_return END AS log_return")


def clipped_returns(df: DataFrame) -> DataFrame:
    """Returns for the GARCH step: first return 0, clipped to +-5 %."""
    return with_returns(df, PRICE_EPS, first=0.0, clip=RETURN_CLIP)


def normalise_preprocessed(df: DataFrame) -> DataFrame:
    """Numeric stock ids, one imbalance column, clipped liquidity (dynamic input schema)."""
    missing = sorted({*SECOND_KEY, "wap", "bid_ask_spread", "total_volume"} - set(df.columns))
    if missing:
        raise ValueError(f"missing required preprocessed columns: {missing}")
    if "volume_imbalance" in df.columns:
        imbalance = F.col("volume_imbalance")
    elif "depth_imbalance" in df.columns:
        imbalance = F.col("depth_imbalance")
    else:
        imbalance = F.lit(0.0)
    stock = F.col("stock_id").cast("int") if dict(df.dtypes)["stock_id"] != "string" else vc.stock_number("stock_id")
    return df.select(
        stock.alias("stock_id"), "time_id", "seconds_in_bucket",
        vc.at_least("wap", PRICE_EPS).alias("wap"),
        vc.at_least("bid_ask_spread", 0.0).alias("bid_ask_spread"),
        vc.at_least("total_volume", 0.0).alias("total_volume"),
        imbalance.alias("volume_imbalance"), *[c for c in df.columns if c == "last_second"],
    )
