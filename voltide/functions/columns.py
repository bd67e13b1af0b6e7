"""Scalar column expressions: guards, book columns, labels and portable hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltide.constants import FEATURE_EPS, REGIME_CUTS, REGIMES, TIERS

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: C) -> Column:
    """NaN and both infinities become NULL."""
    if isinstance(c, str):
        return F.expr(f"CASE WHEN isnan({c}) OR abs({c}) = double('infinity') THEN NULL ELSE {c} END")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def floor_text(x: str, floor: float) -> str:
    """SQL text: lower clip that keeps NULL (``greatest`` alone would replace it by the floor)."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {float(floor)}D) END"


def clip_text(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {float(lo)}D), {float(hi)}D) END"


def at_least(c: C, floor: float) -> Column:
    """Lower clip that keeps NULL."""
    if isinstance(c, str):
        return F.expr(floor_text(c, floor))
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def clip(c: C, lo: float, hi: float) -> Column:
    if isinstance(c, str):
        return F.expr(clip_text(c, lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def floored_log(c: str, floor: float = FEATURE_EPS) -> Column:
    return F.expr(f"ln({floor_text(c, floor)})")


# ---- book columns, as SQL text --------------------------------------------------

def _ratio(num: str, den: str) -> str:
    """Division that gives NULL, not an error, at a zero denominator."""
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def _both(fn: str, a: str, b: str) -> str:
    """greatest/least of two, NULL when either is NULL."""
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {fn}({a}, {b}) END"


BEST_BID = f"({_both('greatest', 'bid_price1', 'bid_price2')})"
BEST_ASK = f"({_both('least', 'ask_price1', 'ask_price2')})"
BEST_BID_SIZE = "(CASE WHEN bid_price1 >= bid_price2 THEN bid_size1 ELSE bid_size2 END)"
BEST_ASK_SIZE = "(CASE WHEN ask_price1 <= ask_price2 THEN ask_size1 ELSE ask_size2 END)"
_SIZES = ("bid_size1", "bid_size2", "ask_size1", "ask_size2")
_PRICES = "bid_price1, bid_price2, ask_price1, ask_price2"

# Weighted average price from the first level only.
WAP_LEVEL1 = _ratio("bid_price1 * ask_size1 + ask_price1 * bid_size1", "bid_size1 + ask_size1")
# Weighted average price from the better of two levels; the size follows the price.
WAP_BEST = _ratio(f"{BEST_BID} * {BEST_ASK_SIZE} + {BEST_ASK} * {BEST_BID_SIZE}", f"{BEST_BID_SIZE} + {BEST_ASK_SIZE}")
# Relative spread: best ask over best bid, minus one.
BID_ASK_SPREAD = f"{_ratio(BEST_ASK, BEST_BID)} - 1D"
TOTAL_VOLUME = f"CAST({' + '.join(f'coalesce({c}, 0)' for c in _SIZES)} AS DOUBLE)"
# Price range over the levels present.
PRICE_SPREAD = f"greatest({_PRICES}) - least({_PRICES})"
DEPTH_IMBALANCE = _ratio("bid_size1 + bid_size2 - ask_size1 - ask_size2", "bid_size1 + bid_size2 + ask_size1 + ask_size2")
VOLUME_IMBALANCE = _ratio(f"{BEST_BID_SIZE} - {BEST_ASK_SIZE}", f"{BEST_BID_SIZE} + {BEST_ASK_SIZE}")


# ---- ids, labels -------------------------------------------------------------

def stock_number(c: C, strict: bool = True) -> Column:
    """Trailing digits of a stock id such as ``stock_17``; raises on ids that have none."""
    text = col(c).cast("string")
    digits = F.regexp_extract(text, r"(\d+)$", 1)
    bad = F.raise_error(F.concat(F.lit("stock id does not end in an integer: "), text)) if strict else F.lit(None)
    return F.when(text.isNull(), None).when(digits != "", digits.cast("int")).otherwise(bad.cast("int"))


def _banded(c: Column, labels: tuple[str, ...]) -> Column:
    out = F.when(c < REGIME_CUTS[0], labels[0])
    for cut, label in zip(REGIME_CUTS[1:], labels[1:]):
        out = out.when(c < cut, label)
    return out.otherwise(labels[-1])


def regime_label(rv: C) -> Column:
    """calm / normal / elevated / stressed; a missing RV is stressed too."""
    return _banded(col(rv), REGIMES)


def tier_label(rv: C) -> Column:
    return _banded(col(rv), TIERS)


def regime_code(regime: C) -> Column:
    """0..3 for the heat map; an unknown label counts as 1."""
    r = col(regime)
    out = F.when(r == REGIMES[0], 0)
    for code, label in enumerate(REGIMES[1:], start=1):
        out = out.when(r == label, code)
    return out.otherwise(1)


def stars(p: C) -> Column:
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def second_bucket(width: int, n_buckets: int, second: C = "seconds_in_bucket") -> Column:
    """Fixed-width bucket number, the last bucket taking the overflow."""
    return F.least(F.floor(col(second) / width), F.lit(n_buckets - 1)).cast("int")


# ---- portable hash -----------------------------------------------------------
# Plain BIGINT arithmetic, so any SQL engine gives the same folds.

_PRIME = 2147483647


def mixed_hash(key: C, salt: int) -> Column:
    k = col(key).cast("bigint")
    h = F.pmod(k * 48271 + F.lit(salt * 69621 + 11).cast("bigint"), F.lit(_PRIME).cast("bigint"))
    return F.pmod(F.pmod(h * h, F.lit(_PRIME).cast("bigint")) + h * 16807, F.lit(_PRIME).cast("bigint"))


def mixed_hash_sql(key: str, salt: int) -> str:
    """The same hash as text for another SQL engine (non-negative keys)."""
    h = f"((CAST({key} AS BIGINT) * 48271 + {salt * 69621 + 11}) % {_PRIME})"
    return f"((({h} * {h}) % {_PRIME} + {h} * 16807) % {_PRIME})"
