"""Aggregate expressions whose edge cases differ from the Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltide.functions.columns import C, col

# Below this sum of squares a sample counts as constant.
FLAT_SUM_SQUARES = 1e-14
FLAT_CORR_SUM_SQUARES = 1e-20


def window_text(lo: int | None, hi: int | None) -> str:
    """SQL text: the second lies in [lo, hi)."""
    cond = [f"seconds_in_bucket >= {lo}"] * (lo is not None) + [f"seconds_in_bucket < {hi}"] * (hi is not None)
    return " AND ".join(cond) or "TRUE"


def in_window(lo: int | None, hi: int | None) -> Column:
    return F.expr(window_text(lo, hi))


def window_rv(ret: str, lo: int | None, hi: int | None) -> Column:
    """sqrt of the sum of squared returns whose second lies in [lo, hi); NULL if none."""
    return F.expr(f"sqrt(sum(CASE WHEN {window_text(lo, hi)} THEN {ret} * {ret} END))")


def mean_of_seconds(x: str, when: str = "TRUE") -> str:
    """SQL text: mean of ``x`` over the seconds of the rows that satisfy ``when``; NULL if none has a value."""
    return f"try_divide(sum(CASE WHEN {when} THEN {x} * seconds END), sum(CASE WHEN {when} AND {x} IS NOT NULL THEN seconds END))"


def std_of_seconds(x: str, deviation: str) -> str:
    """SQL text: sample deviation of ``x`` over all seconds, from its ``deviation`` from one value of the group."""
    n, s = f"sum(CASE WHEN {x} IS NOT NULL THEN seconds END)", f"sum({deviation} * seconds)"
    squares = f"sum({deviation} * {deviation} * seconds) - try_divide({s} * {s}, {n})"
    return f"sqrt(try_divide(greatest({squares}, 0D), {n} - 1))"


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def skew_corrected(x: str) -> str:
    """SQL text: bias-corrected skewness; 0 for a flat sample and for fewer than three values."""
    n = f"CAST(count({x}) AS DOUBLE)"
    return (f"CASE WHEN {n} < 3 OR {n} * var_pop({x}) < {FLAT_SUM_SQUARES}D THEN 0D "
            f"ELSE sqrt({n} * ({n} - 1)) / ({n} - 2) * skewness({x}) END")


def kurt_corrected(x: str) -> str:
    """SQL text: bias-corrected excess kurtosis; 0 for a flat sample and for fewer than four values."""
    n = f"CAST(count({x}) AS DOUBLE)"
    return (f"CASE WHEN {n} < 4 OR {n} * var_pop({x}) < {FLAT_SUM_SQUARES}D THEN 0D "
            f"ELSE ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({x}) + 6) END")


def lag1_autocorr(lagged: str, current: str, eps: float = 1e-10) -> str:
    """SQL text: lag-1 autocorrelation with slice means and an epsilon in the denominator.

    ``lagged`` must be NULL on the first row of the group.
    """
    n = f"CAST(count({lagged}) AS DOUBLE)"
    paired = f"CASE WHEN {lagged} IS NOT NULL THEN {current} END"
    spread = f"sqrt({n} * var_pop({lagged}) * {n} * var_pop({paired}))"
    return f"CASE WHEN {n} >= 2 THEN {n} * covar_pop({lagged}, {paired}) / ({spread} + {eps}D) ELSE 0D END"


def corr_text(x: str, y: str, when: str = "TRUE") -> str:
    """SQL text of :func:`corr0` over the rows that satisfy ``when`` (both sides never NULL there)."""
    a, b = f"CASE WHEN {when} THEN {x} END", f"CASE WHEN {when} THEN {y} END"
    live = " AND ".join(f"count({c}) * var_pop({c}) > {FLAT_CORR_SUM_SQUARES}D" for c in (a, b))
    return f"CASE WHEN {live} THEN try_divide(covar_pop({a}, {b}), sqrt(var_pop({a}) * var_pop({b}))) END"


def corr0(x: C, y: C) -> Column:
    """Pearson correlation over pairs with both present; NULL when a side is flat.

    ``F.corr`` raises under ANSI mode when a variance is zero, even inside ``when``.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xb, yb = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(xb)
    vx, vy = F.var_pop(xb), F.var_pop(yb)
    live = (n * vx > FLAT_CORR_SUM_SQUARES) & (n * vy > FLAT_CORR_SUM_SQUARES)
    return F.when(live, F.try_divide(F.covar_pop(xb, yb), F.sqrt(vx * vy)))


def corr_from_sums(n: C, sx: C, sy: C, sxx: C, syy: C, sxy: C) -> Column:
    """Pearson correlation from raw sums (for partial sums added across tasks)."""
    n, sx, sy, sxx, syy, sxy = map(col, (n, sx, sy, sxx, syy, sxy))
    vx = sxx - F.try_divide(sx * sx, n)
    vy = syy - F.try_divide(sy * sy, n)
    live = (n > 1) & (vx > FLAT_SUM_SQUARES) & (vy > FLAT_SUM_SQUARES)
    return F.when(live, F.try_divide(sxy - F.try_divide(sx * sy, n), F.sqrt(F.abs(vx * vy))))
