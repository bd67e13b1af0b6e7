"""Tail probabilities of the normal, F, binomial and t distributions, which Spark SQL lacks.

Each is a text over SQL functions that Spark evaluates in the JVM: series and continued fractions with a fixed number of
terms, folded from the last term to the first. With ``duck=True`` the same text is written for another SQL engine. Arguments
are texts, best column names, as they are repeated. The plain Python functions above them are what the tests compare with.
"""

from __future__ import annotations

import math



def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return math.exp(log_front) * value / a


def f_sf(f: float, df1: float, df2: float) -> float:
    if f <= 0.0:
        return 1.0
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    if p < 0.5:
        return -t_quantile(1.0 - p, df)

    def cdf(t: float) -> float:
        return 1.0 - 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2.0


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial count."""
    if k <= 0:
        return 1.0
    return incomplete_beta(k, n - k + 1, p)


# ---- the same as SQL text ------------------------------------------------------------

SERIES_TERMS, FRACTION_TERMS, BETA_TERMS, HALVINGS = 90, 60, 1000, 100


def fold_text(terms: int, first: str, body: str, duck: bool) -> str:
    """``body`` over so_far and term = terms, ..., 1."""
    if duck:
        return f"list_reduce(list_concat([CAST({first} AS DOUBLE)], CAST(range({terms}, 0, -1) AS DOUBLE[])), lambda so_far, term: {body})"
    return f"aggregate(sequence({terms}, 1, -1), CAST({first} AS DOUBLE), (so_far, term) -> {body})"


def erfc_text(x: str, duck: bool = False) -> str:
    """Complementary error function of x >= 0: its power series below 3, its continued fraction above."""
    small = f"1e0 - 1.1283791670955126e0 * exp(-{x} * {x}) * {x} * " + fold_text(SERIES_TERMS, "1e0", f"1e0 + so_far * 2e0 * {x} * {x} / (2e0 * term + 1e0)", duck)
    large = f"exp(-{x} * {x}) / 1.7724538509055159e0 / " + fold_text(FRACTION_TERMS, x, f"{x} + term / 2e0 / so_far", duck)
    return f"(CASE WHEN {x} < 3e0 THEN {small} ELSE {large} END)"


def upper_normal_text(z: str, duck: bool = False) -> str:
    half = f"5e-1 * {erfc_text(f'(abs({z}) / 1.4142135623730951e0)', duck)}"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN {half} ELSE 1e0 - {half} END)"


def two_sided_normal_text(z: str, duck: bool = False) -> str:
    return f"(CASE WHEN {z} IS NOT NULL THEN {erfc_text(f'(abs({z}) / 1.4142135623730951e0)', duck)} END)"


def log_gamma_text(a: str) -> str:
    """Stirling's series eight steps up, less the logarithm of the steps."""
    w = f"({a} + 8e0)"
    steps = " * ".join([a, *(f"({a} + {i}e0)" for i in range(1, 8))])
    tail = " + ".join(f"{sign}1e0 / ({d}e0 * power({w}, {p}e0))" for sign, d, p in (("", 12, 1), ("-", 360, 3), ("", 1260, 5), ("-", 1680, 7), ("", 1188, 9)))
    return f"(({w} - 5e-1) * ln({w}) - {w} + 9.189385332046727e-1 + {tail} - ln({steps}))"


def beta_text(a: str, b: str, x: str, duck: bool = False) -> str:
    """Regularised incomplete beta function, by the continued fraction of the side where it converges fast."""
    def side(a: str, b: str, x: str) -> str:
        odd = f"-({a} + (term - 1e0) / 2e0) * ({a} + {b} + (term - 1e0) / 2e0) * {x} / (({a} + term - 1e0) * ({a} + term))"
        even = f"term / 2e0 * ({b} - term / 2e0) * {x} / (({a} + term - 1e0) * ({a} + term))"
        fraction = fold_text(BETA_TERMS, "1e0", f"1e0 + (CASE WHEN term % 2 = 1 THEN {odd} ELSE {even} END) / so_far", duck)
        front = f"exp({log_gamma_text(f'({a} + {b})')} - {log_gamma_text(a)} - {log_gamma_text(b)} + {a} * ln({x}) + {b} * ln(1e0 - {x}))"
        return f"{front} / {a} / {fraction}"

    return (f"(CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 1 THEN 1e0 WHEN {x} <= ({a} + 1e0) / ({a} + {b} + 2e0) THEN {side(a, b, x)} "
            f"ELSE 1e0 - {side(b, a, f'(1e0 - {x})')} END)")


def upper_f_text(f: str, df1: str, df2: str, duck: bool = False) -> str:
    inner = beta_text(f"({df2} / 2e0)", f"({df1} / 2e0)", f"({df2} / ({df2} + {df1} * {f}))", duck)
    return f"(CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 0 THEN 1e0 ELSE {inner} END)"


def upper_binomial_text(k: str, n: str, p: str, duck: bool = False) -> str:
    """P(X >= k)."""
    return f"(CASE WHEN {k} <= 0 THEN 1e0 WHEN {k} > {n} THEN 0e0 ELSE {beta_text(f'({k} * 1e0)', f'({n} - {k} + 1e0)', p, duck)} END)"


def t_quantile_text(p: str, df: str) -> str:
    """Student's t quantile: the share of beta's mass is bisected. For Spark."""
    middle = "((g.lo + g.hi) / 2e0)"
    mass = beta_text(f"({df} / 2e0)", "5e-1", middle)
    found = (f"aggregate(sequence(1, {HALVINGS}), named_struct('lo', 0e0, 'hi', 1e0), (g, k) -> CASE WHEN {mass} < 2e0 * least({p}, 1e0 - {p}) "
             f"THEN named_struct('lo', {middle}, 'hi', g.hi) ELSE named_struct('lo', g.lo, 'hi', {middle}) END, g -> {middle})")
    size = f"transform(array({found}), x -> sqrt({df} * (1e0 - x) / x))[0]"
    return f"(CASE WHEN {p} IS NULL OR {df} IS NULL THEN NULL WHEN {p} = 5e-1 THEN 0e0 ELSE sign({p} - 5e-1) * {size} END)"
