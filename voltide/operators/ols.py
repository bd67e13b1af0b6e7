"""Ordinary least squares from sufficient statistics.

One aggregate gives the sums of every group at once (stock x fold x inner part); leaving a part
out is a subtraction of sums; the small normal equations are solved in column arithmetic, so no
group is ever collected.  A regressor that is collinear with earlier ones gets coefficient 0,
which leaves fitted values unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions.columns import C, col

PIVOT_TOLERANCE = 1e-10


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p + 1) for j in range(i, p + 1)]


def cross_sums(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Row count, sums and cross-product sums per key; variable ``len(xs)`` is the target."""
    v = [F.col(c) for c in [*xs, y]]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(v[i]).alias(f"s_{i}") for i in range(len(v))],
        *[F.sum(v[i] * v[j]).alias(f"p_{i}_{j}") for i, j in _pairs(len(xs))],
    )


def sum_names(p: int) -> list[str]:
    return ["n", *[f"s_{i}" for i in range(p + 1)], *[f"p_{i}_{j}" for i, j in _pairs(p)]]


def add_up(sums: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sum_names(p)])


def leave_part_out(sums: DataFrame, keys: Sequence[str], part: str, p: int) -> DataFrame:
    """Sums of all other parts of the same group (``keys`` must not be empty)."""
    names = sum_names(p)
    total = add_up(sums, keys, p).select(*keys, *[F.col(c).alias(f"t_{c}") for c in names])
    return sums.join(total, list(keys)).select(*keys, part, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])


def solve(sums: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """``keys, n, b_0 (intercept), b_1..b_p, rss`` from the sums.

    Symmetric elimination on the centred cross-products, one projection per regressor.  Written
    as SQL text because building hundreds of small column objects costs more than running them.
    """
    work = sums.selectExpr(
        *keys, "n", *[f"s_{i}" for i in range(p + 1)],
        *[f"p_{i}_{j} - try_divide(s_{i} * s_{j}, n) AS a_{i}_{j}" for i, j in _pairs(p)],
        *[f"p_{i}_{i} AS scale_{i}" for i in range(p)])
    kept = [*keys, "n", *[f"s_{i}" for i in range(p + 1)], *[f"scale_{i}" for i in range(p)]]
    ratios: list[str] = []
    for k in range(p):
        now = [f"u_{k}_{j}" for j in range(k + 1, p + 1)]
        work = work.selectExpr(
            *kept, *ratios, *[f"a_{i}_{j}" for i, j in _pairs(p) if i >= k],
            *[f"CASE WHEN a_{k}_{k} > {PIVOT_TOLERANCE}D * scale_{k} THEN try_divide(a_{k}_{j}, a_{k}_{k}) ELSE 0D END AS u_{k}_{j}"
              for j in range(k + 1, p + 1)])
        ratios += now
        work = work.selectExpr(*kept, *ratios, *[f"a_{i}_{j} - u_{k}_{i} * a_{k}_{j} AS a_{i}_{j}" for i, j in _pairs(p) if i > k])
    for k in reversed(range(p)):
        tail = "".join(f" - u_{k}_{j} * b_{j + 1}" for j in range(k + 1, p))
        work = work.selectExpr("*", f"u_{k}_{p}{tail} AS b_{k + 1}")
    used = "".join(f" - b_{k + 1} * s_{k}" for k in range(p))
    return work.selectExpr(*keys, "CAST(n AS BIGINT) AS n", f"try_divide(s_{p}{used}, n) AS b_0",
                           *[f"b_{k + 1}" for k in range(p)], f"greatest(a_{p}_{p}, 0D) AS rss")


def fit(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    return solve(cross_sums(df, keys, xs, y), keys, len(xs))


def linear_prediction(xs: Sequence[C]):
    out = F.col("b_0")
    for k, x in enumerate(xs, start=1):
        out = out + F.col(f"b_{k}") * col(x)
    return out


def predict(df: DataFrame, coefs: DataFrame, keys: Sequence[str], xs: Sequence[str], out: str,
            small: bool = False) -> DataFrame:
    """Join the coefficients of each group and add the fitted value.

    ``small=True`` broadcasts them: only for keys whose count is fixed (folds, inner parts).
    """
    right = coefs.drop("n", "rss")
    joined = df.join(F.broadcast(right) if small else right, list(keys))
    return joined.withColumn(out, linear_prediction(xs)).drop(*[f"b_{k}" for k in range(len(xs) + 1)])


def coefficient_table(coefs: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Long coefficient report with its sort rank: intercept first, then by absolute value."""
    items = [F.struct(F.lit("intercept").alias("feature"), F.col("b_0").alias("coefficient"), F.lit(0).alias("is_slope"))]
    items += [F.struct(F.lit(x).alias("feature"), F.col(f"b_{k}").alias("coefficient"), F.lit(1).alias("is_slope"))
              for k, x in enumerate(xs, start=1)]
    ordered = F.sort_array(F.transform(F.array(*items), lambda c: F.struct(
        c["is_slope"].alias("s"), (-F.abs(c["coefficient"])).alias("m"), c["feature"].alias("feature"),
        c["coefficient"].alias("coefficient"))))
    return coefs.select(*keys, F.posexplode(ordered).alias("position", "_c")).select(
        *keys, "position", "_c.feature", "_c.coefficient")
