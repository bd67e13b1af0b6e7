"""Pairwise sums between all stocks as a blocked cross-product.

A self-join on ``time_id`` would shuffle one row per pair per snapshot.  Here each task takes a
block of stocks against a block of stocks for one slice of snapshots, multiplies the two
matrices, and emits one row of sums per pair, so the shuffle carries one row per pair per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.functions.aggregates import corr_from_sums

BLOCK_STOCKS = 256
SLICE_SNAPSHOTS = 4096

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _block_products(extra: Sequence[str], touching: Sequence[int] | None = None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times, t = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        is_left = pdf["left"].to_numpy()
        sid, val = pdf["sid"].to_numpy(), pdf["v"].to_numpy()

        def dense(side):
            ids, pos = np.unique(sid[side], return_inverse=True)
            x = np.zeros((len(times), len(ids)))
            m = np.zeros_like(x)
            x[t[side], pos] = val[side]
            m[t[side], pos] = 1.0
            return ids, x, m

        li, x, mx = dense(is_left)
        rj, y, my = dense(~is_left)
        sums = (mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y)
        keep = (li[:, None] < rj[None, :]) & (sums[0] > 0)
        if touching is not None:
            keep &= np.isin(li, touching)[:, None] | np.isin(rj, touching)[None, :]
        i, j = np.nonzero(keep)
        out = {name: [pdf[name].iloc[0]] * len(i) for name in extra}
        out |= {"stock_a": li[i], "stock_b": rj[j]}
        out |= {name: s[i, j] for name, s in zip(_SUMS, sums)}
        return pd.DataFrame(out)
    return run


def pair_sums(left: DataFrame, right: DataFrame, extra: Sequence[str] = (), n_slices: int | None = None,
              touching: Sequence[int] | None = None) -> DataFrame:
    """Sums over rows with both sides present for every stock pair a < b, or those with a stock of ``touching``.

    Both inputs have columns ``*extra, t, sid, v`` with (extra, t, sid) unique.
    """
    stats = left.agg(
        F.approx_count_distinct("t").alias("snapshots"),
        F.collect_set(F.floor(F.col("sid") / BLOCK_STOCKS)).alias("blocks"),
    ).first()
    blocks = sorted(stats["blocks"])
    slices = n_slices or -(-max(stats["snapshots"], 1) // SLICE_SNAPSHOTS)
    all_blocks = F.array(*[F.lit(b).cast("bigint") for b in blocks])

    def placed(df: DataFrame, is_left: bool) -> DataFrame:
        named = df.select(
            *extra, "t", F.col("sid").cast("int").alias("sid"), F.col("v").cast("double").alias("v"),
            F.pmod(F.xxhash64("t"), F.lit(slices)).alias("_slice"), F.floor(F.col("sid") / BLOCK_STOCKS).alias("_own"))
        own = F.col("_own")
        partner = F.explode(F.filter(all_blocks, lambda b: b >= own if is_left else b <= own)).alias("_partner")
        pair = (own, F.col("_partner")) if is_left else (F.col("_partner"), own)
        return named.where(F.col("v").isNotNull()).select("*", partner).select(
            *extra, "t", "sid", "v", "_slice", F.lit(is_left).alias("left"), pair[0].alias("_bi"), pair[1].alias("_bj"))

    rows = placed(left, True).unionByName(placed(right, False))
    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in extra] + ["stock_a int", "stock_b int"]
                       + [f"{s} double" for s in _SUMS])
    partial = rows.groupBy(*extra, "_bi", "_bj", "_slice").applyInPandas(_block_products(extra, touching), schema)
    return partial.groupBy(*extra, "stock_a", "stock_b").agg(*[F.sum(s).alias(s) for s in _SUMS])


def pair_correlations(left: DataFrame, right: DataFrame | None = None, extra: Sequence[str] = (),
                      min_rows: int = 2, touching: Sequence[int] | None = None) -> DataFrame:
    """``*extra, stock_a, stock_b, n, corr`` for every pair with at least ``min_rows`` rows."""
    sums = pair_sums(left, left if right is None else right, extra, touching=touching)
    return sums.where(F.col("n") >= min_rows).select(
        *extra, "stock_a", "stock_b", F.col("n").cast("bigint").alias("n"),
        corr_from_sums("n", "sx", "sy", "sxx", "syy", "sxy").alias("corr"),
    )
