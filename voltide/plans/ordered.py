"""Order statistics over whole tables without a single-task window.

Everything here starts from one range-partitioned sort.  The sorted rows are written once with
``monotonically_increasing_id`` (partition number in the upper bits, row number in the lower
33), so the position of a row is its partition's offset plus its row number.  The offsets have
one row per sort partition, which is what bounds the broadcast below.  Range partitions split
on the full ordering key, so one hot stock or one hot value never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltide.session import cut_lineage

_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def _sorted_once(df: DataFrame, order: Sequence[str]) -> DataFrame:
    tagged = df.orderBy(*order).withColumn("_gid", F.monotonically_increasing_id())
    return cut_lineage(tagged).withColumn("_part", F.shiftright("_gid", _ROW_BITS))


def _with_offsets(tagged: DataFrame, size: Column) -> DataFrame:
    """Join each row to the total size of all earlier sort partitions."""
    per_part = tagged.groupBy("_part").agg(size.alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return tagged.join(F.broadcast(offsets), "_part")


def with_global_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in the total order given by ``order`` (unique keys)."""
    tagged = _sorted_once(df, order)
    return (
        _with_offsets(tagged, F.count(F.lit(1)))
        .withColumn(name, F.col("_offset") + F.col("_gid").bitwiseAND(F.lit(_ROW_MASK)))
        .drop("_gid", "_part", "_offset")
    )


def with_weight_before(df: DataFrame, order: Sequence[str], weight: str, name: str = "before") -> DataFrame:
    """Add the summed ``weight`` of all rows strictly earlier in the total order."""
    tagged = _sorted_once(df, order)
    earlier = W.partitionBy("_part").orderBy("_gid").rowsBetween(W.unboundedPreceding, -1)
    return (
        _with_offsets(tagged, F.sum(weight))
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
        .drop("_gid", "_part", "_offset")
    )


def _value_positions(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with count, rows before the value, and group totals.

    Equal values collapse map-side, so ties never travel.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    pos = with_weight_before(counts, [*groups, "_v"], "_w", "_before")
    keys = list(groups) or [F.lit(0).alias("_all")]
    totals = pos.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min("_before").alias("_start"))
    if groups:
        joined = pos.join(totals, list(groups))
    else:
        joined = pos.withColumn("_all", F.lit(0)).join(F.broadcast(totals), "_all").drop("_all")
    return joined.withColumn("_before", F.col("_before") - F.col("_start")).drop("_start")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, exact at any group size.

    The built-in ``percentile`` keeps all distinct values of a group in one task; this sorts
    them across the cluster and reads off the two neighbouring order statistics.
    """
    pos = _value_positions(df, groups, value)
    aggs, outs = [], []
    for name, p in probs.items():
        target = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(target), F.ceil(target)

        def holds(rank: Column) -> Column:
            return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_w"))

        aggs += [
            F.max(F.when(holds(lo), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(hi), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(target - lo).alias(f"_fr_{name}"),
        ]
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                     * F.col(f"_fr_{name}")).alias(name))
    aggs.append(F.max("_n").alias("_n"))
    return pos.groupBy(*groups).agg(*aggs).select(*groups, *outs)


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Distinct values per group with their average rank (ties share the mean of their ranks)."""
    pos = _value_positions(df, groups, value)
    return pos.select(
        *groups, F.col("_v").alias(value),
        (F.col("_before") + (F.col("_w") + 1) / F.lit(2.0)).alias(rank),
    )


def lag_by_index(df: DataFrame, keys: Sequence[str], carry: Sequence[str], lag: int = 1,
                 idx: str = "idx", suffix: str = "_prev") -> DataFrame:
    """Attach the row ``lag`` positions earlier (same keys) through an equi-join on the index.

    Unlike a ``lag`` window this needs no partition that holds a whole series.
    """
    shifted = df.select(*keys, (F.col(idx) + lag).alias(idx), *[F.col(c).alias(c + suffix) for c in carry])
    return df.join(shifted, [*keys, idx], "left")
