"""Sharding by histogram sort.

Rows have a total order by (group hash, id). Splitters that cut it into shards of near equal bytes are
found by asking, again and again, how many bytes lie below a set of probe keys: every task counts its own
rows between probes, the counts are summed, and each splitter's interval shrinks to the gap between two
probes, until a probe is within tolerance. Then rows move once.

Probes first refine the group hash; only where one group is too heavy to fall on one side do they go on to
refine ids inside it. So rows of a group (equal texts) stay together unless the group itself is larger than
the tolerance. Rows equal in both keys stay together always.

Defined results: null sizes count 0, null ids sort first; an empty table has no rows; extra columns are kept, but
for columns named shard or slot, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import fresh, schema
from voltide.session import cut_lineage

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def counts_below(rows: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bytes, rows) strictly below each (h, k) probe. ``rows``: h, k bigint, size bigint; probes ascend.

    Each task sends one row per gap between probes at most, however many rows it reads.
    """
    ph, pk = (np.array(x, np.int64) for x in zip(*probes))

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, count = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        for b in batches:
            h, k, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            low = np.searchsorted(ph, h, "left")
            gap = np.searchsorted(ph, h, "right")
            tied = np.flatnonzero(low < gap)     # the same h as some probe: go on to k
            for lo in np.unique(low[tied]):
                mine = tied[low[tied] == lo]
                hi = gap[mine[0]]
                gap[mine] = lo + np.searchsorted(pk[lo:hi], k[mine], "right")
            count += np.bincount(gap, minlength=len(count))
            np.add.at(size, gap, s)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(count[used])], ["gap", "size", "n"])

    got = (rows.select("h", "k", "size").mapInArrow(gaps, schema("gap bigint, size bigint, n bigint"))
           .groupBy("gap").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect())
    size, count = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
    for r in got:
        size[r["gap"]], count[r["gap"]] = r["size"], r["n"]
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist()))


def find_splitters(rows: DataFrame, targets: list[int], tolerance: int, measure: str = "size",
                   fan_out: int = 24) -> list[tuple[int, int]]:
    """Keys (h, k) such that the ``measure`` (``size`` or ``n``) of all rows below is within ``tolerance``
    of each target, or as near as one key's rows allow.

    The driver holds targets x fan_out probes; a round is one pass over the key columns.
    """
    # an interval is (level, fixed h, low, high): the splitter lies in (low, high] of that level's key;
    # with the rows below either end it is known when one row is left and no splitter can be nearer
    state = [[0, 0, LOW, HIGH] for _ in targets]
    rows_at = [[0, HIGH] for _ in targets]
    best: list[tuple[float, tuple[int, int]]] = [(float("inf"), (HIGH, HIGH))] * len(targets)
    open_ = set(range(len(targets)))
    which = 0 if measure == "size" else 1
    while open_:
        probes: dict[tuple[int, int], None] = {}
        asked: dict[int, list[tuple[int, int]]] = {}
        for i in open_:
            level, h, low, high = state[i]
            width = high - low
            points = sorted({low + max(1, width * j // fan_out) for j in range(1, fan_out + 1)})
            asked[i] = [(p, LOW) if level == 0 else (h, p) for p in points]
            probes.update(dict.fromkeys(asked[i]))
        ordered = sorted(probes)
        counted = dict(zip(ordered, counts_below(rows, ordered)))
        below = {key: c[which] for key, c in counted.items()}
        for i in list(open_):
            level, h, low, high = state[i]
            for key in asked[i]:
                off = abs(below[key] - targets[i])
                if off < best[i][0]:
                    best[i] = (off, key)
            under = [p for p in asked[i] if below[p] <= targets[i]]
            over = [p for p in asked[i] if below[p] > targets[i]]
            new_low = under[-1][level] if under else low
            new_high = over[0][level] if over else high
            state[i][2:] = [new_low, new_high]
            rows_at[i] = [counted[under[-1]][1] if under else rows_at[i][0], counted[over[0]][1] if over else rows_at[i][1]]
            if best[i][0] <= tolerance or rows_at[i][1] - rows_at[i][0] <= 1:
                open_.discard(i)
            elif new_high - new_low <= 1:
                if level == 0:   # all that is left is the group with hash new_low
                    state[i] = [1, new_low, LOW, HIGH]
                else:
                    open_.discard(i)
    return [key for _, key in best]


def shard_rows(rows: DataFrame, shards: int, id_column: str = "doc_id", size: str = "size", group: str = "group_hash",
               tolerance: float = 0.005, part_rows: int = 4_000_000) -> DataFrame:
    """``rows`` plus shard (0 to shards - 1, bytes near equal) and slot (gapless from 0 within the shard).

    ``tolerance`` is the allowed error of a splitter as a share of a shard's bytes. A shard of more than
    ``part_rows`` rows is sorted in several parts, so no task gets a whole shard of a large corpus.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    h_, k_, s_, part_, row_, before_ = fresh(rows.columns, "h", "k", "s", "part", "row", "before")
    keyed = cut_lineage(rows.withColumns({
        h_: F.coalesce(F.col(group).cast("bigint"), F.lit(0)), k_: F.coalesce(F.col(id_column).cast("bigint"), F.lit(LOW)),
        s_: F.coalesce(F.col(size).cast("bigint"), F.lit(0))}))
    thin = keyed.selectExpr(f"`{h_}` AS h", f"`{k_}` AS k", f"`{s_}` AS size")
    total, count = thin.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-count // (shards * part_rows)))
    cuts = shards * parts
    targets = [total * i // cuts for i in range(1, cuts)]
    splitters = find_splitters(thin, targets, int(total * tolerance / shards)) if total and cuts > 1 else []
    splitters = sorted(splitters)
    sh = np.array([h for h, _ in splitters], np.int64)
    sk = np.array([k for _, k in splitters], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(b.schema.get_field_index(h_)).to_numpy(zero_copy_only=False)
            k = b.column(b.schema.get_field_index(k_)).to_numpy(zero_copy_only=False)
            low, part = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
            tied = np.flatnonzero(low < part)
            for lo in np.unique(low[tied]):
                mine = tied[low[tied] == lo]
                part[mine] = lo + np.searchsorted(sk[lo:part[mine[0]]], k[mine], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], [*b.schema.names, part_])

    placed = keyed.mapInArrow(place, T.StructType([*keyed.schema.fields, T.StructField(part_, T.IntegerType())]))
    # rows before each part within its shard: one row per part, a number fixed by the shard count and part_rows
    sizes = {r[part_]: r["n"] for r in placed.groupBy(part_).agg(F.count("*").alias("n")).collect()}
    before = [sum(sizes.get(q, 0) for q in range(p - p % parts, p)) for p in range(cuts)]
    starts = spark.createDataFrame(list(enumerate(before)), f"`{part_}` int, `{before_}` bigint")
    moved = placed.withColumn(row_, F.expr(f"row_number() OVER (PARTITION BY `{part_}` ORDER BY `{h_}`, `{k_}`)"))
    return moved.join(F.broadcast(starts), part_).select(
        *[F.col(f"`{c}`") for c in own], F.expr(f"CAST(`{part_}` DIV {parts} AS INT)").alias("shard"), (F.col(before_) + F.col(row_) - 1).alias("slot"))
