"""Self join of documents by Jaccard similarity of word shingles, exact, with universe-partition pigeonhole filters.

Sets whose sizes add up to t link only if they differ in at most t / 9 shingles (for a similarity of 0.8). Within a
size band the shingle universe is hashed into segments: if a pair differs in at most H shingles, then of any V > H
segments at least V - H are equal. A segment may also count twice, if it is indexed with its one-deletion
neighbourhood (itself and itself less one shingle, each), as that misses only pairs that differ there by two.

* Allocation. For each band a cost model chooses how many segments are exact, how many have neighbourhoods and how
  many are to spare, from the rows they make and from how often segments come out empty, and so alike in many sets.
* Subsets. A set may leave out as many exact segments as its own H leaves to spare. Both sides leave out the
  cheapest to share first (fewest shingles, then by hash), so a pair keeps at least one segment in common: of the
  segments it shares, each side can have left out only such as come before the last.
* Equal sets are one class from the start. A set is indexed in the band of every larger partner's size.
* Marks. A set has a bit for each bucket of shingles, whether their number is odd. Two sets differ in at least as many
  shingles as marks, so marks, about a fiftieth of the shingles, show that most pairs cannot link.
* Verification. Sets that meet in a segment are verified against the first of them, by marks and then on all their
  shingles; links make components. Where a segment's sets are in several components, they are compared with all others
  that such segments tie them to, block by block inside tasks. Passages common to unlike texts tie ever more sets as a
  table grows, so clusters of more than one block are parted by marks first. Segments within one component need no
  more, as nothing can change it.

Shingles and sets are named by 64-bit hashes; "exact" is up to their collisions.

Defined results: null or empty texts have no shingles and link with nothing, not even each other; fewer than five
words are one shingle; repeated rows are equal sets; a null doc_id never names a group that has another id;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import distinct_sorted, fresh, mix, schema, shingles, signed, text_slices
from voltide.llm.components import components
from voltide.llm.decontam import small
from voltide.session import cut_lineage

RATIO = 1.5                 # of a band's largest to its smallest size
BLOCK_SETS, BLOCK_TOKENS = 400, 200_000     # bounds of a block of sets that are compared at a time
SIFT_SETS, SIFT_BYTES = 4096, 1 << 22       # the same where marks are compared
SIZE_FLOORS = [1]                           # least sizes of ranges; linked sets are in one range or in two that follow each other
while SIZE_FLOORS[-1] < 1 << 40:
    SIZE_FLOORS.append(SIZE_FLOORS[-1] * 5 // 4 + 1)


# ---- bands and allocation -------------------------------------------------------------

def most_apart(total: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes sum to ``total``."""
    return total // 9


@lru_cache(None)
def band(k: int) -> tuple[int, int]:
    """Least and largest size of band k. Sizes below 5 link only with equal sets, or with larger ones."""
    low = 5 if k == 0 else band(k - 1)[1] + 1
    return low, max(low, int(low * RATIO) - 1)


def band_of(size: int) -> int:
    k = 0
    while band(k)[1] < size:
        k += 1
    return k


@lru_cache(None)
def allocation(k: int, crowd_cost: float = 200.0) -> tuple[int, int]:
    """(exact segments, segments with neighbourhoods) of band k, the cheapest by rows and expected crowding."""
    low, high = band(k)
    need, size = most_apart(2 * high) + 1, (low + high) / 2
    best = None
    for near in range(0, min(8, (need + 1) // 2) + 1):
        for spare in range(0, max(3, need // 2)):
            exact = max(0, need + spare - 2 * near)
            if exact + near == 0:
                continue
            held = size / (exact + near)            # shingles per segment
            empty = exact * math.exp(-held)         # segments expected empty, of which `spare` can be left out
            term, crowded = math.exp(-empty), 0.0
            for n in range(1, 60):
                term *= empty / n
                crowded += max(0, n - spare) * term
            cost = exact - spare + near * (1 + held) + crowd_cost * (crowded + near * math.exp(-held) * (1 + held))
            if best is None or cost < best[0]:
                best = cost, exact, near
    return best[1:]


def bands_to_meet(size: int) -> list[int]:
    """Bands in which a set of this size may meet a partner of its size or larger, or is met itself."""
    ks, k = [], band_of(size)
    while band(k)[0] <= size * 5 // 4:
        ks.append(k)
        k += 1
    return ks


def segment_keys(k: int, sizes: np.ndarray, owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set index, key) of what sets of one band index. ``owner`` gives each token's set, ascending."""
    exact, near = allocation(k)
    n, segments = len(sizes), exact + near
    spread = mix(token + np.uint64(0x5EED))
    segment = (mix(token ^ np.uint64(0xA5A5 + k)) % np.uint64(segments)).astype(np.int64)
    cell = owner * segments + segment
    sums = np.zeros(n * segments, np.uint64)
    np.add.at(sums, cell, spread)
    salt = np.tile(mix(np.arange(segments, dtype=np.uint64) + np.uint64((k + 1) << 32)), n)
    keys = mix(sums + salt).reshape(n, segments)
    held = np.bincount(cell, minlength=n * segments).reshape(n, segments)
    owners, out = [], []
    if exact:
        low, high = band(k)
        partner = np.minimum(high, sizes * 5 // 4)
        spare = exact + 2 * near - (sizes + partner) // 9 - 1
        order = np.lexsort((keys[:, near:], held[:, near:]), axis=-1)
        ordered = np.take_along_axis(keys[:, near:], order, 1)
        kept = np.arange(exact)[None, :] >= spare[:, None]
        owners.append(np.nonzero(kept)[0])
        out.append(ordered[kept])
    if near:
        owners.append(np.repeat(np.arange(n), near))
        out.append(keys[:, :near].reshape(-1))
        there = segment < near
        owners.append(owner[there])
        out.append(mix(sums[cell[there]] - spread[there] + salt[cell[there]]))
    return np.concatenate(owners), np.concatenate(out)


# ---- passes over the texts ---------------------------------------------------------------

def set_names(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit name) of each row's set."""
    size = np.bincount(row, minlength=rows)
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, mix(token + np.uint64(0x5E7)))
    return size, signed(mix(total + size.astype(np.uint64)))


def with_set_name(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles and name of the set, per row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches):
            size, name = set_names(*distinct_sorted(*shingles(data, ends)), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size), pa.array(name)], ["doc_id", "th", "n_shingles", "name"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        rows, schema("doc_id bigint, th bigint, n_shingles bigint, name bigint"))


def index_rows(docs: DataFrame) -> DataFrame:
    """(key, name) of every set; equal sets of one task are indexed once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, ends in text_slices(batches):
            row, token = distinct_sorted(*shingles(data, ends))
            size, name = set_names(row, token, part.num_rows)
            new = np.zeros(part.num_rows, bool)
            for i in np.flatnonzero(size >= 4):
                if name[i] not in seen:
                    seen.add(name[i])
                    new[i] = True
            groups: dict[int, list[int]] = {}
            for i in np.flatnonzero(new):
                for k in bands_to_meet(int(size[i])):
                    groups.setdefault(k, []).append(i)
            for k, members in groups.items():
                members = np.array(members)
                place = np.full(part.num_rows, -1)
                place[members] = np.arange(len(members))
                mine = place[row] >= 0
                owner, key = segment_keys(k, size[members], place[row[mine]], token[mine])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(name[members][owner])], ["key", "name"])

    return docs.select("doc_id", "text").mapInArrow(rows, schema("key bigint, name bigint"))


def shared_keys(index: DataFrame) -> DataFrame:
    """(key, name, first) of keys that several sets share; ``first`` is the least name. Streams through sorted keys."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_name = first = None
        alone = True
        for b in batches:
            key, name = b.column(0).to_numpy(), b.column(1).to_numpy()
            n = len(key)
            if not n:
                continue
            new_key = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            repeat = ~new_key & np.concatenate([[last_name is not None and name[0] == last_name], name[1:] == name[:-1]])
            at = np.maximum.accumulate(np.where(new_key, np.arange(n), -1))
            head = np.where(at >= 0, name[np.maximum(at, 0)], first if first is not None else 0)
            out = ~new_key & ~repeat
            # the first set of a key is reported with its second one
            second = out.copy()
            seen_before = np.zeros(n, bool)
            run = np.cumsum(new_key)
            idx = np.flatnonzero(out)
            if len(idx):
                lead = np.concatenate([[True], run[idx[1:]] != run[idx[:-1]]])
                if run[idx[0]] == 0 and not alone:
                    lead[0] = False
                second[:] = False
                second[idx[lead]] = True
            keys = np.concatenate([key[out], key[second]])
            names = np.concatenate([name[out], head[second]])
            heads = np.concatenate([head[out], head[second]])
            tail = run == run[-1]
            alone = not (out & tail).any() and (alone if run[-1] == 0 else True)
            last_key, last_name, first = key[-1], name[-1], head[-1]
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names), pa.array(heads)], ["key", "name", "first"])

    return index.repartition("key").sortWithinPartitions("key", "name").mapInArrow(rows, schema("key bigint, name bigint, first bigint"))


# ---- verification --------------------------------------------------------------------------

FIRST_ROW = "min(struct(doc_id IS NULL AS no_id, doc_id, th))"


def marks(row: np.ndarray, token: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of each row's set, the parities of its shingles by bucket as bits: a power of two of buckets, 64 and ``size`` at least."""
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(bits)])
    at = stops[row] + (mix(token + np.uint64(0x0DD)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=stops[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[i // 8:j // 8] for i, j in zip(stops, stops[1:])]


def folded(mark: bytes, length: int) -> bytes:
    """What ``marks`` gives with fewer buckets: ``length`` bytes."""
    if len(mark) == length:
        return mark
    return np.bitwise_xor.reduce(np.frombuffer(mark, np.uint64).reshape(-1, length // 8), 0).tobytes()


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, size, size_range, marks, tokens) of the wanted names, tokens as packed sorted 64-bit integers, read from one document each."""
    ids = cut_lineage(wanted.join(classes, "name").select(F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th")))
    held = docs.select("doc_id", "text").join(small(ids), F.expr("doc_id <=> one_id AND xxhash64(text) = one_th"), "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches):
            row, token = distinct_sorted(*shingles(data, ends))
            size, name = set_names(row, token, part.num_rows)
            raw = token.tobytes()
            stops = np.concatenate([[0], np.cumsum(size)]) * 8
            packed = [raw[i:j] for i, j in zip(stops, stops[1:])]
            size_range = np.searchsorted(SIZE_FLOORS, size, "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(size), pa.array(size_range), pa.array(marks(row, token, size), pa.binary()), pa.array(packed, pa.binary())],
                ["name", "size", "size_range", "marks", "tokens"])

    return cut_lineage(held.mapInArrow(rows, schema("name bigint, size bigint, size_range bigint, marks binary, tokens binary")).dropDuplicates(["name"]))


def may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of names that sizes and marks allow to link."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.minimum(x, y) * 5 >= np.maximum(x, y) * 4
            for i in np.flatnonzero(keep):
                one, two = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                length = min(len(one), len(two))
                apart = (int.from_bytes(folded(one, length), "little") ^ int.from_bytes(folded(two, length), "little")).bit_count()
                keep[i] = apart <= most_apart(int(x[i] + y[i]))
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = sets.selectExpr("name AS a", "size AS na", "marks AS ma")
    right = sets.selectExpr("name AS b", "size AS nb", "marks AS mb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(rows, schema("a bigint, b bigint"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of names that link: 100 x intersection >= 80 x union."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if min(len(x), len(y)) * 5 < max(len(x), len(y)) * 4:
                    continue
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= 80 * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    # only the sets of a pair are shuffled
    left = sets.selectExpr("name AS a", "tokens AS ta").join(small(pairs), "a")
    right = sets.selectExpr("name AS b", "tokens AS tb").join(small(pairs), "b")
    return left.join(right, ["a", "b"]).select("a", "b", "ta", "tb").mapInArrow(rows, schema("a bigint, b bigint"))


def in_blocks(clusters: DataFrame) -> DataFrame:
    """``clusters`` (name, cluster, size) plus block and blocks: bounded by sets and by shingles, dealt by hash."""
    sized = cut_lineage(clusters.groupBy("cluster").agg(F.expr(
        f"CAST(ceil(greatest(count(*) / {BLOCK_SETS}, sum(size) / {BLOCK_TOKENS})) AS INT)").alias("blocks")))
    return clusters.join(sized, "cluster").withColumn("block", F.expr("CAST(pmod(xxhash64(name), blocks) AS INT)"))


def met(placed: DataFrame) -> DataFrame:
    """(cluster, i, j, block, name): every two blocks of a cluster, and each block with itself."""
    return placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr(
        "cluster", "least(block, other) AS i", "greatest(block, other) AS j", "block", "name")


def cross_links(live: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets that share a key but not a component, beyond the pairs with the first set of a key.

    Sets that keys with several components hold together make a cluster, so that sets which share many keys meet
    once. A cluster is cut into blocks by hash and a task compares two blocks, of which it reports links that
    join them and no more. Blocks are bounded by sets and by shingles, and no pair becomes a row.
    """
    known = cut_lineage(sets.select("name", "size").join(
        labels.withColumnRenamed("node", "name"), "name", "left").selectExpr("name", "size", "coalesce(component, name) AS component"))
    marked = cut_lineage(live.join(known, "name").select("key", "name", "first", "component"))
    mixed = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y AND n > 2")
    together = marked.where("name <> first").join(cut_lineage(mixed.select("key")), "key").selectExpr("name AS a", "first AS b")
    clusters = cut_lineage(components(together).selectExpr("node AS name", "component AS cluster").join(known, "name"))
    dealt = met(cut_lineage(compared(clusters, sets)))
    return sets.select("name", "tokens").join(small(dealt), "name").groupBy("cluster", "i", "j").applyInArrow(compare_blocks, schema("a bigint, b bigint"))


def compared(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(name, cluster, block, blocks) of the sets that are to be compared on their shingles: clusters of one block as they are, larger ones parted."""
    placed = cut_lineage(in_blocks(clusters).select("name", "cluster", "size", "component", "block", "blocks"))
    large = placed.where("blocks > 1").select("name", "cluster", "size", "component")
    parted = cut_lineage(components(cut_lineage(sifted(large, sets))).selectExpr("node AS name", "component AS cluster").join(
        large.select("name", "size"), "name"))
    columns = ["name", "cluster", "block", "blocks"]
    return placed.where("blocks = 1").select(columns).unionByName(in_blocks(parted).select(columns))


def sifted(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a forest of the pairs that differ in component but that sizes and marks allow to link.

    A cluster's sets are dealt by size range into blocks, and a task compares two blocks of a range or of two that follow
    each other. The blocks are larger than those of shingles, as marks are small.
    """
    rows = cut_lineage(clusters.join(sets.select("name", "size_range", "marks"), "name"))
    sized = cut_lineage(rows.groupBy("cluster", "size_range").agg(F.expr(
        f"CAST(ceil(greatest(count(*) / {SIFT_SETS}, sum(octet_length(marks)) / {SIFT_BYTES})) AS INT)").alias("blocks")))
    beside = lambda d, name: sized.selectExpr("cluster", f"size_range + {d} AS size_range", f"blocks AS {name}")
    around = sized.join(beside(1, "below"), ["cluster", "size_range"], "left").join(beside(-1, "above"), ["cluster", "size_range"], "left")
    placed = rows.join(around, ["cluster", "size_range"]).withColumn("block", F.expr("CAST(pmod(xxhash64(name), blocks) AS INT)"))
    each = lambda n, pair: f"IF({n} > 0, transform(sequence(0, {n} - 1), o -> {pair}), array())"
    tasks = ", ".join([
        each("blocks", "struct(size_range AS least, false AS two, least(block, o) AS i, greatest(block, o) AS j, block = least(block, o) AS is_i)"),
        each("above", "struct(size_range AS least, true AS two, block AS i, o AS j, true AS is_i)"),
        each("below", "struct(size_range - 1 AS least, true AS two, o AS i, block AS j, false AS is_i)")])
    dealt = placed.withColumn("task", F.explode(F.expr(f"concat({tasks})"))).selectExpr(
        "cluster", "task.least", "task.two", "task.i", "task.j", "task.is_i", "name", "size", "component", "marks")
    return dealt.groupBy("cluster", "least", "two", "i", "j").applyInArrow(sift_blocks, schema("a bigint, b bigint"))


def sift_blocks(table: pa.Table) -> pa.Table:
    """A forest of the pairs of the two blocks (or of the one) of a group that may link and differ in component."""
    name, size, component, is_i = (table.column(c).to_numpy() for c in ("name", "size", "component", "is_i"))
    raw = table.column("marks").to_pylist()
    length = min(len(m) for m in raw)
    mark = np.frombuffer(b"".join(folded(m, length) for m in raw), np.uint64).reshape(len(raw), -1)
    alone = table.column("i")[0] == table.column("j")[0] and not table.column("two")[0].as_py()
    one, two = np.flatnonzero(is_i), np.arange(len(raw)) if alone else np.flatnonzero(~is_i)
    two_marks, group, out = np.ascontiguousarray(mark[two].T), np.arange(len(raw)), []
    step = max(1, (1 << 20) // max(1, len(two)))
    for s in range(0, len(one) if len(two) else 0, step):
        part = one[s:s + step]
        apart = np.zeros((len(part), len(two)), np.int32)
        for k, column in enumerate(two_marks):
            apart += np.bitwise_count(mark[part, k][:, None] ^ column)
        x, y = size[part][:, None], size[two]
        may = (9 * apart <= x + y) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (component[part][:, None] != component[two])
        for r in np.flatnonzero(may.any(1)):
            met_groups, at = np.unique(group[two[may[r]]], return_index=True)
            other = met_groups != group[part[r]]
            if other.any():
                out += [(name[part[r]], name[q]) for q in two[may[r]][at[other]]]
                group[np.isin(group, met_groups)] = group[part[r]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def compare_blocks(table: pa.Table) -> pa.Table:
    """A forest of the links between the two blocks (or inside the one) of a group."""
    names, block = table.column("name").to_numpy(), table.column("block").to_numpy()
    tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    size = np.array([len(x) for x in tokens])
    one, two = (np.flatnonzero(block == b) for b in (block.min(), block.max()))
    owner = np.repeat(np.arange(len(tokens)), size)
    _, column, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]     # the rest adds to no intersection
    shared = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [s, s + 4096])
        holds = np.zeros((len(tokens), 4096), np.float32)
        holds[owner[a:b], column[a:b] - s] = 1
        shared += holds[one] @ holds[two].T
    both = np.rint(shared).astype(np.int64)
    linked = 100 * both >= 80 * (size[one][:, None] + size[two][None, :] - both)
    parent = list(range(len(tokens)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*(z.tolist() for z in np.nonzero(linked))):
        p, q = find(int(one[x])), find(int(two[y]))
        if p != q:
            parent[p] = q
            out.append((names[one[x]], names[two[y]]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component (of sets; null without shingles) and component_id, per row of ``docs``."""
    members = cut_lineage(with_set_name(docs))
    classes = cut_lineage(members.where("n_shingles > 0").groupBy("name").agg(F.expr(FIRST_ROW).alias("one"), F.min("doc_id").alias("doc_id")))
    live = cut_lineage(shared_keys(index_rows(docs)))
    first = cut_lineage(live.where("name <> first").selectExpr("least(name, first) AS a", "greatest(name, first) AS b").distinct())
    names = cut_lineage(live.select("name").distinct())
    sets = sets_of(docs, classes, names)
    links = cut_lineage(verify(cut_lineage(may_link(first, sets)), sets))
    labels = components(links)
    more = cut_lineage(cross_links(live, labels, sets))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = cut_lineage(classes.join(labels.selectExpr("node AS name", "component"), "name", "left").selectExpr(
        "name", "doc_id", "coalesce(component, name) AS component"))
    least = cut_lineage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    groups = cut_lineage(named.join(least, "component").select("name", "component", "component_id"))
    linked = members.where("n_shingles > 0").join(groups, "name").select("doc_id", "th", "n_shingles", "component", "component_id")
    return linked.unionByName(members.where("n_shingles = 0").selectExpr(
        "doc_id", "th", "n_shingles", "CAST(NULL AS BIGINT) AS component", "doc_id AS component_id"))


def link_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, per row of ``docs``."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, rows without one last.

    Rows are told apart by doc_id and text, so rows without an id, or with an id that another text has, count like others.
    """
    rows = cut_lineage(grouped(docs).where("component IS NOT NULL").drop("component_id"))
    keep = cut_lineage(rows.groupBy("component").agg(F.expr(FIRST_ROW).alias("keep")))
    gone = cut_lineage(rows.join(keep, "component").where("NOT (doc_id <=> keep.doc_id AND th = keep.th)").selectExpr(
        "doc_id AS one_id", "th AS one_th").distinct())
    id_, th_ = fresh(docs.columns, "one_id", "one_th")
    same_row = F.expr(f"doc_id <=> `{id_}` AND xxhash64(text) = `{th_}`")
    named = lambda f: small(f.select(F.col("one_id").alias(id_), F.col("one_th").alias(th_)))
    kept = docs.join(named(gone), same_row, "left_anti")
    repeated = cut_lineage(rows.groupBy("doc_id", "th").count().where("count > 1").selectExpr("doc_id AS one_id", "th AS one_th"))
    if repeated.isEmpty():
        return kept
    one = kept.join(named(repeated), same_row, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(named(repeated), same_row, "left_anti").unionByName(one)
