"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

Every byte is removed that is covered by a string of ``length`` bytes which also starts anywhere else in the corpus,
in the same document or another one; strings do not cross documents.

1. Initial buckets. In each string of ``length`` bytes the q-gram of least hash is its pointer, so equal strings
   point at equal q-grams at equal offsets. One place in about ``(length - q) / 2`` is pointed at. The q-gram's hash is
   the bucket; buckets with one place are resolved and dropped.
2. Contexts. A place and the bytes around it that its strings cover are a context. Equal contexts are one, with a count
   that combines before its shuffle, and are settled if there are two; a text names each of its contexts once.
3. Refinement. The strings of a bucket's distinct contexts are ordered by the bucket identifiers of their first 8
   bytes, then by the pairs of identifiers at offsets 0 and 8, 0 and 16 and so on: each step doubles the depth by
   reusing the identifiers of the step before at a later offset, until ``length`` bytes are told apart. Strings
   left in one bucket are equal.
4. Large buckets. A bucket of more than ``crowd`` distinct contexts is first refined by content across tasks: its
   strings are halved by offset, again and again, and each half goes to the bucket of the bytes that all strings of the
   half share. Halves that agree entirely are settled and go on as one; halves alone in their bucket are dropped.
5. Runs of equal strings become spans, spans of a document are united and cut out.

Nothing that a key groups is gathered in a task beyond ``crowd`` contexts; counts combine first, and the joins that lead
results back to texts are ones that adaptive execution can split. Buckets of q-grams are 64-bit hashes, which only
cost time where they collide; texts, contexts and halves are named by 128 bits of a cryptographic digest.

Defined results: null is an empty text; texts shorter than ``length`` lose nothing; repeated rows are equal
texts and lose all of it; extra columns and ids of any kind pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import fresh, prefix_hash, schema, signed, substring_hash, text_slices
from voltide.llm.decontam import small
from voltide.session import cut_lineage

LENGTH, Q = 200, 32
CROWD = 8192
CHUNK = 1 << 22
BATCH_BYTES = 1 << 22


def text_key(text):
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for x in parts:
        h.update(x)
    return h.digest()


# ---- places ---------------------------------------------------------------------------

def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks of that width."""
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    n = len(key) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def places(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """(row, q-gram hash, place, first, last): strings starting at first..last (in the row) point at place."""
    none = np.zeros(0, np.int64)
    starts = len(data) - length + 1
    if starts <= 0:
        return none, none.astype(np.uint64), none, none, none
    at = np.arange(len(data) - q + 1)
    h = substring_hash(prefix_hash(data, False), at, at + q)
    width = length - q + 1
    low = np.uint64((1 << 24) - 1)
    chosen = np.empty(starts, np.int64)
    for s in range(0, starts, CHUNK):
        e = min(s + CHUNK, starts)
        part = h[s:e + width - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)     # equal hashes: the first place
        chosen[s:e] = (sliding_least(key, width) & low).astype(np.int64) + s
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    p = np.flatnonzero(row[:starts] == row[length - 1:])
    if not len(p):
        return none, none.astype(np.uint64), none, none, none
    c = chosen[p]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)])
    first = p[new]
    last = p[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(p) - 1]])]
    place, r = c[new], row[first]
    base = ends[r]
    return r, h[place], place - base, first - base, last - base


def place_rows(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(key, text_key, place) of every text; equal texts of one task are read once. ``docs``: text_key, text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, data, ends in text_slices(batches):
            names = part.column(0)
            row, h, place, _, _ = places(data, ends, length, q)
            new = np.zeros(len(names), bool)
            for i in np.flatnonzero(np.diff(ends) >= length):
                name = names[i].as_py()
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            mine = new[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h[mine])), names.take(pa.array(row[mine])), pa.array(place[mine])], ["key", "text_key", "place"])

    return docs.select("text_key", "text").mapInArrow(rows, schema("key bigint, text_key binary, place bigint"))


def shared_places(rows: DataFrame) -> DataFrame:
    """The rows whose key has another place too. What is counted by key combines before its shuffle."""
    spot = F.xxhash64("text_key", "place")
    keys = cut_lineage(rows.groupBy("key").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("key"))
    return rows.join(small(keys), "key", "left_semi")


# ---- refinement --------------------------------------------------------------------------

def string_buckets(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifier of the string of ``length`` bytes at every offset: equal strings, equal identifiers."""
    depth = 8
    ids = np.zeros(len(data) - depth + 1, np.uint64)
    for k in range(depth):
        ids |= data[k:len(data) - depth + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    ids = np.unique(ids, return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        n = len(ids) - step
        ids = np.unique(ids[:n] * np.int64(len(ids) + 1) + ids[step:step + n], return_inverse=True)[1]
        depth += step
    return ids


def refine(rows: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of bytes covered by equal strings. ``rows``: the distinct contexts of whole buckets."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    ids = string_buckets(data, length)
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    mine = ids[starts[owner] + offset]
    equal = np.bincount(mine)[mine] > 1
    run = np.flatnonzero(equal & np.concatenate([[True], ~equal[:-1] | (owner[1:] != owner[:-1])]))
    stop = np.flatnonzero(equal & np.concatenate([~equal[1:] | (owner[1:] != owner[:-1]), [True]]))
    return list(zip(owner[run].tolist(), offset[run].tolist(), (offset[stop] + length).tolist()))


CONTEXTS = "ctx binary, key binary, rel int, n bigint, bytes binary, text_key binary, firsts array<bigint>"
SPANS = "ctx binary, start int, end int"
SPANS_ARROW = pa.schema([("ctx", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])


def batch(columns: list, names: str, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names.split())


def context_rows(texts: DataFrame, length: int, q: int) -> DataFrame:
    """Two kinds of rows. With bytes: a context, its place's offset in it and how often a task saw it.
    With text_key: a context of a text and where in the text it begins, each time."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = "ctx key rel n bytes text_key firsts"
        held: dict[bytes, list] = {}
        weight = 0

        def flush() -> pa.RecordBatch:
            none = [None] * len(held)
            key, rel, n, raw = zip(*held.values())
            return batch([list(held), key, rel, n, raw, none, none], names, types)

        for part, data, ends in text_slices(batches):
            lists = part.column(2)
            row, h, place, first, last = places(data, ends, length, q)
            lengths = np.array([len(x) for x in lists])
            wanted = np.repeat(np.arange(part.num_rows), lengths) << 40 | np.concatenate([np.asarray(x.as_py(), np.int64) for x in lists])
            at = np.flatnonzero(np.isin(row << 40 | place, wanted))
            raw = data.tobytes()
            seen: dict[tuple[int, bytes], list[int]] = {}
            base = ends[row[at]]
            for r, k, rel, f, i, j in zip(row[at].tolist(), signed(h[at]).tolist(), (place[at] - first[at]).tolist(), first[at].tolist(),
                                          (base + first[at]).tolist(), (base + last[at] + length).tolist()):
                x = raw[i:j]
                k = k.to_bytes(8, "big", signed=True)
                ctx = digest(k, rel.to_bytes(4, "big"), x)
                if (r, ctx) in seen:
                    seen[r, ctx].append(f)
                else:
                    seen[r, ctx] = [f]
                if ctx in held:
                    held[ctx][2] += 1
                else:
                    held[ctx] = [k, rel, 1, x]
                    weight += len(x) + 200
            if seen:
                none = [None] * len(seen)
                owners = part.column(0).take(pa.array([r for r, _ in seen]))
                yield batch([[c for _, c in seen], none, none, none, none, owners, list(seen.values())], names, types)
            if weight > BATCH_BYTES:
                yield flush()
                held.clear()
                weight = 0
        if held:
            yield flush()

    return texts.mapInArrow(rows, schema(CONTEXTS))


def resolve(rows: DataFrame, length: int) -> DataFrame:
    """(ctx, start, end): repeated bytes of contexts, one row a run. ``rows``: bucket, ctx, at (what start counts from),
    settled (known to be repeated whole, so not reported) and bytes; those of one bucket are distinct."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: list[tuple] = []
        key, held = None, 0

        def spans() -> pa.RecordBatch:
            found = [(done[i][0], done[i][1] + s, done[i][1] + e) for i, s, e in refine([d[3] for d in done], length) if not done[i][2]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 3, SPANS_ARROW)], schema=SPANS_ARROW)

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if len(now) > 1:
                        done += now
                        held += sum(len(x[3]) for x in now)
                    if held > 1 << 20:
                        yield spans()
                        done, held = [], 0
                    now, key = [], k
                now.append(tuple(row))
        if len(now) > 1:
            done += now
        if done:
            yield spans()

    return rows.select("bucket", "ctx", "at", "settled", "bytes").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(stream, schema(SPANS))


def halves(rows: DataFrame, level: int, length: int, q: int) -> DataFrame:
    """The strings of each row that begin in one aligned range of 2**level offsets, in the bucket of what they all share."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bucket, ctx, at, rel, settled, x in zip(*(c.to_pylist() for c in b.columns)):
                low = length - q - rel                        # offset of the first string, counted from the least possible
                high = low + len(x) - length
                for i in range(low >> level, (high >> level) + 1):
                    a, z = max(i << level, low), min((i + 1 << level) - 1, high)
                    part = x[a - low:z - low + length]
                    core = x[(i + 1 << level) - 1 - low:(i << level) - low + length]
                    out.append((digest(bucket, bytes([level, i]), core), digest(bytes([a, z]), part), ctx, at + a - low, rel - (a - low), settled, part))
            if out:
                yield batch(list(zip(*out)), "bucket same ctx at rel settled bytes",
                            [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()])

    return rows.select("bucket", "ctx", "at", "rel", "settled", "bytes").mapInArrow(
        split, schema("bucket binary, same binary, ctx binary, at int, rel int, settled boolean, bytes binary"))


def split_large(rows: DataFrame, length: int, q: int, crowd: int) -> list[DataFrame]:
    """Spans (ctx, start, end) of the buckets in ``rows`` (bucket, ctx, at, rel, settled, bytes), however large."""
    found = []
    for level in range((length - q).bit_length() - 1, -1, -1):
        parts = cut_lineage(halves(rows, level, length, q))
        kinds = cut_lineage(parts.groupBy("bucket", "same").agg(F.count("*").alias("n"), F.max("settled").alias("known"), F.min("ctx").alias("one")))
        many = small(kinds.where("n > 1").select("bucket", "same"))
        found.append(parts.where("NOT settled").join(many, ["bucket", "same"], "left_semi").selectExpr("ctx", "at AS start", f"at + octet_length(bytes) AS end"))
        buckets = cut_lineage(kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min((F.col("n") > 1) | F.col("known")).alias("over"))
                              .where("kinds > 1 AND NOT over").select("bucket", "kinds"))
        ones = small(kinds.selectExpr("bucket", "same", "one AS ctx", "n > 1 OR known AS known"))
        left = parts.drop("settled").join(ones, ["bucket", "same", "ctx"]).withColumnRenamed("known", "settled").dropDuplicates(["bucket", "same"])
        left = cut_lineage(left.join(small(buckets), "bucket"))
        found.append(resolve(left.where(f"kinds <= {crowd}"), length))
        rows = left.where(f"kinds > {crowd}").drop("kinds", "same")
        if rows.isEmpty():
            break
    return found


def equal_strings(texts: DataFrame, length: int, q: int, crowd: int) -> DataFrame:
    """(text_key, firsts, starts, ends): contexts of a text, where they begin, and what in them is repeated.
    ``texts``: text_key, text, places (its shared places)."""
    rows = cut_lineage(context_rows(texts, length, q))
    each = cut_lineage(rows.where("bytes IS NOT NULL").groupBy("ctx").agg(
        F.first("key").alias("key"), F.first("rel").alias("rel"), F.sum("n").alias("n"), F.first("bytes").alias("bytes")).selectExpr(
        "key AS bucket", "ctx", "0 AS at", "rel", "n > 1 AS settled", "bytes"))
    large = cut_lineage(each.groupBy("bucket").count().where(f"count > {crowd}").select("bucket"))
    spans = [each.where("settled").selectExpr("ctx", "0 AS start", "octet_length(bytes) AS end")]
    if large.isEmpty():
        spans.append(resolve(each, length))
    else:
        spans.append(resolve(each.join(small(large), "bucket", "left_anti"), length))
        spans += split_large(each.join(small(large), "bucket", "left_semi"), length, q, crowd)
    of_context = cut_lineage(reduce(DataFrame.unionByName, spans).groupBy("ctx").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    return rows.where("text_key IS NOT NULL").select("ctx", "text_key", "firsts").join(of_context, "ctx").selectExpr(
        "text_key", "firsts", "spans.start AS starts", "spans.end AS ends")


def cut_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """(bytes left, starts and ends of the united spans)."""
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    s, e = s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]
    kept = [data[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(data)])]
    return b"".join(kept), s.tolist(), e.tolist()


def repeated_bytes(docs: DataFrame, length: int = LENGTH, q: int = Q, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(members, texts): members has text_key, n_bytes and copies for each row of ``docs`` (doc_id, text);
    texts has text_key, starts, ends and kept (bytes left) of single texts that lose something.

    Texts of several copies are not in ``texts``: they lose everything if they have ``length`` bytes.
    """
    named = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = cut_lineage(named.selectExpr("doc_id", "text_key", "CAST(octet_length(text) AS BIGINT) AS n_bytes"))
    counts = cut_lineage(rows.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1"))
    members = rows.join(counts, "text_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    found = shared_places(cut_lineage(place_rows(named, length, q)))
    shared = cut_lineage(found.groupBy("text_key").agg(F.collect_set("place").alias("places")))
    wanted = named.join(small(shared.select("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"])
    texts = cut_lineage(wanted.join(shared, "text_key").select("text_key", "text", "places"))
    spans = equal_strings(texts, length, q, crowd).groupBy("text_key").agg(F.collect_list(F.struct("firsts", "starts", "ends")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = b.column(2)[i].as_py()
                at = [np.add.outer(np.array(x["firsts"]), np.array([x["starts"], x["ends"]])) for x in found]
                kept, s, e = cut_spans(b.column(1)[i].as_py().encode(), *(np.concatenate([x[:, k].reshape(-1) for x in at]) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([s], pa.list_(pa.int64())), pa.array([e], pa.list_(pa.int64())),
                                                  pa.array([kept], pa.binary())], ["text_key", "starts", "ends", "kept"])

    single = texts.select("text_key", "text").join(counts, "text_key", "left_anti")
    lost = single.join(spans, "text_key").mapInArrow(
        cut, schema("text_key binary, starts array<bigint>, ends array<bigint>, kept binary"))
    return members, cut_lineage(lost)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    members, texts = repeated_bytes(docs, length)
    whole = docs.select(text_key(F.col("text")).alias("text_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole_sha256")).distinct()
    per_text = texts.selectExpr("text_key", "CAST(size(starts) AS BIGINT) AS spans", "sha2(kept, 256) AS kept_sha", "CAST(octet_length(kept) AS BIGINT) AS left")
    all_gone = f"copies > 1 AND n_bytes >= {length}"
    return members.join(cut_lineage(whole), "text_key").join(cut_lineage(per_text), "text_key", "left").selectExpr(
        "doc_id", "n_bytes", f"CASE WHEN {all_gone} THEN n_bytes ELSE coalesce(n_bytes - left, 0L) END AS n_removed",
        f"CASE WHEN {all_gone} THEN 1L ELSE coalesce(spans, 0L) END AS n_spans",
        f"CASE WHEN {all_gone} THEN '{hashlib.sha256(b'').hexdigest()}' ELSE coalesce(kept_sha, whole_sha256) END AS kept_sha256")


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of text, and n_chars set anew.

    Bytes of a character that is cut through are dropped. Only rows that lose something are shuffled.
    """
    members, texts = repeated_bytes(docs, length)
    emptied = members.where(f"copies > 1 AND n_bytes >= {length}").selectExpr("text_key", "CAST(X'' AS BINARY) AS kept").distinct()
    changed = cut_lineage(texts.select("text_key", "kept").unionByName(emptied))
    names = docs.columns
    key, cut_text = fresh(names, "text_key", "cut_text")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    ids = small(changed.select(F.col("text_key").alias(key)))
    same = keyed.join(ids, key, "left_anti").select(*[F.col(f"`{c}`") for c in names])
    cut = keyed.join(ids, key, "left_semi").drop("text").join(changed.select(F.col("text_key").alias(key), F.col("kept").alias(cut_text)), key)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [x.decode("utf-8", "ignore") for x in b.column(b.num_columns - 1).to_pylist()]
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            columns["text"] = pa.array(kept, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(x) for x in kept], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return same.unionByName(cut.drop(key).mapInArrow(decode, docs.schema))
