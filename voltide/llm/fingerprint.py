"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles, weighted by how often they occur. A term of weight w draws r and c from
Gamma(2, 1) and b from [0, 1), all fixed by the term alone; with t = floor(ln w / r + b) and
ln y = r (t - b), the sample is the pair (term, t) of least ln a = ln c - ln y - r. Two documents draw the same
pair with a chance of their generalised Jaccard similarity, sum of min over sum of max weights.

Terms are dealt to bins by hash and each bin draws one sample, so a term is drawn once rather than once per
sample (bin-wise consistent weighted sampling); a bin without terms borrows from another one, found by the same
sequence of guesses in every document. A fingerprint is the 16-bit digests of the samples in hex; likeness is
the share of equal digests.

Defined results: null and empty texts, and texts without words, share one fingerprint (likeness 1 to each other);
fewer than five words are one term; equal texts have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import SLICE_BYTES, mix, schema, shingles

SAMPLES = 128
LOWEST = -(1 << 63)


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    return ((mix(h + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(row: np.ndarray, term: np.ndarray, rows: int, samples: int = SAMPLES) -> np.ndarray:
    """(rows, samples) 16-bit digests from (row, term) occurrences; ``row`` ascends."""
    out = np.zeros((rows, samples), np.uint16)
    if not len(row):
        return out
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))
    weight = np.diff(np.append(first, len(row)))
    row, term = row[first], term[first]
    r = -np.log(_uniform(term, 1) * _uniform(term, 2))
    c = -np.log(_uniform(term, 3) * _uniform(term, 4))
    b = _uniform(term, 5)
    t = np.floor(np.log(weight) / r + b)
    ln_a = np.log(c) - r * (t - b) - r
    cell = row * samples + (mix(term + np.uint64(6)) % np.uint64(samples)).astype(np.int64)
    order = np.lexsort((ln_a, cell))
    cell, best = cell[order], order
    least = np.concatenate([[True], cell[1:] != cell[:-1]])
    cell, best = cell[least], best[least]
    drawn = np.zeros(rows * samples, np.uint64)
    drawn[cell] = mix(term[best] ^ mix(t[best].astype(np.int64).view(np.uint64) + np.uint64(7))) | np.uint64(1)
    full = np.zeros(rows * samples, bool)
    full[cell] = True
    some = np.zeros(rows, bool)
    some[row] = True
    empty = np.flatnonzero(~full & np.repeat(some, samples))
    guess = 0
    while len(empty):
        guess += 1
        bin_ = (empty % samples).astype(np.uint64)
        other = empty - empty % samples + (mix(bin_ * np.uint64(0x10001) + np.uint64(guess << 20)) % np.uint64(samples)).astype(np.int64)
        ok = full[other]
        drawn[empty[ok]] = mix(drawn[other[ok]] + bin_[ok])
        empty = empty[~ok]
    return (mix(drawn) >> np.uint64(48)).astype(np.uint16).reshape(rows, samples) * some[:, None].astype(np.uint16)


def text_signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    row, term = shingles(np.frombuffer(b"".join(raw), np.uint8), ends)
    return signatures(row, term, len(texts), samples)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus fingerprint, in place of a column of that name."""
    docs = docs.drop("fingerprint")
    names = docs.columns
    at = names.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_size(batch, at):
                prints = [as_text(s) for s in text_signatures(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def by_size(batch: pa.RecordBatch, at: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    first, held, texts = 0, 0, []
    for i, t in enumerate(batch.column(at)):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held > limit or i == batch.num_rows - 1:
            yield batch.slice(first, i + 1 - first), texts
            first, held, texts = i + 1, 0, []


def next_in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents dealt to ranges of descending doc_id, each range followed by a copy of the next one's first row.

    Columns: part, edge (1 for such a copy), k, tie, doc_id, text. The order is doc_id descending (null last), then
    a hash of the text; the last range is followed by the first. What the driver holds is one row per range.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.selectExpr(f"coalesce(doc_id, {LOWEST}L) AS k", "xxhash64(coalesce(text, '')) AS tie", "doc_id", "coalesce(text, '') AS text")
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = keyed.agg(F.percentile_approx("k", shares, 10_000).alias("c")).first()["c"]
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def part_of(k: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, k, "left")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = part_of(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *b.columns], ["part", "k", "tie"])

    heads = (keyed.select("k", "tie").mapInArrow(places, schema("part int, k bigint, tie bigint"))
             .groupBy("part").agg(F.max(F.struct("k", "tie")).alias("head")).orderBy("part").collect())
    order = [h["part"] for h in heads]
    before = {(h["head"]["k"], h["head"]["tie"]): order[i - 1] for i, h in enumerate(heads)}
    heads_k = np.array(sorted({k for k, _ in before}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "edge", "k", "tie", "doc_id", "text"]
        for b in batches:
            k = b.column(0).to_numpy()
            part = part_of(k)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(k), np.int32)), *b.columns], names)
            at = [i for i in np.flatnonzero(np.isin(k, heads_k)) if (int(k[i]), b.column(1)[int(i)].as_py()) in before]
            if at:
                to = [before[int(k[i]), b.column(1)[int(i)].as_py()] for i in at]
                copies = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([1] * len(at), pa.int32()), *copies.columns], names)

    target = T.StructType([*schema("part int, edge int, k bigint, tie bigint").fields, docs.schema["doc_id"], T.StructField("text", T.StringType())])
    return keyed.mapInArrow(deal, target).repartition(n, "part").sortWithinPartitions(
        "part", "edge", F.desc("k"), F.desc("tie"))


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to both it and the next document.

    The edited text has its last floor(n / 2) code points replaced by as many (or all) first ones of the next document.
    """
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(run: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        """``run``: (doc_id, text), of which the last is only the next of the one before."""
        texts = [t for _, t in run]
        edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:])]
        s = text_signatures(texts + edited)
        own, after, changed = s[:len(edited)], s[1:len(texts)], s[len(texts):]
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in run[:-1]], doc_type), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([as_text(x) for x in own]),
            pa.array([as_text(x) for x in changed]), pa.array(likeness(own, changed)), pa.array(likeness(own, after))], columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, now, over = [], 0, None, False
        for b in batches:
            parts_, edges = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(b.num_rows):
                if parts_[i] != now:
                    run, held, now, over = [], 0, parts_[i], False
                if over:
                    continue        # a head that repeats
                text = b.column(5)[i].as_py()
                run.append((b.column(4)[i].as_py(), text))
                held += len(text)
                over = edges[i] == 1
                if len(run) > 1 and (over or held > SLICE_BYTES // 2):
                    yield finish(run, b.schema.field(4).type)
                    run, held = run[-1:], len(text)

    target = T.StructType([docs.schema["doc_id"], *schema(
        "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    return next_in_order(docs, parts).mapInArrow(rows, target)
