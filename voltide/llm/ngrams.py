"""Hashed byte n-grams of text slices, and their counts per class over a whole corpus.

Counts are summed inside each task first; what is shuffled has one row per class, bucket and task at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import mix, prefix_hash, schema, substring_hash, text_slices, words

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_ngrams(data: np.ndarray, ends: np.ndarray, n: int, buckets: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every run of n bytes inside a row."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = (_LOWER[data] if lower else data).astype(np.uint64)
    m = len(d) - n + 1
    code = np.zeros(m, np.uint64)
    for k in range(n):
        code = (code << np.uint64(8)) | d[k:k + m]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(row[:m] == row[n - 1:])
    return row[at], (mix(code[at] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)


def word_repeats(data: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, base or base + 1) of every word pair: unequal or equal neighbours."""
    row, start, end = words(data, ends)
    if len(row) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = substring_hash(prefix_hash(data, True), start, end)
    at = np.flatnonzero(row[1:] == row[:-1])
    return row[at], base + (h[at] == h[at + 1]).astype(np.int64)


def class_counts(docs: DataFrame, features: Features, buckets: int, label: str = "label", text: str = "text",
                 flush_classes: int = 64) -> DataFrame:
    """(label, bucket, n): how often each bucket occurs in the texts of each non-null label (a string)."""
    at = docs.columns.index(label)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["label", "bucket", "n"])
            held.clear()

        for rows, data, ends in text_slices(batches, text):
            names = rows.column(at).to_pylist()
            row, bucket = features(data, ends)
            for name in set(names) - {None}:
                mine = np.array([x == name for x in names])
                if name not in held:
                    held[name] = np.zeros(buckets, np.int64)
                held[name] += np.bincount(bucket[mine[row]], minlength=buckets)
            if len(held) > flush_classes:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(tally, schema("label string, bucket int, n bigint")).groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def count_table(counts: DataFrame, buckets: int) -> dict[str, np.ndarray]:
    """The counts on the driver: classes x buckets numbers, whatever the size of the corpus."""
    table: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator(prefetchPartitions=True):
        table.setdefault(r["label"], np.zeros(buckets, np.int64))[r["bucket"]] = r["n"]
    return dict(sorted(table.items()))


def row_sums(weights: np.ndarray, row: np.ndarray, bucket: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of weights[bucket] per row, number of features per row); weights is (buckets, k), rows ascend."""
    counts = np.bincount(row, minlength=rows)
    sums = np.zeros((rows, weights.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
        sums[full] = np.add.reduceat(weights[bucket], starts, axis=0)
    return sums, counts
