"""What the corpus operators share: table access, bounded slices of Arrow batches, word and shingle hashes.

Byte work is vectorised over slices of a few megabytes, so a task's memory does not follow the size
of an Arrow batch; only a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
WORD_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SHINGLE_WORDS = 5


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def bounded_batches(spark: SparkSession) -> None:
    """Where the session has Spark's defaults, read 512 texts at a time instead of 4096 and hand them to Python in batches of 4 MB
    instead of 64 MB: a reader holds a whole batch of a column in one array, and a task several copies of one."""
    if spark.conf.get(ARROW_BYTES) in ("64MB", "64m", "67108864b", "67108864"):
        spark.conf.set(ARROW_BYTES, "4m")
    if spark.conf.get(READER_ROWS) == "4096":
        spark.conf.set(READER_ROWS, "512")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text (one row at least).

    Yields (rows, bytes of their texts, row offsets into the bytes). A null text has no bytes.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
        kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
        buffers = column.buffers()
        n = len(column)
        if not n:
            continue
        ends = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2] or b"", np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
            last = min(max(last, first + 1), n)
            yield batch.slice(first, last - first), data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
            first = last


# ---- 64-bit hashing ---------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: spreads every input bit over the 64 output bits."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    step = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x51ED270B)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = stream(1, 256)
_LOWER_VALUES = _VALUES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums whose differences, divided by the start's power, hash any substring."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = (_LOWER_VALUES if lower else _VALUES)[data]
    values *= _power("up", _BASE, len(data))
    np.cumsum(values, out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _power("down", _INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every run of bytes other than white space; runs stop at row borders."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first = ends[:-1][ends[:-1] < ends[1:]]
    last = ends[1:][ends[:-1] < ends[1:]] - 1
    begins[first] = inside[first]
    stops[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.searchsorted(ends, start, "right") - 1, start, end


_PLACES = stream(2, 64) | np.uint64(1)


def shingles(data: np.ndarray, ends: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word shingle, lower-cased A-Z, in text order, repeats kept.

    A row with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    row, start, end = words(data, ends)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    h = substring_hash(prefix_hash(data, True), start, end)
    m = len(h) - width + 1
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if m > 0:
        at = np.flatnonzero(row[:m] == row[width - 1:])
        full = np.full(len(at), width, np.uint64)
        for k in range(width):
            full += h[at + k] * _PLACES[k]
        full = mix(full)
    counts = np.bincount(row, minlength=len(ends) - 1)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        firsts = np.searchsorted(row, short)
        part = counts[short].astype(np.uint64)
        for k in range(width - 1):
            there = counts[short] > k
            part = part + np.where(there, h[np.minimum(firsts + k, len(h) - 1)] * _PLACES[k], np.uint64(0))
        rows = np.concatenate([row[at], short])
        order = np.argsort(rows, kind="stable")
        return rows[order], np.concatenate([full, mix(part)])[order]
    return row[at], full


def distinct_sorted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by both; ``row`` ascends already."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
