"""Centroid clustering of integer vectors, with Ptolemaic lower bounds from pivot distances.

Vectors become integers, so that every distance, mean and tie is exact and alike on every cluster.

* Start. The k vectors of least hash are the first centroids, and also the pivots, taken in pairs for good. Each
  vector's distances to the pivots are computed once and stored beside it.
* Bound. For a pivot pair p, s Ptolemy's inequality says d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|.
  The left side's least value over the pairs is a lower bound on d(x, c) that costs no pass over components. It is
  rounded down by more than the arithmetic can err.
* Assignment. The centroid of least bound is measured exactly; others are measured only where their bound does not
  exceed that distance. Ties go to the smaller number.
* Means. Tasks add their vectors by cluster; at most k x (dimension + 1) sums leave a task, cut into 40-bit limbs, and as
  many reach the driver, whatever the number of rows. Means are exact floors.

What is broadcast and collected is bounded by k x (dimension + pivots). Vectors are never shuffled; a group of equal
vectors of any size is spread like other rows.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out;
fewer than k vectors make fewer centroids; a null id hashes as the empty string; repeated rows count each; distances
that exceed a long are null, as are the sums that hold them, but assignments stay exact; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import schema
from voltide.session import cut_lineage

SCALE = 256
EXACT = 1 << 53                  # sums of squares up to here are exact in a double
LIMB = 40
SLACK = 1e-13                    # relative; the bound's arithmetic errs by a few 1e-16


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the one vector c: float64 if exact there, else Python integers."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * top * top * x.shape[1] < EXACT:
        d = x - c
        return np.einsum("ij,ij->i", d, d)
    whole = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) - np.array([int(v) for v in c], object)
    return (whole * whole).sum(1)


def as_points(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.float64 if all(abs(v) < EXACT for r in rows for v in r) else object)


def roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray           # (p, d)
    pairs: np.ndarray            # (m, 2) indices of unequal points
    apart: np.ndarray            # (m,) distances

    @staticmethod
    def of(points: np.ndarray) -> Pivots:
        """Neighbours in order are pairs; pairs of equal points bound nothing and are left out."""
        pairs = [(i, i + 1) for i in range(0, len(points) - 1, 2) if (points[i] != points[i + 1]).any()]
        apart = [float(roots(squared(points[i:i + 1], points[j]))[0]) for i, j in pairs]
        return Pivots(points, np.array(pairs, int).reshape(-1, 2), np.array(apart))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([roots(squared(x, p)) for p in self.points], 1) if len(self.points) else np.zeros((len(x), 0))

    def lower_bounds(self, cached: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
        """(rows, centroids): at most the true distances. Both arguments are distances to the pivots."""
        low = np.zeros((len(cached), len(of_centroids)))
        for (i, j), apart in zip(self.pairs, self.apart):
            a = cached[:, [i]] * of_centroids[:, j]
            b = cached[:, [j]] * of_centroids[:, i]
            np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) / (apart * (1 + SLACK)), out=low)
        return low


def assign(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance, distances measured) of every row of x."""
    low = pivots.lower_bounds(cached, pivots.distances(centroids))
    first = low.argmin(1)
    best, cluster, measured = None, first.copy(), len(x)
    parts = [(np.flatnonzero(first == c), c) for c in range(len(centroids))]
    exact = [(rows, squared(x[rows], centroids[c])) for rows, c in parts if len(rows)]
    best = np.zeros(len(x), object if any(d.dtype == object for _, d in exact) else np.float64)
    for rows, d in exact:
        best[rows] = d
    reach = roots(best) * (1 + SLACK)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= reach) & (first != c))
        if not len(rows):
            continue
        measured += len(rows)
        d = squared(x[rows], centroids[c])
        if d.dtype == object and best.dtype != object:
            best = np.array([int(v) for v in best], object)
        better = (d < best[rows]) | (d == best[rows]) & (c < cluster[rows])
        best[rows[better]] = d[better]
        cluster[rows[better]] = c
    return cluster, best, measured


def limbs(total: int) -> list[tuple[int, int]]:
    sign, rest, out = (1 if total >= 0 else -1), abs(total), []
    while rest:
        out.append((len(out), sign * (rest & ((1 << LIMB) - 1))))
        rest >>= LIMB
    return [x for x in out if x[1]]


def usable(vectors: DataFrame, id_column: str, vector_column: str, dimension: int) -> DataFrame:
    """(id, raw): rows whose vector has ``dimension`` finite components."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("raw"))
    return rows.where(f"size(raw) = {dimension}").where("forall(raw, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")


@dataclass
class Clustering:
    members: DataFrame           # id, cluster, distance (squared)
    centroids: list[list[int]]
    measured: list[int]          # exact distances taken in each round, of rows x centroids


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimension: int = 64,
                    id_column: str = "vec_id", vector_column: str = "embedding") -> Clustering:
    """Lloyd rounds from the k vectors of least sha256 of ``<seed>:<id>``, then one more assignment."""
    rows = usable(vectors, id_column, vector_column, dimension)
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "raw")
    first = hashed.orderBy("h", "raw").limit(k).collect()
    start = np.floor(SCALE * np.array([r["raw"] for r in first], np.float64).reshape(-1, dimension))
    pivots = Pivots.of(start)
    id_type = dict(rows.dtypes)["id"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.floor(SCALE * matrix(b.column(1), dimension))
                cached = pivots.distances(x)
                wide = [pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), m.shape[1]).cast(pa.list_(pa.float64())) for m in (x, cached)]
                yield pa.RecordBatch.from_arrays([b.column(0), *wide], ["id", "x", "cached"])

    table = cut_lineage(rows.mapInArrow(prepare, schema(f"id {id_type}, x array<double>, cached array<double>")) if first
                        else rows.selectExpr("id", "raw AS x", "raw AS cached"))
    centroids = start
    exact = [[int(v) for v in c] for c in start]
    measured = []

    def batch_assign(b: pa.RecordBatch, now: np.ndarray):
        x = matrix(b.column(b.schema.get_field_index("x")), dimension)
        return x, *assign(x, matrix(b.column(b.schema.get_field_index("cached")), len(pivots.points)), now, pivots)

    def sums_of(now: np.ndarray):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [[0] * dimension for _ in now]
            counts = [0] * len(now)
            seen = 0
            for b in batches:
                if not b.num_rows:
                    continue
                x, cluster, _, n = batch_assign(b, now)
                seen += n
                for c in np.unique(cluster):
                    mine = x[cluster == c]
                    part = mine.sum(0) if np.abs(mine).max() < 1 << 30 else [sum(int(v) for v in column) for column in mine.T]
                    totals[c] = [t + int(p) for t, p in zip(totals[c], part)]
                    counts[c] += len(mine)
            out = [(c, d, i, v) for c in range(len(now)) if counts[c] for d, t in enumerate(totals[c]) for i, v in limbs(t)]
            out += [(c, -1, 0, n) for c, n in enumerate(counts) if n] + [(-1, -1, 0, seen)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             ["cluster", "dim", "limb", "value"])

        return add

    for _ in range(rounds if first else 0):
        got = table.select("x", "cached").mapInArrow(sums_of(centroids), schema("cluster int, dim int, limb int, value bigint")).groupBy(
            "cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect()
        sums: dict[tuple[int, int], int] = {}
        for r in got:
            sums[r["cluster"], r["dim"]] = sums.get((r["cluster"], r["dim"]), 0) + (r["value"] << (LIMB * r["limb"]))
        measured.append(sums.pop((-1, -1), 0))
        exact = [[sums.get((c, d), 0) // sums[c, -1] for d in range(dimension)] if (c, -1) in sums else exact[c] for c in range(len(exact))]
        centroids = as_points(exact)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, cluster, d, _ = batch_assign(b, centroids)
                long = pa.array([int(v) if v < 1 << 63 else None for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), long], ["id", "cluster", "distance"])

    members = cut_lineage(table.mapInArrow(place, schema(f"id {id_type}, cluster int, distance bigint")) if first
                          else table.selectExpr("id", "0 AS cluster", "0L AS distance"))
    return Clustering(members, exact, measured)


def with_inertia(found: Clustering) -> DataFrame:
    """members plus cluster_inertia, inertia and centroid_sha256. The joined side has a row per cluster."""
    whole = lambda c: F.expr(f"try_cast(CASE WHEN count(*) = count({c}) THEN sum(CAST({c} AS DECIMAL(38, 0))) END AS BIGINT)")
    each = found.members.groupBy("cluster").agg(whole("distance").alias("cluster_inertia"))
    total = found.members.agg(whole("distance").alias("inertia"))
    spark = found.members.sparkSession
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)],
                                  "cluster int, centroid_sha256 string")
    one = F.lit(1).alias("one")
    one_each = each.select("*", one).join(total.select("*", one), "one").drop("one").join(names, "cluster")
    return found.members.join(F.broadcast(one_each), "cluster")
