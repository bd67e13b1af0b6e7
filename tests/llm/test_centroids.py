import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from voltide.llm import centroids

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster int, id string, cached string"


def plain(rows, k, rounds, d):
    kept = [(i, [math.floor(256 * Fraction(float(np.float32(v)))) for v in x]) for i, x, *_ in rows
            if x is not None and len(x) == d and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    points = [x for _, x in order[:k]]
    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        points = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if j in groups else c for j, c in enumerate(points)]
    return sorted(((i, near(x)[1], near(x)[0] if near(x)[0] < 1 << 63 else None) for i, x in kept), key=str), points


def vectors(rng, n, d, spread):
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 1) * spread)) for _ in range(d)], 0, 1, "x", "y") for i in range(n)]
    rows += [(n, None, 0, 0, "", ""), (n + 1, [1.0] * (d - 1), 0, 0, "", ""), (n + 2, [float("nan")] + [0.0] * (d - 1), 0, 0, "", ""),
             (n + 3, [None] + [0.0] * (d - 1), 0, 0, "", ""), (n + 4, [float("inf")] * d, 0, 0, "", ""), (None, [0.5] * d, 0, 0, "", "")]
    return rows + [rows[0]] * 30 + [rows[1]]


@pytest.mark.parametrize(("spread", "d", "k"), [(0.1, 64, 40), (1e4, 6, 9), (1e15, 5, 7), (1e36, 4, 6)])
def test_equals_all_distances(spark, spread, d, k):
    rows = vectors(random.Random(3), 150, d, spread)
    found = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), k, 4, dimension=d)
    want, points = plain(rows, k, 4, d)
    assert sorted((tuple(r) for r in found.members.collect()), key=str) == want
    assert found.centroids == points
    out = centroids.with_inertia(found).collect()
    assert len(out) == len(want)
    if spread < 1e4:
        assert {r["inertia"] for r in out} == {sum(w[2] for w in want)}
        assert all(r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in out)
    if spread > 1e30:
        assert {r["inertia"] for r in out} == {None}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 4000, (10, 16))
    x = np.floor(middles[rng.integers(0, 10, 500)] + rng.normal(0, 40, (500, 16)))
    pivots = centroids.Pivots.of(np.floor(middles))
    low = pivots.lower_bounds(pivots.distances(x), pivots.distances(np.floor(middles)))
    true = np.sqrt(((x[:, None] - np.floor(middles)[None]) ** 2).sum(2))
    assert (low <= true).all()
    cluster, d, measured = centroids.assign(x, pivots.distances(x), np.floor(middles), pivots)
    assert (cluster == true.argmin(1)).all() and (d == np.round(true.min(1) ** 2)).all()
    assert measured < 0.3 * true.size


def test_few_and_none(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.with_inertia(centroids.cluster_vectors(none)).count() == 0
    two = spark.createDataFrame([(1, [0.0, 1.0], 0, 0, "", ""), (2, [3.0, 4.0], 0, 0, "", "")], VECTORS)
    found = centroids.cluster_vectors(two, 5, 2, dimension=2)
    assert len(found.centroids) == 2 and {r["distance"] for r in found.members.collect()} == {0}
    same = spark.createDataFrame([(i, [1.0, 1.0], 0, 0, "", "") for i in range(20)], VECTORS)
    assert {r["cluster"] for r in centroids.cluster_vectors(same, 5, 2, dimension=2).members.collect()} == {0}
