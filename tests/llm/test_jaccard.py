import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from voltide.llm import components, jaccard_join


def test_groups_match_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_groups(docs).collect())
    assert got == Counter(brute.groups(rows))


@pytest.mark.parametrize("size", [5, 9, 17, 40, 90, 300])
def test_every_link_shares_a_key(size):
    """At the very border of the similarity, in every band, with partners of other sizes."""
    rng = np.random.default_rng(size)
    for _ in range(150):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        add = int(rng.integers(0, size // 4 + 1))
        drop = next((d for d in range(size, -1, -1) if 100 * (size - d) >= 80 * (size + add)), None)
        if drop is None:
            continue
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
        keys = []
        for s in (np.sort(a), np.sort(b)):
            keys.append({int(k) for band in jaccard_join.bands_to_meet(len(s))
                         for k in jaccard_join.segment_keys(band, np.array([len(s)]), np.zeros(len(s), np.int64), s)[1]})
        assert keys[0] & keys[1], (size, drop, add)


def test_allocation_uses_neighbourhoods_for_small_sets():
    assert jaccard_join.allocation(0)[1] > 0
    for k in range(22):
        exact, near = jaccard_join.allocation(k)
        assert exact + 2 * near > jaccard_join.most_apart(2 * jaccard_join.band(k)[1])


def test_crowded_segments_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(40):      # a chain: each differs a little more from the first, neighbours link
        rows.append((100 - i, " ".join([*base[i:], *(f"n{j}" for j in range(i))])))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_groups(frame).collect())
    assert got == Counter(brute.groups(rows))


def test_one_row_of_each_group_stays(docs):
    kept = jaccard_join.drop_near_copies(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d for d, _, c in brute.groups(rows) if d == c}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(d for d in want if d is not None)
    assert set(kept[0].asDict()) == set(docs.columns)


def test_no_documents(no_docs):
    assert jaccard_join.link_groups(no_docs).count() == 0
    assert jaccard_join.drop_near_copies(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(1, 301)}) == 1 and got[1000] == got[1001] != got[1]


def test_rows_without_ids_and_ids_of_two_texts(spark):
    """One row of each group stays, whatever the ids say."""
    rng = random.Random(3)
    make = lambda: [f"w{rng.randint(0, 999)}" for _ in range(60)]
    a, b, c, d = (make() for _ in range(4))
    near = lambda x: " ".join([*x[:-1], "other"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, " ".join(b)), (None, " ".join(c)), (None, " ".join(c)), (None, near(c)),
            (9, near(d)), (9, " ".join(d)), (None, " ".join(d)), (None, ""), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, one_id string, th int").repartition(3)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    texts = [t for _, t in got if t]
    assert len(texts) == 4 and " ".join(a) in texts and (3, " ".join(b)) in got
    assert sum(t in (" ".join(c), near(c)) for t in texts) == 1 and sum(t in (" ".join(d), near(d)) for t in texts) == 1
    assert any(i == 9 and t in (" ".join(d), near(d)) for i, t in got) and len(got) == 7
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_groups(docs).collect())
    assert found == Counter(brute.groups(rows))


def test_marks_never_exceed_the_difference():
    rng = np.random.default_rng(11)
    for size in (5, 63, 64, 65, 300, 5000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for drop, add in ((0, 0), (1, 0), (size // 9, size // 9), (size // 2, size)):
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            row = np.repeat([0, 1], [len(a), len(b)])
            x, y = jaccard_join.marks(row, np.concatenate([a, b]), np.array([len(a), len(b)]))
            n = min(len(x), len(y))
            apart = (int.from_bytes(jaccard_join.folded(x, n), "little") ^ int.from_bytes(jaccard_join.folded(y, n), "little")).bit_count()
            assert apart <= drop + add and (apart > 0 or drop + add == 0 or size < 64), (size, drop, add)


def test_unlike_sets_of_a_large_cluster_are_not_compared_on_shingles(spark, monkeypatch):
    """Sets dealt out to be compared grew with the square of a cluster of texts that share a passage."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard_join, "SIFT_SETS", 40)
    dealt = []
    met = jaccard_join.met
    monkeypatch.setattr(jaccard_join, "met", lambda placed: dealt.append(met(placed).count()) or met(placed))
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 99999)}"
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join(passage + [word() for _ in range(rng.randint(12, 30))])) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " x" * (i % 3)) for i in range(0, 200, 9)] + [(2000 + i, rows[i][1] + " y z") for i in range(0, 200, 20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_groups(frame).collect())
    assert got == Counter(brute.groups(rows))
    assert sum(dealt) < 3 * len(rows)
