import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from voltide.llm import suffix_dedup


def expected(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (d, _), b, m in zip(rows, raw, brute.covered(raw, length)):
        spans = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(b) else 0
        out[d, len(b), int(m.sum()), spans, hashlib.sha256(brute.cut(b, m)).hexdigest()] += 1
    return out


def told(frame):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect())


@pytest.mark.parametrize("crowd", [4096, 2, 1])
def test_report_matches_brute_force(docs, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "equal_strings", lambda t, length, q, _, f=suffix_dedup.equal_strings: f(t, length, q, crowd))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert told(suffix_dedup.report(docs)) == expected(rows, 200)


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1, 4])
def test_random_texts_of_few_letters(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "equal_strings", lambda t, length, q, _, f=suffix_dedup.equal_strings: f(t, length, q, crowd))
    rng = np.random.default_rng(4)
    rows = []
    for i in range(30):
        parts = [bytes(rng.choice(list(b"ab"), 230)).decode() for _ in range(2)]
        rows.append((i, parts[0] + (rows[i // 2][1][7:260] if i else "") + parts[1]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert told(suffix_dedup.report(frame)) == expected(rows, 200)


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3])
def test_common_passages_with_unlike_surroundings(spark, crowd, monkeypatch):
    """A short line, a long one and a periodic one in most texts, each time between other words."""
    monkeypatch.setattr(suffix_dedup, "equal_strings", lambda t, length, q, _, f=suffix_dedup.equal_strings: f(t, length, q, crowd))
    rng = np.random.default_rng(5)
    some = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    lines = [some(60), some(190), some(203), some(390), "he. Is on" * 40]
    rows = [(i, "".join(some(int(rng.integers(0, 150))) + lines[j] for j in rng.permutation(5)) + some(30)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert told(suffix_dedup.report(frame)) == expected(rows, 200)


def test_clean_keeps_clashing_columns(docs):
    odd = docs.withColumn("text_key", F.lit("mine")).withColumn("cut_text", F.col("source")).withColumn("_key", F.lit(1)).withColumn("places", F.lit(2))
    got = suffix_dedup.clean(odd)
    assert got.columns == odd.columns
    assert got.where("text_key = 'mine' AND _key = 1 AND places = 2 AND cut_text <=> source").count() == docs.count()


def test_places_are_chosen_by_content_alone():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 4, 260).astype(np.uint8)
    found = []
    for _ in range(20):
        before = rng.integers(0, 256, int(rng.integers(0, 500))).astype(np.uint8)
        data = np.concatenate([before, shared, rng.integers(0, 256, 300).astype(np.uint8)])
        _, _, place, first, last = suffix_dedup.places(data, np.array([0, len(data)]))
        at = {p: int(c) - len(before) for c, f, e in zip(place, first, last) for p in range(f - len(before), e + 1 - len(before))}
        found.append([at[p] for p in range(61)])
    assert all(f == found[0] for f in found)


def test_clean_keeps_columns_and_whole_characters(docs):
    got = suffix_dedup.clean(docs)
    assert got.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw = [(t or "").encode() for _, t in rows]
    want = Counter((d, brute.cut(b, m).decode("utf-8", "ignore")) for (d, _), b, m in zip(rows, raw, brute.covered(raw)))
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["n_chars"] is not None)


def test_no_documents(no_docs):
    assert suffix_dedup.report(no_docs).count() == 0
    assert suffix_dedup.clean(no_docs).count() == 0
