import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS
from voltide.llm import fingerprint, langid, quality, sharding
from tests.llm import brute
from voltide.llm.common import mix


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


# ---- quality ------------------------------------------------------------------------

def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        rows.append((i, made(rng, "aeioulmnrst", rng.randint(3, 80)) if good else made(rng, "XQZ#%&", rng.randint(3, 80)), "en", "s", 1))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    _, scores, drawn = quality.choose(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r["doc_id"]: r["kept"] for r in scores.selectExpr("doc_id", f"{drawn} AS kept").collect()}
    held_out = [i for i in got if i % 3]
    assert np.mean([got[i] == (i % 4 > 0) for i in held_out]) > 0.97
    best = scores.orderBy("sort_key", ascending=False).limit(sum(got.values())).select("doc_id").collect()
    assert {r["doc_id"] for r in best} == {i for i, k in got.items() if k}       # exactly the largest keys
    assert quality.resample(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == sum(got.values())


def test_quality_odd_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (3, 1, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.resample(docs, none).count() == docs.count()
    assert quality.resample(docs, some).count() == docs.count()
    assert quality.resample(no_docs, some).count() == 0
    assert quality.resample(docs, none).columns == docs.columns


def test_quality_keeps_clashing_columns(spark, docs):
    names = ["log_weight", "_noise", "rest", "own", "good", "noise", "key_bits", "sort_key"]
    odd = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n} "), F.coalesce("source", F.lit("?"))).alias(n) for n in names])
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    kept = quality.resample(odd, labels)
    assert kept.columns == odd.columns
    whole = [tuple(r) for r in odd.collect()]
    assert 0 < kept.count() <= len(whole) and all(tuple(r) in whole for r in kept.collect())


def test_ordered_bits():
    x = np.array([-np.inf, -1e300, -1.5, -0.0, 1e-300, 2.0, np.inf])
    assert (np.diff(quality.ordered_bits(x).astype(object)) > 0).all()


# ---- language ------------------------------------------------------------------------

def test_languages_held_out(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "ghijk", "dd": "ijklm", "ee": "àéîõü", "ff": "дежзи", "gg": "xyzwv"}
    rows = [(i, made(rng, alphabets[name], rng.randint(2, 30)), name, "s", 1) for i in range(700) for name in [list(alphabets)[i % 7]]]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.where("doc_id % 3 <> 0"))
    assert model.codewords.shape[0] == 7 and len({tuple(c) for c in model.codewords}) == 7
    got = langid.predict(docs.where("doc_id % 3 = 0"), model, ["doc_id"]).collect()
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_cases(spark, docs, no_docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (0, 1, 2)] == [("und", 0.0)] * 3
    assert {r["lang_pred"] for r in got.values()} <= {"en", "fr", "und"}
    nothing = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    single = langid.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(docs, single, ["doc_id"]).collect()} == {"en", "und"}
    assert langid.predict(no_docs, model, ["doc_id"]).count() == 0


# ---- sharding -------------------------------------------------------------------------

def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(16, 400), rng.choice([7, 7, rng.randint(-10**18, 10**18)])) for i in range(6000)]   # one group of two thirds
    frame = spark.createDataFrame(rows, "doc_id bigint, size bigint, group_hash bigint").repartition(5)
    got = sharding.shard_rows(frame, 10, tolerance=0.01, part_rows=250).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(10))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.03 * sums.mean() + 800
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    ordered = got.sort_values(["shard", "slot"])
    assert (ordered[["group_hash", "doc_id"]].apply(tuple, axis=1).is_monotonic_increasing)
    assert (got[got["group_hash"] != 7].groupby("group_hash")["shard"].nunique() == 1).all()


def test_sharding_odd_cases(spark):
    ddl = "doc_id bigint, size bigint, group_hash bigint, _extra string, h int"
    assert sharding.shard_rows(spark.createDataFrame([], ddl), 4).count() == 0
    rows = [(None, None, None, "a", 1), (1, 5, None, "b", 2), (1, 5, None, "b", 2), (2, 0, 3, None, None)]
    got = sharding.shard_rows(spark.createDataFrame(rows, ddl), 4).collect()
    assert len(got) == 4 and all(0 <= r["shard"] < 4 for r in got)
    one = sharding.shard_rows(spark.createDataFrame(rows, ddl), 1).collect()
    assert sorted(r["slot"] for r in one) == [0, 1, 2, 3]


# ---- fingerprints ----------------------------------------------------------------------

def generalised_jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    errors = []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(15):
            a = [rng.choice(words) for _ in range(400)]
            a += a[:60] * 3                              # weights above 1
            cut = int(len(a) * share)
            b = a[:cut] + [rng.choice(words) for _ in range(len(a) - cut)]
            s = fingerprint.text_signatures([" ".join(a), " ".join(b)])
            truth = generalised_jaccard(brute.shingle_bag(" ".join(a)), brute.shingle_bag(" ".join(b)))
            errors.append(float(fingerprint.likeness(s[0], s[1])) - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_edited_and_next(docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None]
    frame = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted({d: t for d, t in rows}.items(), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame, 4).collect()}
    import hashlib
    prints = {d: fingerprint.as_text(fingerprint.text_signatures([t])[0]) for d, t in rows}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        edited = t[:len(t) - len(t) // 2] + after[1][:len(t) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[d])
        assert r["edited_fingerprint"] == fingerprint.as_text(fingerprint.text_signatures([edited])[0])
        same = np.mean([prints[d][k:k + 4] == prints[after[0]][k:k + 4] for k in range(0, 512, 4)])
        assert abs(r["near_next"] - same) < 1e-12
    assert fingerprint.compare_with_next(no_docs).count() == 0
    assert fingerprint.compare_with_next(docs, 3).count() == docs.count()        # repeated rows and a null id
    assert fingerprint.fingerprints(docs).count() == docs.count()


def test_quality_equals_plain_counts(spark):
    """Weights, border, k and the drawn rows against plain counting."""
    rng = random.Random(9)
    rows = [(i, None if i == 5 else "" if i == 6 else made(rng, "aeioulmnrst" if i % 3 else "XQZ#%&ae", rng.randint(1, 60)), "en", "s", 1) for i in range(150)]
    labels = [(i, int(i % 3 > 0), int(i % 10 == 1)) for i in range(0, 150, 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model, thin, drawn = quality.choose(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    n = quality.BUCKETS + 2

    def bag(text):
        data = (text or "").encode()
        found = Counter()
        for at in range(len(data) - 2):
            code = np.uint64(int.from_bytes(data[at:at + 3], "big") + 3)
            found[int(mix(np.array([code]))[0] % np.uint64(quality.BUCKETS))] += 1
        words = (text or "").split()
        for a, b in zip(words, words[1:]):
            found[quality.BUCKETS + (a.lower() == b.lower())] += 1
        return found

    bags = {i: bag(t) for i, t, *_ in rows}
    good = {i for i, q, tox in labels if q and not tox}
    raw, target = np.zeros(n), np.zeros(n)
    for i, b in bags.items():
        for k, c in b.items():
            raw[k] += c
            target[k] += c * (i in good)
    share = (raw + 1) / (raw.sum() + n)
    ratio = np.log((target + quality.BACKING * share) / (target.sum() + quality.BACKING) / share)
    assert np.allclose(model.log_ratio, ratio)
    weight = {i: 200 * sum(c * ratio[k] for k, c in b.items()) / (sum(b.values()) + 200) for i, b in bags.items()}
    got = {r["doc_id"]: r for r in thin.selectExpr("*", f"{drawn} AS kept").collect()}
    assert all(abs(got[i]["log_weight"] - w) < 1e-6 for i, w in weight.items())
    def held_out(i):
        less = target.copy()
        for b, c in bags[i].items():
            less[b] -= c * (i in good)
        other = np.log((less + quality.BACKING * share) / (less.sum() + quality.BACKING) / share)
        return 200 * sum(c * other[b] for b, c in bags[i].items()) / (sum(bags[i].values()) + 200)

    assert all(abs(got[i]["held_out_weight"] - held_out(i)) < 1e-6 for i in weight)
    marked = sorted((got[i]["held_out_weight"], q) for i, q, _ in labels)
    n_bad, n_good = sum(not q for _, q in marked), sum(q for _, q in marked)
    gain = [sum(not q for _, q in marked[:j + 1]) / n_bad + sum(q for _, q in marked[j + 1:]) / n_good for j in range(len(marked))]
    at = int(np.argmax(gain))
    edge = (marked[at][0] + marked[at + 1][0]) / 2
    k = sum(r["log_weight"] > edge for r in got.values())
    best = sorted(got, key=lambda i: -got[i]["sort_key"])[:k]
    assert {i for i, r in got.items() if r["kept"]} == set(best)


def test_sharding_and_fingerprints_keep_clashing_columns(spark):
    rows = spark.createDataFrame([(i, 10 + i % 7, i % 5, "h", "k", "s", "p", "f", f"text number {i} of them all") for i in range(60)],
                                 "doc_id bigint, size bigint, group_hash bigint, _h string, _k string, _s string, _part string, fingerprint string, text string")
    got = sharding.shard_rows(rows.drop("text"), 4)
    assert got.columns == [*rows.drop("text").columns, "shard", "slot"] and got.where("_h = 'h' AND _k = 'k' AND _s = 's' AND _part = 'p'").count() == 60
    prints = fingerprint.fingerprints(rows)
    assert sorted(prints.columns) == sorted(rows.columns) and prints.where("fingerprint <> 'f'").count() == 60
