import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm import brute
from voltide.llm import decontam

ITEMS = "item_id bigint, text string, doc_id string"


def test_contained_items_match_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = texts[35 if texts.get(35) else 11].split()
    items = [(1, " ".join(words[5:40]), "x"), (2, "One two", "y"), (3, None, None), (4, "", None), (5, "never seen in any of the documents here at all", None),
             (6, " ".join(words[5:40]).upper(), None), (7, " ".join([*words[5:36], "but", "altered"]), None), (8, "a b c d e", None)]
    frame = spark.createDataFrame(items, ITEMS)
    got = Counter((r["doc_id"], r["contaminated"], r["n_items"], r["item_id"], round(r["containment"], 9)) for r in decontam.judge(docs, frame).collect())
    want = Counter()
    for r in docs.collect():
        held = brute.held_items(r["text"], [(i, t) for i, t, _ in items])
        best = max(held, key=lambda i: (held[i], -i), default=None)
        want[r["doc_id"], bool(held), len(held), best, round(held.get(best, 0.0), 9)] += 1
    assert got == want
    assert any(k[1] for k in want)
    cleaned = decontam.clean(docs, frame)
    assert cleaned.columns == docs.columns and cleaned.count() == sum(n for k, n in want.items() if not k[1])


def test_short_items_in_long_documents_are_found(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, items = [], []
    for i in range(300):
        item = [rng.choice(words) for _ in range(1 + i % 14)]
        text = [rng.choice(words) for _ in range(rng.randint(300, 900))]
        at = rng.randint(0, len(text))
        items.append((i, " ".join(item), None))
        rows.append((i, " ".join([*text[:at], *item, *text[at:]] if len(item) >= 5 else item)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained(docs, spark.createDataFrame(items, ITEMS)).collect()}
    assert all((i, i) in got for i in range(300))


def test_clashing_columns_and_rows_without_ids(spark, docs):
    item = "one two three four five six seven eight nine ten"
    odd = docs.select("doc_id", "text", *[F.lit(n).alias(n) for n in ("hit_id", "_hit_th", "th", "met_id", "w", "hs", "_id")]).unionByName(
        spark.createDataFrame([(None, f"so {item} then"), (3, f"and {item} too")], "doc_id bigint, text string")
        .select("doc_id", "text", *[F.lit(n).alias(n) for n in ("hit_id", "_hit_th", "th", "met_id", "w", "hs", "_id")]))
    kept = decontam.clean(odd, spark.createDataFrame([(1, item, None)], ITEMS))
    assert kept.columns == odd.columns and kept.count() == docs.count()
    assert kept.where("hit_id = 'hit_id' AND th = 'th'").count() == docs.count()


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "one two three four five six", None)], ITEMS)
    assert decontam.clean(docs, none).count() == docs.count()
    assert decontam.clean(no_docs, some).count() == 0
    assert decontam.judge(docs, none).where("contaminated").count() == 0


def test_only_dataframe_functions(spark, docs):
    frame = spark.createDataFrame([(1, "one two three four five six", None)], ITEMS)
    plan = decontam.candidates(docs, frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval"))
