from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import DOCS, corpus
from voltide.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    rows = corpus()
    junk = [(900 + i, "%$% !!! " * (10 + i), "en", "s", None) for i in range(20)]
    assert len(rows[-6][1].split()) == 3000
    item = " ".join(rows[-6][1].split()[50:90])
    spark.createDataFrame(rows + junk, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(10, 42)] + [(900 + i, 0, 0) for i in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, work) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        columns = docs.columns
        work(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append((name, before, docs))
        if name != "bpe":
            assert docs.columns == columns
    after = {name: docs.collect() for name, _, docs in seen}
    kept = {r["doc_id"] for r in after["quality"]}
    assert not any(d in kept for d in range(901, 920, 2)) and set(range(10, 35)) <= kept
    for name, before, _ in seen[1:]:
        got = after[name]
        if name == "near_copies":
            assert {r["doc_id"] for r in got if r["doc_id"] is not None} == {d for d, _, c in brute.groups(before) if d == c and d is not None}
        elif name == "suffix_dedup":
            raw = [(t or "").encode() for _, t in before]
            assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter(
                (d, brute.cut(b, m).decode("utf-8", "ignore")) for (d, _), b, m in zip(before, raw, brute.covered(raw)))
        elif name == "decontaminate":
            want = [d for d, t in before if not brute.held_items(t, [(1, item)])]
            assert Counter(r["doc_id"] for r in got) == Counter(want) and len(want) < len(before)
        else:
            t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
            assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter(
                (d, np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()) for d, x in before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after["bpe"])


def test_no_documents(spark, tmp_path):
    for table, ddl in (("documents", DOCS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
