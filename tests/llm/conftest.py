import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, words):
    stems = "alpha beta gamma delta omega river stone cloud ember quartz maple copper violet tundra meadow".split()
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(words))


def corpus():
    """Small texts with every odd case: null, empty, blank, short, long, repeated, near copies, shared passages, case, accents."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    texts = [None, "", "   \n", "one", "One TWO", "a b c d e", "A b c d e", "été naïve ÉCOLE", "x" * 700, "ab " * 400]
    base = [sentence(rng, n) for n in (30, 60, 120, 240, 500)]
    for t in base:
        w = t.split()
        texts += [t, t, " ".join(w[:-1]), " ".join(["changed", *w[1:]]), " ".join(w[:len(w) // 2] + ["mid"] + w[len(w) // 2:])]
    texts += [f"{sentence(rng, 25)} {passage} {sentence(rng, 10 * i)}" for i in range(1, 6)]
    texts += [sentence(rng, 3000), " ".join(sentence(rng, 40) for _ in range(100)), "<|endoftext|> and <|x|> \\ back"]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[11], rows[11], (None, "a row without id " * 20, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "none.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
