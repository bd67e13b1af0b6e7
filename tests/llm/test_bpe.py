import random

import numpy as np
import pytest

from voltide.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_words_encode_as_the_library_does(vocabulary, reference):
    letters = [*"abcXYZ019'\"!,.-_ \t\n", "'s", "<|endoftext|>", "<|", "É", "é", "ß", "Σ", "İ", "中文", "가", "🙂", "​", "\x85", "\xa0",
               " ", "᠎", "\x1c", "½", "٣", "̀", "ﬁ", "　", "\x00"]
    rng, encoder, specials = random.Random(2), bpe.Encoder(vocabulary), bpe.special_pattern(vocabulary)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        got = [i for w in bpe.split_words(text, specials) for i in encoder.word(w)]
        assert got == reference.encode(text, add_special_tokens=False).ids, repr(text)
    long = "ab" * 3000 + "xyz"
    assert encoder.merge(long) == encoder.merge_long(long)


def test_every_row_encodes_and_decodes_as_the_library_does(docs, vocabulary, reference):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"]), r["decoded"]) for r in bpe.encode(docs, vocabulary, block_bytes=2000).collect())
    want = []
    for r in docs.collect():
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] is not None, r["doc_id"] or 0, np.array(ids, "<u4").tobytes(), reference.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_decode_alone(spark, vocabulary, reference):
    ids = reference.encode("Some words, and more", add_special_tokens=False).ids
    frame = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes()), "x"), (2, None, "y")], "k bigint, ids binary, extra string")
    got = {r["k"]: r["decoded"] for r in bpe.decode(frame, vocabulary).collect()}
    assert got == {1: reference.decode(ids, skip_special_tokens=False), 2: ""}


def test_no_documents(no_docs, vocabulary):
    assert bpe.encode(no_docs, vocabulary).count() == 0


def test_repeated_rows_that_fill_a_block_each_get_their_result(spark, vocabulary, reference):
    long = " ".join(f"word{i} and more" for i in range(60))
    rows = [(7, long)] * 3 + [(8, "short"), (None, long), (None, long)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = bpe.encode(frame, vocabulary, block_bytes=200).collect()
    ids = {t: np.array(reference.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (long, "short")}
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in got) == sorted((k or 0, ids[t]) for k, t in rows)
