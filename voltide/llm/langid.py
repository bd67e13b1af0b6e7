"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier over hashed byte trigrams tells the
languages with a 1 from those with a 0. A text gets one margin per bit, and the language whose codeword
loses least, bits weighted by how well they tell that language, is chosen. A near second is flagged.

The classifiers are log ratios of smoothed trigram frequencies, languages weighted equally, so all of them
follow from one table of counts per language, taken over every training row.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything where nothing
was learned; equal losses go to the language that sorts first, flagged; rows are judged one by one, so ties and
repeated rows agree; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import schema, text_slices
from voltide.llm.ngrams import byte_ngrams, class_counts, count_table, row_sums

BUCKETS = 1 << 14


@dataclass
class Model:
    languages: list[str]
    codewords: np.ndarray       # languages x bits, +1 or -1
    bit_weights: np.ndarray     # languages x bits, rows sum to 1
    weights: np.ndarray         # buckets x bits


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_ngrams(data, ends, 3, BUCKETS, lower=True)


def codewords(n: int, seed: int = 11, tries: int = 200) -> np.ndarray:
    """Up to 6 languages: every split there is. More: the random code with the largest least distance of ``tries``."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        bits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(bits).T.astype(float)
    rng = np.random.default_rng(seed)
    width = 15 * int(np.ceil(np.log2(n)))
    best, least = None, -1
    for _ in range(tries):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        d = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * width
        if d.min() > least:
            best, least = code, d.min()
    return best


def fit(training: DataFrame) -> Model:
    """``training``: text and lang. Rows without either teach nothing."""
    rows = training.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").alias("label"))
    table = count_table(class_counts(rows, features, BUCKETS), BUCKETS)
    names = list(table)
    code = codewords(len(names))
    freq = np.array([(c + 0.5) / (c.sum() + 0.5 * BUCKETS) for c in table.values()]).reshape(len(names), BUCKETS)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float64)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(freq[code[:, b] > 0].mean(0)) - np.log(freq[code[:, b] < 0].mean(0))
    # a bit counts for a language by the margin it can expect there
    told = np.maximum(code * (freq @ weights), 1e-6)
    return Model(names, code, told / told.sum(1, keepdims=True) if code.shape[1] else told, weights)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) from margins (rows x bits, mean log ratio per trigram)."""
    z = 8.0 * margins[:, None, :] * model.codewords[None, :, :]
    loss = (np.logaddexp(0, -z) * model.bit_weights[None, :, :]).sum(2)
    p = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = np.argmax(p, 1)
    top = np.take_along_axis(p, best[:, None], 1)[:, 0]
    second = np.where(np.arange(p.shape[1])[None, :] == best[:, None], -1, p).max(1) if p.shape[1] > 1 else np.full(len(p), 0.0)
    return best, top, top - second < 0.2


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred, score (0 to 1) and ambiguous. Only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # languages x buckets numbers
    source = docs.select(*keep, "text", F.expr(r"coalesce(text RLIKE '\\p{L}', false)").alias("_letters"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, ends in text_slices(batches):
            n = part.num_rows
            letters = part.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            names, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if m.languages:
                sums, count = row_sums(m.weights, *features(data, ends), n) if m.codewords.shape[1] else (np.zeros((n, 0)), np.zeros(n))
                best, top, close = decode(m, sums / np.maximum(count, 1)[:, None])
                names = [m.languages[i] if ok else "und" for i, ok in zip(best, letters)]
                score, unsure = np.where(letters, top, 0.0), letters & close
            yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                                             [*keep, "lang_pred", "score", "ambiguous"])

    kept = T.StructType([docs.schema[c] for c in keep])
    return source.mapInArrow(rows, T.StructType([*kept.fields, *schema("lang_pred string, score double, ambiguous boolean").fields]))
