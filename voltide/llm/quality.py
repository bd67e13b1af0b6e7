"""Quality by importance resampling.

Two generative models over hashed byte n-grams (and whether neighbouring words repeat): one of target text,
one of the raw corpus. A document's weight is the ratio of its likelihoods under the two; documents are
then drawn without replacement in proportion to their weights, by adding Gumbel noise to the log weights and
keeping the k largest.

* The raw model counts every document. The target model counts labelled good documents of a sample of
  ``sample_rows`` labels (by hash), which bounds what is broadcast.
* The log ratio grows with a text's length, so its mean per feature counts, drawn towards 0 for short texts as if
  they had ``prior`` more features of ratio 0, and multiplied by ``sharpness`` so that the noise decides only near
  the border.
* k is how many documents have a weight above the border that best parts the sample's good and bad labels. For this,
  a document that the target model counts is weighed by the model without it.
* The k-th largest key is found by counting passes over a thin table of keys (see ``sharding``), never by
  gathering or sorting keys in one place.

Defined results: a null or empty text has log weight 0; a null doc_id has no label; repeated rows share key and
fate (rows equal in key and doc_id can't be told apart, so k is met to within them); without good or without bad
labels every row is kept; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import text_slices
from voltide.llm.ngrams import byte_ngrams, class_counts, count_table, row_sums, word_repeats
from voltide.llm.sharding import HIGH, LOW, find_splitters
from voltide.session import cut_lineage

BUCKETS = 1 << 15
BACKING = 1000
SCORES = ("log_weight", "held_out_weight", "sort_key", "key_bits")
SCORES_DDL = "log_weight double, held_out_weight double, sort_key double, key_bits bigint"


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, bucket = byte_ngrams(data, ends, 3, BUCKETS, lower=False)
    row2, bucket2 = word_repeats(data, ends, BUCKETS)
    row, bucket = np.concatenate([row, row2]), np.concatenate([bucket, bucket2])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    b = np.ascontiguousarray(x, np.float64).view(np.int64)
    return b ^ ((b >> 63) & np.int64(HIGH))


@dataclass
class Model:
    target: np.ndarray          # counts per bucket
    raw: np.ndarray
    sample: DataFrame           # doc_id, good, toxic: the bounded label sample

    @property
    def share(self) -> np.ndarray:
        return (self.raw + 1) / (self.raw.sum() + len(self.raw))

    @property
    def log_ratio(self) -> np.ndarray:
        """Per bucket the log of its share in the target over its share in the raw corpus.

        The raw shares have one count more each. The target's counts are filled up with ``BACKING`` features dealt out
        like the raw corpus, so a bucket that the target says nothing about has a ratio near 1 whatever the totals are.
        """
        if not self.target.sum():
            return np.zeros(len(self.raw))
        share = self.share
        return np.log((self.target + BACKING * share) / (self.target.sum() + BACKING) / share)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    """Count the two models. ``labels``: doc_id, quality (1 good), toxic (toxic text is no target)."""
    sample = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
              .groupBy("doc_id").agg(F.expr("max(quality) = 1").alias("good"), F.expr("coalesce(max(toxic), 0) = 1").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    sample = cut_lineage(sample)
    named = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select(
        "text", F.expr("IF(good AND NOT toxic, 'target', 'rest')").alias("label"))
    table = count_table(class_counts(named, features, BUCKETS + 2), BUCKETS + 2)
    target = table.get("target", np.zeros(BUCKETS + 2, np.int64))
    return Model(target, target + table.get("rest", 0), sample)


def score(docs: DataFrame, model: Model, sharpness: float = 200.0, prior: float = 200.0, seed: int = 7) -> DataFrame:
    """doc_id, text, rest (a struct of the other columns, null if there are none), and per row

    log_weight, held_out_weight (the same without the row's own share in the target, where it has one), sort_key
    (with Gumbel noise drawn by doc_id) and key_bits (integers in its order).
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    boxed = docs.select("doc_id", "text", rest.alias("rest"), F.xxhash64("doc_id", F.lit(seed)).alias("noise"))
    weights, target, share = model.log_ratio[:, None], model.target, model.share
    counted = {r["doc_id"] for r in model.sample.where("good AND NOT toxic").select("doc_id").collect()}    # at most the sample

    def without(bucket: np.ndarray) -> float:
        used, n = np.unique(bucket, return_counts=True)
        left = target.sum() - len(bucket)
        return float(n @ np.log((target[used] - n + BACKING * share[used]) / (left + BACKING) / share[used])) if left else 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches):
            row, bucket = features(data, ends)
            sums, n = row_sums(weights, row, bucket, part.num_rows)
            mean = sharpness / (n + prior)
            log_weight = sums[:, 0] * mean
            held = log_weight.copy()
            for i in (i for i, d in enumerate(part.column(0).to_pylist()) if d in counted):
                a, b = np.searchsorted(row, [i, i + 1])
                held[i] = without(bucket[a:b]) * mean[i]
            noise = part.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            u = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            key = log_weight - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, (log_weight, held, key, ordered_bits(key)))],
                                             ["doc_id", "text", "rest", *SCORES])

    return boxed.mapInArrow(rows, T.StructType([*boxed.schema.fields[:3], *T.StructType.fromDDL(SCORES_DDL).fields]))


def border(scored: DataFrame, sample: DataFrame) -> float:
    """The weight that best parts good from bad labels of the sample, each held out; minus infinity if either is missing."""
    seen = scored.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("held_out_weight").alias("w"), F.first("good").alias("good")).collect()
    w, good = np.array([r["w"] for r in seen]), np.array([r["good"] for r in seen], bool)
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(w, kind="stable")
    w, good = w[order], good[order]
    right = np.cumsum(~good) / (~good).sum() + 1 - np.cumsum(good) / good.sum()
    right[:-1][w[1:] == w[:-1]] = -1
    at = int(np.argmax(right))
    return float(w[at] if at + 1 == len(w) else (w[at] + w[at + 1]) / 2)


def kept(key_bits: str, splitter: tuple[int, int]) -> str:
    h, k = splitter
    return f"({key_bits} > {h}L OR {key_bits} = {h}L AND coalesce(doc_id, {LOW + 1}L) >= {max(k, LOW + 1)}L)"


def choose(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> tuple[Model, DataFrame, str]:
    """(model, thin table of doc_id and scores, the condition on key_bits under which a row is drawn)."""
    model = fit(docs, labels, sample_rows)
    thin = cut_lineage(score(docs.select("doc_id", "text"), model).drop("text", "rest"))
    edge = border(thin, model.sample)
    total, k = thin.agg(F.count("*"), F.coalesce(F.sum((F.col("log_weight") > edge).cast("bigint")), F.lit(0))).first()
    if k >= total:
        return model, thin, "true"
    keys = thin.selectExpr("key_bits AS h", f"coalesce(doc_id, {LOW + 1}L) AS k", "1L AS size")
    return model, thin, kept("key_bits", find_splitters(keys, [total - k], 0, "n")[0])


def resample(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns. The decision is one key, so no text is shuffled."""
    model, _, condition = choose(docs, labels, sample_rows)
    drawn = score(docs, model).where(condition)
    return drawn.select(*[c if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])
