"""From raw documents to token ids in five stages.

1. quality: documents that importance resampling does not draw go.
2. near_copies: of each group of near copies one document stays.
3. suffix_dedup: byte strings that still occur more than once are cut out of the texts.
4. decontaminate: documents that hold a benchmark item go.
5. bpe: texts become token ids.

Each stage reads what the one before wrote. Scratch tables of a stage are dropped when the next one begins, as its
result is a table of its own by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltide.llm import bpe, decontam, jaccard_join, quality, suffix_dedup
from voltide.llm.common import bounded_batches, read
from voltide.session import drop_tables, scratch_path, scratch_scope

SCOPE = "pipeline stage"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage whose scratch tables live until the next stage begins."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, SCOPE)
        bounded_batches(spark)
        with scratch_scope(SCOPE):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.resample(docs, read(spark, sf_dir, "labels"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit) and their number."""
    encoded = bpe.encode(docs, bpe.load_vocabulary(bpe.default_vocabulary()))
    return encoded.selectExpr("doc_id", "ids", "CAST(octet_length(ids) DIV 4 AS BIGINT) AS n_tokens")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: The stages fit models, hash and merge; the tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, work in STAGES:
        path = scratch_path(spark)
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    drop_tables(spark, SCOPE)
    return docs
