"""Benchmark decontamination, in DataFrame and SQL functions only.

Test items are short and documents may be long, so similarity of whole sets says little; what counts is
containment, the share of an item's word shingles that a document holds. Documents are partitioned by size
(shingles, in powers of two). In the class of up to 2**c shingles a one-permutation MinHash has 2**(c + 3) bins: a
document keeps the least hash of each of its bins, and so does an item, once for each class. As a document has at
most one shingle per eight bins on average, a shared shingle is the least of its bin in both with a chance of 0.88 or
more in every class; an item of m shingles that is contained by 0.8 is missed with a chance below 0.12 ** (0.8 m).
Items of up to ``SHORT`` shingles, for which that is not small, are looked up among all of a document's shingles and
never missed. Any document and item that meet are verified on the shingles themselves.

Defined results: null or empty texts and items hold nothing; fewer than five words are one shingle; repeated rows
each get their result; rows are told apart by doc_id and text, null ids included; ties for the fullest item go to the
smallest item_id; extra columns are ignored by ``judge`` and kept by ``clean``; with no items every document is clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import fresh
from voltide.session import cut_lineage

SPACE = r" \t\n\x0B\f\r"
CLASSES = 40                     # sizes up to 2**40 shingles
SPREAD = 3                       # 2**3 bins for each shingle
SHORT = 10
BROADCAST_ROWS = 1_000_000       # a frame of at most so many rows of numbers is broadcast; beyond that it is shuffled


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` plus w, the words of the lower-cased text; a text without words has one empty word."""
    stripped = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return rows.withColumn("w", F.split(stripped, f"[{SPACE}]+"))


def with_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` (with w) plus hs, the sorted hashes of its five-word shingles."""
    return rows.withColumn("hs", F.expr("""sort_array(CASE
        WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i+1], w[i+2], w[i+3], w[i+4]))
        WHEN w[0] <> '' THEN array(xxhash64(array_join(w, ' '))) ELSE CAST(array() AS ARRAY<BIGINT>) END)"""))


def with_shingles(rows: DataFrame) -> DataFrame:
    """``rows`` (with w) plus s, its distinct shingles as texts."""
    return rows.withColumn("s", F.expr("""array_distinct(CASE
        WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]))
        WHEN w[0] <> '' THEN array(array_join(w, ' ')) ELSE CAST(array() AS ARRAY<STRING>) END)"""))


def least_of_bin(c: str) -> str:
    """Whether the i-th hash x of hs is the least of its bin. Bins are leading bits, so they are runs of the sorted hashes."""
    bits = f"64 - {c} - {SPREAD}"
    return f"(i = 0 OR shiftrightunsigned(x, {bits}) <> shiftrightunsigned(hs[i - 1], {bits}))"


def small(frame: DataFrame) -> DataFrame:
    """``frame`` (a table of numbers) marked for broadcast if it has few rows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, th, item_id) that meet; th is a hash of the text, for rows that repeat a doc_id."""
    sized = with_hashes(with_words(docs.selectExpr("doc_id", "xxhash64(text) AS th", "text"))).drop("text", "w")
    classed = sized.withColumn("c", F.expr("CAST(greatest(1, ceil(log2(size(hs)))) AS INT)"))
    # explode_outer: the test for empty arrays that explode() adds would be pushed down and hash the text anew per element
    held = classed.withColumn("e", F.explode_outer(F.expr(f"transform(hs, (x, i) -> struct(x AS h, {least_of_bin('c')} AS least))"))).selectExpr(
        "doc_id", "th", "c", "e.h AS h", "e.least AS least")
    asked = with_hashes(with_words(items.select("item_id", "text"))).drop("text", "w")
    classes = f"filter(sequence(1, {CLASSES}), c -> {least_of_bin('c')})"
    item_hashes = cut_lineage(asked.withColumn("e", F.explode_outer(F.expr(
        f"transform(hs, (x, i) -> struct(x AS h, size(hs) <= {SHORT} AS short, {classes} AS classes))"))).selectExpr(
        "item_id", "e.h AS h", "e.short AS short", "e.classes AS classes").where("h IS NOT NULL"))
    met = held.join(small(item_hashes), "h").where("short OR least AND array_contains(classes, c)")
    return met.select("doc_id", "th", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, th, item_id, n_shared, containment) of documents that hold ``threshold`` of an item's shingles."""
    found = cut_lineage(candidates(docs, items))
    wanted = cut_lineage(found.select("doc_id", "th").distinct())
    held = docs.selectExpr("doc_id", "xxhash64(text) AS th", "text").join(
        small(wanted.withColumnsRenamed({"doc_id": "met_id", "th": "met_th"})), F.expr("doc_id <=> met_id AND th = met_th"), "left_semi").dropDuplicates(["doc_id", "th"])
    texts = with_shingles(with_words(held)).selectExpr("doc_id", "th", "s AS doc_s")
    asked = with_shingles(with_words(items.select("item_id", "text").dropDuplicates())).selectExpr("item_id", "s AS item_s")
    pairs = texts.join(found.withColumnsRenamed({"doc_id": "met_id", "th": "met_th"}), F.expr("doc_id <=> met_id AND th = met_th")).join(asked, "item_id")
    return pairs.withColumn("n_shared", F.size(F.array_intersect("doc_s", "item_s")).cast("bigint")).withColumn(
        "containment", F.col("n_shared") / F.size("item_s")).where(F.col("containment") >= threshold).select(
        "doc_id", "th", "item_id", "n_shared", "containment")


def judge(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document row: doc_id, contaminated, n_items, and the fullest item with its containment."""
    hits = cut_lineage(contained(docs, items, threshold).groupBy("doc_id", "th").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("containment").alias("containment"),
        F.max_by("item_id", F.struct("containment", -F.col("item_id"))).alias("item_id")))
    named = hits.withColumnsRenamed({"doc_id": "met_id", "th": "met_th"})
    return docs.selectExpr("doc_id", "xxhash64(text) AS th").join(small(named), F.expr("doc_id <=> met_id AND th = met_th"), "left").selectExpr(
        "doc_id", "n_items IS NOT NULL AS contaminated", "coalesce(n_items, 0L) AS n_items", "item_id", "coalesce(containment, 0D) AS containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without contaminated rows."""
    id_, th_ = fresh(docs.columns, "hit_id", "hit_th")
    hits = cut_lineage(contained(docs, items, threshold).select(F.col("doc_id").alias(id_), F.col("th").alias(th_)).distinct())
    return docs.join(small(hits), F.expr(f"doc_id <=> `{id_}` AND xxhash64(text) = `{th_}`"), "left_anti")
