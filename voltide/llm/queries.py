"""The corpus operators as registered queries over the whole tables, with the SQL each is checked against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from voltide.llm import bpe, centroids, chat, decontam, fingerprint, jaccard_join, langid, quality, repair, secret_scan, sharding, suffix_dedup, warc
from voltide.llm.common import read
from voltide.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40

# ---- 1: chat formatting -------------------------------------------------------------

PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{PROBE_TEXT}' AS text")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = formatted.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"),
                            chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "expanded_tokens")
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "expanded_tokens")


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}'),
sums AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(12 + 1 + 10 + 1 + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
        + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens FROM sums
"""

# ---- 2: BPE -------------------------------------------------------------------------


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"), bpe.load_vocabulary(vocabulary or bpe.default_vocabulary()))
    return encoded.selectExpr("doc_id", "CAST(octet_length(ids) DIV 4 AS BIGINT) AS n_tokens", "sha2(ids, 256) AS ids_sha256",
                              "sha2(decoded, 256) AS decoded_sha256")


# ---- 3: quality ---------------------------------------------------------------------


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores, drawn = quality.choose(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.select("doc_id", "log_weight", "sort_key", F.expr(drawn).alias("kept"))


# ---- 4: suffix-array dedup ----------------------------------------------------------


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


# ---- 5: decontamination -------------------------------------------------------------


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP5_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL),
hits AS (
  SELECT doc_id, item_id, n_shared / n AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared / n >= 0.8),
best AS (
  SELECT doc_id, count(*) AS n_items, max(containment) AS containment, arg_max(item_id, (containment, -item_id)) AS item_id FROM hits GROUP BY doc_id)
SELECT d.doc_id, b.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, coalesce(containment, 0.0::DOUBLE) AS containment
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""

# ---- 6: Jaccard join ----------------------------------------------------------------


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_groups(read(spark, sf_dir, "documents"))


# ---- 7: language ID -----------------------------------------------------------------


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn(
        "held_out", F.expr("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 4 = 2"))
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


# ---- 8: WARC ------------------------------------------------------------------------


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    path = scratch_path(spark)
    warc.write_archive(pages, warc.plan_revisits(pages), path)
    return warc.resolve(warc.read_archive(spark, path))


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
keeper AS (SELECT b, max(page_id) AS keeper FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT page_id, octet_length(p.b) AS payload_bytes, sha1(p.b) AS payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to, 'ok' AS status
FROM p LEFT JOIN keeper ON p.b = keeper.b
"""

# ---- 9: sharding --------------------------------------------------------------------


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CAST(coalesce(octet_length(text), 0) + 16 AS BIGINT) AS size",
        "CAST(crc32(coalesce(text, '')) AS BIGINT) AS text_crc32", "xxhash64(text) AS group_hash")
    placed = sharding.shard_rows(docs, SHARDS)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


# ---- 10: fingerprints ---------------------------------------------------------------


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


# ---- 11: secret scan ----------------------------------------------------------------


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"),
                        said(F.col("spans")).alias("spans"), count("guess"))


# ---- 12: conversation repair --------------------------------------------------------


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Deterministic faults, chosen by crc32 of ``conv_id:turn`` modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kinds = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                         (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    return kinds.selectExpr(
        "conv_id", "turn", "IF(kind = 4, 'user', role) AS role",
        "CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(array_repeat(0, IF(kind = 3, 2, 1))) AS copy").drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    report = repair.repair_report(damaged_turns(turns)).withColumnRenamed("conv_id", "found_id").withColumn("found", F.lit(True))
    ids = turns.select("conv_id").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(report, F.expr("conv_id <=> found_id"), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in repair.COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op12_sql() -> str:
    """Forward program over rows in a recursive query: of each state the least (cost, audit) and the text so far."""
    big = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    add = lambda s, cost, edit, said="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': {s}.r || {said}}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    kept = "chr(10) || role || ':' || text"
    keep = lambda s, letter: f"CASE WHEN stays AND initial = '{letter}' THEN {add(s, 'late', 'K', kept)} ELSE {big} END"
    name = lambda s, role: f"CASE WHEN stays THEN {add(s, '2 + late', 'R', f"chr(10) || '{role}:' || text")} ELSE {big} END"
    put = lambda s, role: add(s, 2, "I", f"chr(10) || '{role}:'")
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda i:
      [CAST(ascii(k[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295::BIGINT) % 20 AS kind FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS MATERIALIZED (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, i,
    CASE WHEN NOT regexp_matches(text, '[^ \x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ \x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
ruled AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM numbered),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {big} AS s1, {{'c': 2::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2,
    {{'c': 4::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, b0, b1, {least('c2', put('b3', 'user'))}, {least('b3', put('c2', 'assistant'))} FROM (
    SELECT *, {least('b2', put('b0', 'user'), put('b1', 'user'))} AS c2 FROM (
      SELECT dp.conv_id, dp.i + 1 AS i, {add('s0', 3, 'D')} AS b0, {least(add('s1', 3, 'D'), keep('s0', 's'))} AS b1,
        {least(add('s2', 3, 'D'), keep('s0', 'u'), keep('s1', 'u'), keep('s3', 'u'), name('s0', 'user'), name('s1', 'user'), name('s3', 'user'))} AS b2,
        {least(add('s3', 3, 'D'), keep('s2', 'a'), name('s2', 'assistant'))} AS b3
      FROM dp JOIN ruled ON dp.conv_id IS NOT DISTINCT FROM ruled.conv_id AND ruled.i = dp.i + 1))),
ends AS (SELECT conv_id, {least('max_by(s0, i)', 'max_by(s3, i)')} AS best FROM dp GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM ruled GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
"""


# ---- 13: centroid clustering --------------------------------------------------------

CENTROIDS, ROUNDS = 40, 5


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(read(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS)
    return centroids.with_inertia(found).selectExpr("id AS vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sql() -> str:
    """The same rounds with every distance taken, as one chain of materialised tables."""
    near = """(SELECT vec_id, any_value(x) AS x, min((d, c)) AS best FROM (
      SELECT vec_id, n, x, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS d FROM v, c{r}) GROUP BY vec_id, n)"""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT x, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, x LIMIT {CENTROIDS}))"""]
    for r in range(ROUNDS):
        steps.append(f"""sums{r} AS (
  SELECT best[2] AS c, u.i AS i, sum(x[u.i]) AS s, count(*) AS k FROM {near.format(r=r)}, (SELECT unnest(range(1, 65)) AS i) u GROUP BY ALL)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(any_value(t.m), any_value(c{r}.m)) AS m FROM c{r}
  LEFT JOIN (SELECT c, list(CAST((s - ((s % k + k) % k)) // k AS BIGINT) ORDER BY i) AS m FROM sums{r} GROUP BY c) t ON t.c = c{r}.c GROUP BY c{r}.c)""")
    return "WITH " + ",\n".join(steps) + f""",
placed AS MATERIALIZED (SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM {near.format(r=ROUNDS)})
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM placed JOIN c{ROUNDS} ON c = cluster
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_chat_format": (op1_chat_format, OP1_SQL),
    "op2_bpe": (op2_bpe, None),
    "op3_quality": (op3_quality, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_decontaminate": (op5_decontaminate, OP5_SQL),
    "op6_jaccard": (op6_jaccard, None),
    "op7_language": (op7_language, None),
    "op8_warc": (op8_warc, OP8_SQL),
    "op9_shard": (op9_shard, None),
    "op10_fingerprint": (op10_fingerprint, None),
    "op11_secrets": (op11_secrets, None),
    "op12_repair": (op12_repair, op12_sql()),
    "op13_centroids": (op13_centroids, op13_sql()),
}


def entries() -> dict[str, tuple[Query, str | None]]:
    return {**QUERIES, "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
