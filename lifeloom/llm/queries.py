"""The registered query of each training-data operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeloom.llm import chat, languages, licenses, ngram_join, packing, pieces, spotsigs, topk, toxicity, warc
from lifeloom.llm.common import durable, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids, taken in the JVM so that a task has one Python worker."""
    return pieces.select(*(F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in pieces.columns))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and follow each revisit to the response that has its payload."""
    path = warc.new_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path).select(
        "record_id", "record_type", "page_id", "refers_to", "refers_to_page",
        F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"),
    )
    records = durable(read)
    stored = records.where("record_type = 'response'").select("page_id", "record_type", "n", "sha1", F.lit(None).cast("long").alias("refers_to"))
    target = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "n", "sha1")
    again = records.where("record_type = 'revisit'").drop("n", "sha1").join(target, "refers_to")
    again = again.select("page_id", "record_type", "n", "sha1", F.col("refers_to_page").alias("refers_to"))
    return stored.unionByName(again).select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.withColumn("held_out", toxicity.held_out(scored["doc_id"]))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT CAST(c AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (-1, 0, 'user'), (-1, 1, 'assistant') AS x(c, t, r)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = chat.formatted_turns(rows)
    read = chat.read_back(turns, chat.examples(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("written").cast("long").alias("formatted_chars"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.predict(docs, languages.train(docs))
    return found.withColumn("held_out", languages.held_out(found["doc_id"]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as a CRC-32, and whether they decode to it (U+2581 decodes to a space)."""
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", "n_ids", "n_byte_ids", "score",
        F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("decoded_chars"),
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_license_scan, op2_ngram_join, op3_packing, op4_warc, op5_toxicity, op6_spotsigs, op7_top_k, op8_chat, op9_language_id, op10_sentencepiece)}


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS grams, text
  FROM d
),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
linked AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*))
  UNION
  SELECT x.doc_id, y.doc_id FROM s x JOIN s y ON x.text = y.text AND x.doc_id <> y.doc_id
),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n FROM linked GROUP BY a)
SELECT c.doc_id, c.class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links FROM c LEFT JOIN k ON c.doc_id = k.doc_id
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
),
kept AS (SELECT html, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN kept ON n >= 1000 AND p.html = kept.html
"""


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
w AS (
  SELECT *, 7 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '[', '\('), ']', '\)'), '<', '\{'), chr(10), '\|'))
    + 1 + length(replace(replace(replace(replace(text, '\', '\\'), '[', '\('), ']', '\)'), '<', '\{')) + 5 AS n
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op4_warc": OP4_SQL, "op7_top_k": OP7_SQL, "op8_chat": OP8_SQL}
