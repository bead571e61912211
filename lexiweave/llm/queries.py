"""The queries op1 to op10 over whole tables, with the parameters of production, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, langid, packing, simhash, substring, tokenstore, topk, warc
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).drop("fp")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_documents(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5, scale=256.0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.format_turns(table(spark, sf_dir, "conversations"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "role_pred", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS n FROM p),
m AS (SELECT page_id, n, h, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS best FROM s)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM m
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, spot, md5(array_to_string(w[spot:spot + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS spot FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(spot, spot + 50)) AS pos FROM g JOIN f USING (h) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed, string_agg(CASE WHEN gone.pos IS NULL THEN word END, ' ' ORDER BY words.pos) AS t
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[spot:spot + n - 1], ' ') AS phrase
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS spot FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, spot, array_to_string(w[spot:spot + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS spot FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, item_id, spot, g.n AS n FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS pos FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: What a faultless parse gives: each turn alone, with the role it was written with.
OP9_SQL = """
WITH t AS (SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS r FROM conversations)
SELECT conv_id, turn, role, role AS role_pred, CAST(1 AS BIGINT) AS n_turns, CAST(length(r) AS BIGINT) AS n_chars, sha256(r) AS rendered_sha256 FROM t
"""


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_warc": op2_warc,
        "op3_token_store": op3_token_store,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_decontamination": op7_decontamination,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_chat_format": op9_chat_format,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op7_decontamination": OP7_SQL, "op8_exact_top_k": OP8_SQL, "op9_chat_format": OP9_SQL}
