"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import htmlmain, langid, mixing, pii, radix_dedup, secretscan, simhash, spiece, tokenout, vecdup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_report(_table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.write_and_read(_table(spark, sf_dir, "documents"), added=True)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_report(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode_report(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_report(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_token_ids, op4_secret_scan, op5_sentencepiece, op6_exact_dedup, op7_personal_data, op8_embedding_dedup, op9_html_text, op10_simhash_dedup)}


#: Targets from the level that each round raises; copies from the prefix sums of one source.
OP1 = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM per),
level(k, x) AS (
  SELECT 0, 0::DOUBLE UNION ALL
  SELECT k + 1, greatest(x, (SELECT (sum(source_size)::DOUBLE - coalesce(sum(cap) FILTER (cap <= w * x), 0)) / sum(w) FILTER (cap > w * x) FROM w)) FROM level WHERE k < 40),
rates AS (
  SELECT source, source_size, least(cap, w * (SELECT max(x) FROM level)) AS target,
    CASE WHEN source_size > 0 THEN least(least(cap, w * (SELECT max(x) FROM level)) / source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
    ('0x' || substr(md5('20|' || CASE WHEN source IS NULL THEN 'true|' ELSE 'false|' || source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS n FROM sized)
SELECT doc_id, r.source, size, source_size, target, (floor(u + rate * n) - floor(u + rate * (n - 1)))::BIGINT AS copies,
  (floor(u + rate * n) - floor(u + rate * (n - 1)))::BIGINT * size AS taken
FROM ranked r JOIN rates p ON r.source IS NOT DISTINCT FROM p.source
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: All pairs of different vectors by brute force, then everything reachable by links.
OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts ON x = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op6_exact_dedup": OP6, "op8_embedding_dedup": OP8}
