"""The queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, clustering, decontamination, html, packing, quality_classifier, quality_rules, secrets, simhash, substring_dedup, suffix_dedup, token_counts, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.Alignment(table(spark, sf_dir, "documents")).scores()


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts, op2_secrets, op3_simhash, op4_html, op5_suffix_dedup, op6_quality_classifier, op7_quality_rules,
        op8_decontamination, op9_substring_dedup, op10_packing, op11_alignment, op12_warc, op13_clustering,
    ]
    return {f.__name__: f for f in found}


#: Windows of 50 bytes by the first document that holds them, as hexadecimal text.
OP5_SQL = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, x, unnest(range(1, CAST(length(x) / 2 AS BIGINT) + 1)) AS i FROM d),
windows AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS w, substr(x, 2 * i - 1, 2) AS b, 2 * i + 98 <= length(x) AS whole FROM places),
owned AS (SELECT doc_id, i, b, whole AND doc_id > min(doc_id) OVER (PARTITION BY w) AS again FROM windows),
covered AS (
  SELECT doc_id, i, b, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM owned),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
kept AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS left_over
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: Windows of 20 words, numbered by their places.
OP9_SQL = r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
windows AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN md5(array_to_string(ws[i:i+19], ' ')) END AS w FROM places),
numbered AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows),
covered AS (
  SELECT doc_id, i, word,
    coalesce(max(CASE WHEN w IS NOT NULL AND nth > 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM numbered),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS left_over
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_dedup": OP5_SQL, "op9_substring_dedup": OP9_SQL}
