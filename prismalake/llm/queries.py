"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, html_text, mixing, ngram_join, ogg_media, passage_dedup, secret_scan, toxicity, warc_bundles
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.contract(table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.contract(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.contract(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.contract(table(spark, sf_dir, "documents"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.contract(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.contract(table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.contract(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_decontaminate,
        op3_warc,
        op4_chat_format,
        op5_toxicity,
        op6_html_text,
        op7_ngram_join,
        op8_ogg_media,
        op9_secret_scan,
        op10_passage_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p),
        w AS (SELECT d, n, max(page_id) AS m FROM q WHERE n >= 1000 GROUP BY d, n)
        SELECT q.page_id, q.n AS payload_bytes, q.d AS payload_digest,
               CASE WHEN q.page_id < w.m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN q.page_id < w.m THEN w.m END AS refers_to
        FROM q LEFT JOIN w ON q.d = w.d AND q.n = w.n""",
    "op4_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') AS safe,
              CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE '"' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '\</turn>'), '"', '\"') || '"' END AS name FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ') + length(name) + length(': ') + length(safe) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
