"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, hardneg, jaccard, licenses, media, periodic, quality, sufdedup, toxicity, urlfilter, warc
from .storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.report(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_decontamination": op2_decontamination,
        "op3_chat_quotation_linking": op3_chat_quotation_linking,
        "op4_quality": op4_quality,
        "op5_progressive_jpeg": op5_progressive_jpeg,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_toxicity": op9_toxicity,
        "op10_warc_archive": op10_warc_archive,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_url_filter": op12_url_filter,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_warc_archive": """
            WITH p AS (
              SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
              FROM pages),
            r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
            FROM r""",
        "op11_hard_negatives": """
            WITH v AS (
              SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
              FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
            s AS (
              SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
                     list_inner_product(a.q, c.q)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id % 100 = 0 AND (a.label <> c.label OR a.vec_id <> c.vec_id)),
            p AS (
              SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id,
                   positive_score, s.score AS negative_score
            FROM p JOIN s USING (anchor_id)
            WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
            WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
            QUALIFY row_number() OVER w <= 5""",
    }
