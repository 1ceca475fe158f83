"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bestfit, dialogue, exact, lines, mixing, neighbours, packing, repeats, sharding, simhash, spelling, toxicity, warc,
)
from shelfwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, bits=4, keep=["doc_id"])
    return groups.select("doc_id", "fingerprint", "component_id")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), length=400, keep=["doc_id"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.captures(spark, table(spark, sf_dir, "pages"), least_revisit=1000)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.even_shards(table(spark, sf_dir, "documents"), shards=8, keep=["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(spark, docs, labels, keep=["doc_id"])


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, cap=3, keep=["doc_id"])


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_similar_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])


def tokenizer() -> dict[str, str]:
    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "pattern": public_tokenizers.PATTERN}


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=1024, **tokenizer())


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(table(spark, sf_dir, "documents"), length=1024, end_id=2, **tokenizer())


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = partial(spelling.slipped, slip=199)
    return spelling.variants(table(spark, sf_dir, "documents"), shortest=6, least=5, ratio=5, spell=spell)


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damaged(turns), every=turns)


REGISTRY: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_repeats, op3_warc, op4_sharding, op5_toxicity,
        op6_exact, op7_neighbours, op8_mixing, op9_lines, op10_packing,
        op11_best_fit, op12_spelling, op13_dialogue,
    )
}

STATEMENTS: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
        ), r AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p
        )
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to,
            array_to_string(list_reverse(string_split(regexp_replace(
                lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', ''), '.')), ',') || ')'
                || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) = '' THEN '/'
                    ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) END AS url_key,
            strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
        FROM r
    """,
    "op6_exact": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY text)
    """,
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), n AS (
            SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s
        ), w AS (
            SELECT *, [5, 2, 1][(turn % 3) + 1]::BIGINT AS weight, source_size * 3 AS most FROM n
        ), o AS (
            SELECT *,
                coalesce(sum(most) OVER e, 0)::DOUBLE AS most_before, coalesce(sum(weight) OVER e, 0)::DOUBLE AS weight_before
            FROM w WINDOW e AS (ORDER BY most::DOUBLE / weight::DOUBLE, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT max(((SELECT sum(source_size) FROM w)::DOUBLE - most_before)
                / ((SELECT sum(weight) FROM w)::DOUBLE - weight_before)) AS level FROM o
        ), t AS (
            SELECT source, source_size, turn, least(most::DOUBLE, level * weight) AS target FROM w, l
        ), r AS (
            SELECT d.doc_id, d.size, t.turn, t.target,
                unnest(range(CASE WHEN source_size > 0 THEN ceil(target / source_size)::BIGINT ELSE 0 END)) AS epoch
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0
        ), q AS (
            SELECT *, coalesce(sum(size) OVER (
                PARTITION BY turn ORDER BY epoch, md5('7|' || epoch || '|' || doc_id), doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM r
        ), k AS (
            SELECT doc_id, sum(greatest(0, least(size, floor(target - start)::BIGINT)))::BIGINT AS taken FROM q GROUP BY doc_id
        )
        SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.doc_id = k.doc_id
    """,
}
