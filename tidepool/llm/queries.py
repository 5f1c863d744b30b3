"""Queries op1 to op10: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidepool.llm import backoff, decontam, licences, matroska, nbsvm, ngram_join, packing, perspectives, ring, urlrules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples of a Matroska file, and read back from it."""
    return matroska.media_summary(matroska.stored(_table(spark, sf_dir, "documents")))


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 90 % or more of their 3-word shingles."""
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, of a model that has not seen the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    return nbsvm.scored(docs, nbsvm.learned(docs, _table(spark, sf_dir, "labels")))


#: The rules that op4 judges by.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules: the longest rule that fits, else allow."""
    return urlrules.judged(_table(spark, sf_dir, "pages"), urlrules.rules_table(spark, URL_RULES))


ORACLES["op4_url_filter"] = """
    WITH rules(host, path, action, rule) AS (VALUES
        ('com', '/en/', 'block', 'com/en/'), ('example.com', '/en/7', 'allow', 'example.com/en/7'), ('net', '/de/', 'allow', 'net/de/'),
        ('example.net', '/de/8', 'block', 'example.net/de/8'), ('org', '/es/', 'block', 'org/es/')),
    rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    hit AS (SELECT page_id, arg_max(struct_pack(rule := rules.rule, action := rules.action), length(rules.rule)) AS h
            FROM cut JOIN rules ON (cut.host = rules.host OR ends_with(cut.host, '.' || rules.host)) AND starts_with(cut.path, rules.path) GROUP BY page_id)
    SELECT page_id, host, path, h.rule AS rule, coalesce(h.action, 'allow') AS verdict FROM cut LEFT JOIN hit USING (page_id)
"""


@_query
def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of a bounded-load ring without slack: counts are at most one apart."""
    placed = ring.sharded(_table(spark, sf_dir, "documents"), shards=24, slack=0.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces in sequences of 1024 tokens at most."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score, of order 3, under the other documents."""
    return backoff.backoff_scores(_table(spark, sf_dir, "documents"))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a test item within the edit budget, with the item, the distance and where it ends."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return perspectives.rotated(_table(spark, sf_dir, "conversations"))


ORACLES["op9_perspective_rotation"] = """
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
                      replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS said,
                      coalesce(CAST(floor(turn / 512.0) AS BIGINT), -1) AS block FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, speaker, said) - 1 AS rank FROM t),
    s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
    x AS (SELECT r.conv_id, perspective, block, CAST(rank // 512 AS INTEGER) AS part, rank, speaker = perspective AS own,
                 '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(replace(translate(speaker, chr(13) || chr(10), '  '), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') END || chr(10) AS opened,
                 said || '<|im_end|>' AS body
          FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
    y AS (SELECT *, sum(length(opened) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block, part ORDER BY rank) AS stop FROM x)
    SELECT conv_id, perspective, block, part, count(*) AS n_turns, string_agg(opened || body || chr(10), '' ORDER BY rank) AS rendered,
           coalesce(string_agg(CASE WHEN own THEN CAST(stop - 1 - length(body) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT) END, ',' ORDER BY rank), '') AS mask,
           CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS masked_chars
    FROM y GROUP BY conv_id, perspective, block, part
"""


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that states a licence: its family, or unknown."""
    return licences.scanned(_table(spark, sf_dir, "documents"))
