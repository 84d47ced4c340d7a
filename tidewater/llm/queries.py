"""The corpus operators as queries over the given tables: op1 to op13, and the SQL that checks op5, op11 and op13."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, line_dedup, merkle, nnls_packing, ppm, packing, prefix_trie, repetition, simhash, sql, token_counts, toxicity, url_filter
from ._text import documents

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(documents(spark, sf_dir, "pages"), rules).select("fields.page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    return merkle.proofs(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], shown)


def op12_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(documents(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_lm_scores, op4_repetition, op5_url_filter, op6_license_scan, op7_line_dedup, op8_packing, op9_decontamination, op10_simhash, op11_merkle, op12_nnls_packing, op13_prefix_trie)}

ORACLE = {
    "op5_url_filter": """
        WITH parsed AS (
          SELECT page_id, split_part(split_part(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '?', 1), '#', 1) AS bare FROM pages
        ), split AS (
          SELECT page_id, translate(split_part(coalesce(bare, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 substr(coalesce(bare, ''), length(split_part(coalesce(bare, ''), '/', 1)) + 1) AS path FROM parsed
        ), judged AS (
          SELECT page_id, host, path,
                 CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
                      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
                      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
                      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
                      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
          FROM split
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict FROM judged
    """,
    "op11_merkle": sql.MERKLE,
    "op13_prefix_trie": sql.TRIE,
}
