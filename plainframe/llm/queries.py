"""The queries of this folder, for the driver: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, line_dedup, near_dedup, packing, quality_rules, secret_scan, substring_dedup, token_counts, toxicity
from .shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=~toxicity.held_out())
    out = toxicity.score(docs, index)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.transform("evidence", lambda x: x["id"]).alias("evidence"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", report=True)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=4).drop("print")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(table(spark, sf_dir, "documents"), "source", "doc_id")
    live = F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", live)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_line_dedup, op4_best_fit_packing, op5_minhash_near_dedup, op6_exact_dedup, op7_token_counts, op8_byte_bpe, op9_secret_scan, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring_dedup.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op6_exact_dedup": OP6}


OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
