"""The thin queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, html_wrapper, license_scan, ngram_join, packing, pii, pq_dedup, repetition, token_file, warc_zip
from .oracle import ORACLE_SQL  # noqa: F401

#: The key of the surrogates; a deployment passes its own secret.
PII_KEY = b"pipewright example key"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "base_failed", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_files(_table(spark, sf_dir, "documents"), WORD_BPE, end=2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(_table(spark, sf_dir, "pages"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE, end=1, capacity=4096)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pq_dedup, op2_repetition, op3_token_files, op4_license_scan, op5_byte_bpe, op6_html_wrapper, op7_pii_surrogates, op8_warc_zip, op9_best_fit_packing, op10_ngram_join)}
