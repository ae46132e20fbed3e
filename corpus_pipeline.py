"""A corpus pipeline over ``documents``: quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm import ngram_join, packing, pii, repetition
from pipewright.llm.common import settle
from pipewright.llm.queries import PII_KEY, WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; repeated rows stay as often as they stand there. Any further columns stay."""
    return repetition.quality_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays; those without an id all stay.

    Null and empty texts stand alone. Of rows that repeat an id, one of each text stays. An empty table
    gives no rows, and any further columns stay.
    """
    found = settle(ngram_join.similar_documents(docs).select("doc_id", "component_id"), "groups", few=True)
    copies = settle(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies", few=True)
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars, where there is one, is counted again. Every row and all columns stay; null text stays null."""
    done = pii.replace_entities(docs, PII_KEY).select(*docs.columns)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; null and empty texts are the end id alone. An empty table gives no rows."""
    return packing.pack_documents(docs, WORD_BPE, end=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("pii_surrogates", personal_data),
    ("best_fit_packing", pack),
]

#: Tokens, surrogates and packing have no SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
