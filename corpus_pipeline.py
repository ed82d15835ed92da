"""The corpus pipeline: documents to packed sequences.

Every stage reads all that its predecessor kept and takes its own decisions: language ID drops what it
rejects, the n-gram join keeps one document of each component, decontamination drops documents that hold benchmark items,
the secret scan redacts, packing ends it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, language_id, ngram_join, secret_scan
from gridloom.llm.q_packing import packed
from gridloom.llm.shared import Scratch, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those far from every language; learns from all labelled languages."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.detect(docs, model).filter(~F.col("lang_rejected")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the least id."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts; n_chars follows the text."""
    found = secret_scan.redact(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("language ID", languages), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("secret scans", secrets), ("best-fit packing", sequences)]

#: Token ids and learned languages have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{number}")
            scratch.drop(*[f"stage-{number - 1}"] * (number > 0))
    return docs
