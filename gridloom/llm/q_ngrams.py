"""op2: documents by what they are linked to."""

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import ngram_join as J
from gridloom.llm.shared import table


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
