"""op6: documents without the passages of 100 bytes that stand earlier."""

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import repeats as R
from gridloom.llm.shared import table


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False).drop("kept")
