"""op8: the quality of each document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import quality as Q
from gridloom.llm.shared import held_out, table


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    trusted = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~out)
    found = Q.score(docs, Q.fit(docs, trusted), ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
