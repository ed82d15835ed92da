"""op7: the toxicity of each document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import toxicity as X
from gridloom.llm.shared import held_out, table


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    index = X.fit(docs, table(spark, sf_dir, "labels").filter(~out))
    found = X.score(docs, index, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "evidence")
