"""op10: the nearest neighbours of every hundredth embedding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import nearest as N
from gridloom.llm.shared import table


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
