"""Mergeable statistics of matrix cells, and scalar summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_stats(cells: DataFrame, value: Column | None = None, skip_missing: bool = True) -> DataFrame:
    """One row: n, total, mean, low, high, sum_of_squares, positive_min of value (decoded cells v). Negative is missing."""
    v = F.col("v") if value is None else value
    rows = cells.select(v.alias("v"))
    rows = rows.filter("v >= 0") if skip_missing else rows
    return rows.agg(
        F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.sum(F.col("v") * F.col("v")).alias("sum_of_squares"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("positive_min"),
    )


def block_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_blocks"))


def log_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """high, low and mean of a numeric column for each group."""
    return rows.groupBy(group).agg(F.max(value).alias("high"), F.min(value).alias("low"), F.avg(value).alias("mean"))


def mean_cg_iterations(history: DataFrame) -> DataFrame:
    """Average inner iterations of each temperature loop."""
    return history.groupBy("t_itr").agg((F.sum("cg_count") / F.count("*")).alias("mean_cg"))
