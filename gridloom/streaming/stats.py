"""Cell statistics and k-means assignment over streams. The operators are the batch ones; state is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.kmeans import nearest


def windowed_stats(stream: DataFrame, time: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mergeable statistics of each time window; rows later than ``late`` are dropped by the watermark."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return rows.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), "n", "total", "low", "high")


def assign_stream(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """A stream of points with the nearest of fixed centroids."""
    return nearest(points, centroids)
