"""Seeded inputs."""

from __future__ import annotations

import decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant_blocks(spark: SparkSession, rows: int, cols: int, splits: int, seed: int = 0) -> DataFrame:
    """rows(i, data): each split's cells are one random number of its own."""
    from gridloom.operators.matrix import row_ranges

    start = np.random.default_rng(seed).integers(0, 32767, splits)
    cases = F.lit(0)
    for (a, n), s in zip(row_ranges(rows, splits), start.tolist(), strict=True):
        cases = F.when((F.col("id") >= a) & (F.col("id") < a + n), s + 1).otherwise(cases)
    return spark.range(rows).select(F.col("id").alias("i"), F.array_repeat(cases.cast("smallint"), cols).alias("data"))


def random_points(spark: SparkSession, n: int, dimension: int, seed: int = 0) -> DataFrame:
    """i, x: uniform in (-1, 1)."""
    return spark.range(n).select(F.col("id").alias("i"), F.array(*(F.rand(seed + k) * 2 - 1 for k in range(dimension))).alias("x"))


def symmetric_shorts(n: int, seed: int = 0) -> np.ndarray:
    """A stored matrix of products of random numbers, rounded up."""
    a = np.random.default_rng(seed).random(n)
    return np.ceil(32767 * np.outer(a, a)).astype(np.int16)


def gaussian_mixture(spark: SparkSession, n: int, k: int, dimension: int, deviation: float = 0.08, value_range: float = 100.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """points(id, x) dealt in turn to k uniform means, and centroids(cid, x) drawn anew."""
    rng = np.random.default_rng(seed)
    means, first = (rng.random((k, dimension)) * value_range - value_range / 2 for _ in range(2))
    table = F.array(*(F.array(*(F.lit(float(v)) for v in m)) for m in means))
    which = (F.col("id") % k).cast("int")
    points = spark.range(n).select("id", F.array(*(F.get(F.get(table, which), F.lit(j)) + F.randn(seed + 1 + j) * (deviation * value_range) for j in range(dimension))).alias("x"))
    return points, spark.createDataFrame([(i + 1, m.tolist()) for i, m in enumerate(first)], "cid int, x array<double>")


def two_decimals(value: float) -> str:
    """#0.00, halves to even."""
    return str(decimal.Decimal(repr(value)).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_EVEN))


def random_doubles(rows: int, cols: int, seed: int = 0) -> np.ndarray:
    """Whole numbers from 0 to 9 as doubles."""
    return np.random.default_rng(seed).integers(0, 10, (rows, cols)).astype(float)


def two_blocks(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Two blocks of rows: block, k, v, where v is 100 k as a 16-bit integer that wraps around."""
    hundred = F.pmod(F.col("k") * 100 + 32768, F.lit(65536)) - 32768
    return spark.range(2).select(F.col("id").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("k")).withColumn("v", hundred.cast("smallint"))
