"""Inputs of the registered queries, built alike in Spark and in SQL.

nation gives 25 points with whole-number coordinates: their distance matrix, with missing pairs and
zero weights, stands for stored matrices. supplier gives a larger one. embeddings feed k-means.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import scaling as S
from gridloom.session import shared_dir
from gridloom.sources.matrix import write_matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def seeds(spark: SparkSession, sf_dir: str, k: int = 5, far: bool = False) -> DataFrame:
    """The first k vectors as centroids; with far, one more that no point is near."""
    first = embeddings(spark, sf_dir).filter(F.col("id") < k).select((F.col("id") + 1).cast("int").alias("cid"), "x")
    if far:
        first = first.unionByName(first.filter("cid = 1").select(F.lit(k + 1).alias("cid"), F.transform("x", lambda v: v + 1000.0).alias("x")))
    return first


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored distances(i, j, v) of nation."""
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b"))
    q = p.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("e"))
    d = p.crossJoin(F.broadcast(q)).select("i", "j", F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) + (F.col("b") - F.col("e")) * (F.col("b") - F.col("e"))).alias("d"))
    top = d.agg(F.max("d").alias("m"))
    v = F.when((F.col("i") != F.col("j")) & ((F.col("i") + F.col("j")) % 7 == 0), -1).otherwise(F.floor(F.lit(32767.0) * F.col("d") / F.col("m")))
    return d.crossJoin(F.broadcast(top)).select("i", "j", v.cast("smallint").alias("v"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored weights(i, j, v) of nation."""
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    pairs = p.crossJoin(F.broadcast(p.select(F.col("i").alias("j"))))
    v = F.when((F.col("i") != F.col("j")) & ((F.col("i") + F.col("j")) % 11 == 0), 0).otherwise(10000 * (1 + F.col("i") * F.col("j") % 3))
    return pairs.select("i", "j", v.cast("smallint").alias("v"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weights_join(distances(spark, sf_dir), weights(spark, sf_dir))


def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("i"), F.array((k % 5) * F.lit(0.25), (k % 7) * F.lit(0.125)).alias("x"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, cells: DataFrame, label: str, dtype: str = "int16", endian: str = "big") -> str:
    """The path of a binary file of nation's 25 by 25 cells(i, j, v)."""
    rows = sorted(cells.select("i", "j", "v").collect())
    path = shared_path(spark, label)
    write_matrix(path, np.array([r.v for r in rows]).reshape(-1, math.isqrt(len(rows))), dtype, endian)
    return path


#: The same as common table expressions.
SQL = """
pts AS (SELECT n_nationkey::BIGINT AS i, n_nationkey::DOUBLE AS a, n_regionkey::DOUBLE AS b FROM nation),
dist AS (SELECT p.i, q.i AS j, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS d FROM pts p, pts q),
top AS (SELECT max(d) AS m FROM dist),
dshort AS (SELECT i, j, (CASE WHEN i <> j AND (i + j) % 7 = 0 THEN -1 ELSE floor(32767::DOUBLE * d / m) END)::SMALLINT AS v FROM dist, top),
wshort AS (SELECT i, j, (CASE WHEN i <> j AND (i + j) % 11 = 0 THEN 0 ELSE 10000 * (1 + i * j % 3) END)::SMALLINT AS v FROM dist),
cells AS (SELECT d.i, d.j, d.v::DOUBLE * (1::DOUBLE / 32767) AS delta, w.v::DOUBLE * (1::DOUBLE / 32767) AS w FROM dshort d JOIN wshort w USING (i, j)),
x AS (SELECT n_nationkey::BIGINT AS i, (n_nationkey % 5) * 0.25::DOUBLE AS x0, (n_nationkey % 7) * 0.125::DOUBLE AS x1 FROM nation),
v AS (SELECT i, 1 + sum(CASE WHEN i <> j AND delta >= 0 AND w <> 0 THEN w ELSE 0 END) AS v FROM cells GROUP BY i)
"""
EMB = "emb AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
