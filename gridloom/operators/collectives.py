"""Broadcast, gather, reduce and allreduce as DataFrame operations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import checkpointed


def broadcast(payload: DataFrame, workers: DataFrame) -> DataFrame:
    """Every worker (column worker) with the payload's one row of bounded size."""
    return workers.join(F.broadcast(payload.limit(1)))


def gather(rows: DataFrame, worker: str, value: str) -> DataFrame:
    """One row: the values of all workers in order."""
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(worker, value))), lambda x: x[value]).alias("gathered"))


def reduce(rows: DataFrame, values: str) -> DataFrame:
    """pos, total: the element-wise sum of arrays. Partial sums are made before the exchange."""
    return rows.select(F.posexplode(values).alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("total"))


def allreduce(rows: DataFrame, worker: str, values: str) -> DataFrame:
    """Every worker with the element-wise sum, as an array."""
    total = reduce(rows, values).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]).alias("total"))
    return rows.select(worker).distinct().join(F.broadcast(total))


def local_elapsed(rows: DataFrame, host: str, now: int) -> DataFrame:
    """rows(worker, host, time) and cumulative: milliseconds since time for what this host sent, 0 for others, whose clocks may differ."""
    return rows.withColumn("cumulative", F.when(F.col("host") == host, F.lit(now) - F.col("time")).otherwise(F.lit(0)).cast("long"))


def write_times(spark: SparkSession, times: list[float], path: str) -> None:
    """A line Time:<cumulative ms> for each round."""
    from gridloom.sources.text import write_lines

    write_lines(spark, [f"Time:{int(t)}" for t in times], path)


def benchmark(spark: SparkSession, size: int = 1000, iterations: int = 10, workers: int = 8, everywhere: bool = False) -> list[float]:
    """Cumulated milliseconds after each round of broadcast and reduce (or allreduce)."""
    payload = checkpointed(spark.range(size).agg(F.sort_array(F.collect_list("id")).alias("list")))
    out, spent = [], 0.0
    for _ in range(iterations):
        began = time.perf_counter()
        sent = broadcast(payload, spark.range(workers).withColumnRenamed("id", "worker"))
        done = allreduce(sent, "worker", "list") if everywhere else reduce(sent, "list")
        done.write.format("noop").mode("overwrite").save()
        spent += 1000 * (time.perf_counter() - began)
        out.append(spent)
    return out
