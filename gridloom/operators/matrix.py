"""Matrices as cells(i, j, v), as rows(i, data) and as row blocks; products and gathers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.vectors import decode


def row_ranges(rows: int, splits: int) -> list[tuple[int, int]]:
    """(start, count) of each split: the first rows % splits get one more."""
    q, r = divmod(rows, splits)
    return [(i * q + min(i, r), q + (i < r)) for i in range(splits)]


def rows_to_cells(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("data").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def cells_to_rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("data"))


def to_blocks(rows: DataFrame, n_rows: int, splits: int) -> DataFrame:
    """block, start, block_rows, matrix_rows, matrix_cols, data: rows joined in order, by the ranges of row_ranges."""
    q, r = divmod(n_rows, splits)
    block = F.when(F.col("i") < r * (q + 1), F.floor(F.col("i") / (q + 1))).otherwise(r + F.floor((F.col("i") - r * (q + 1)) / max(q, 1))).cast("int")
    of = rows.groupBy(block.alias("block")).agg(F.min("i").alias("start"), F.count("*").alias("block_rows"), F.sort_array(F.collect_list(F.struct("i", "data"))).alias("rows"))
    return of.select("block", "start", "block_rows", F.lit(n_rows).cast("long").alias("matrix_rows"), F.size(F.col("rows")[0]["data"]).cast("long").alias("matrix_cols"), F.flatten(F.transform("rows", lambda x: x["data"])).alias("data"))


def ordered_gather(rows: DataFrame, n_rows: int | None = None) -> DataFrame:
    """One row: all rows of a small matrix in order. Raises when rows are missing or twice there."""
    made = rows.agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("r"))
    fine = F.lit(True) if n_rows is None else (F.size("r") == n_rows) & F.forall(F.transform("r", lambda x, i: x["i"] == i), lambda ok: ok)
    return made.select(F.when(fine, F.transform("r", lambda x: x["data"])).otherwise(F.raise_error(F.lit("rows are missing or twice there")).cast("array<array<double>>")).alias("matrix"))


def array_sums(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key, s (element-wise sum of arrays) and n: a batch is summed before the exchange, so wide arrays need no wide expression."""
    kind = T.StructType([rows.schema[key], T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("m", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(values).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            code = b.column(key).dictionary_encode()
            n = len(code.dictionary)
            which = code.indices.to_numpy()
            total = np.zeros((n, x.shape[1]))
            np.add.at(total, which, x)
            count = np.bincount(which, minlength=n)
            at = np.repeat(np.arange(n), x.shape[1])
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at)), pa.array(np.tile(np.arange(x.shape[1], dtype=np.int32), n)), pa.array(total.ravel()), pa.array(count[at])], names=[key, "k", "v", "m"])

    parts = rows.filter(F.col(key).isNotNull()).select(key, values).mapInArrow(run, kind).groupBy(key, "k").agg(F.sum("v").alias("v"), F.sum("m").alias("m"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("s"), F.max("m").alias("n"))


def rounded_cells(rows: DataFrame, n: int) -> DataFrame:
    """i, j, v of stored rows(i, data): decoded distances times n * n, rounded."""
    return rows_to_cells(rows).select("i", "j", F.round(decode(F.col("v")) * F.lit(float(n) * n)).cast("long").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """cells of A x B from cells; Spark picks a broadcast of B where its size allows."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("p"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", "p").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("p").alias("j"), "v")


def from_column_major(values: list[float], rows: int) -> np.ndarray:
    """A small matrix stored column after column."""
    return np.array(values, float).reshape(-1, rows).T


def matmul_dense(rows: DataFrame, b: np.ndarray) -> DataFrame:
    """rows(i, data) of A x B, for a B small enough for every task (64 MB at most)."""
    if b.nbytes > 64 << 20:
        raise ValueError("B is too large to be sent to every task; use matmul")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = batch.column("data").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float) @ b
                flat = pa.array(out.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(b.shape[1], 1), dtype=np.int32), flat)], names=["i", "data"])

    return rows.select("i", "data").mapInArrow(run, T.StructType([rows.schema["i"], T.StructField("data", T.ArrayType(T.DoubleType()))]))


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, v: the sum over cells of a * b."""
    other = b.select("i", "j", F.col("v").alias("w"))
    return a.join(other, ["i", "j"]).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))
