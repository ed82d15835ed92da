"""A data source for headerless binary matrices, read in row ranges from any file system that pyarrow opens; others go through Hadoop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.operators.matrix import row_ranges

_KINDS = {("int16", "big"): ">i2", ("int16", "little"): "<i2", ("float64", "big"): ">f8", ("float64", "little"): "<f8"}


class RowRange(InputPartition):
    def __init__(self, start: int, count: int):
        self.start, self.count = start, count


def _open(path: str):
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows, self.cols = options["path"], int(options["rows"]), int(options["cols"])
        kind = (options.get("dtype", "int16"), options.get("endian", "big"))
        if kind not in _KINDS:
            raise ValueError(f"dtype and endian must be among {sorted(_KINDS)}")
        self.kind = _KINDS[kind]
        self.splits = int(options.get("splits", 0)) or max(1, -(-self.rows * self.cols * np.dtype(self.kind).itemsize // (64 << 20)))

    def partitions(self):
        return [RowRange(a, n) for a, n in row_ranges(self.rows, self.splits) if n] or [RowRange(0, 0)]

    def read(self, partition):
        size = np.dtype(self.kind).itemsize * self.cols
        step = max(1, (8 << 20) // max(size, 1))
        with _open(self.path) as file:
            for a in range(partition.start, partition.start + partition.count, step):
                n = min(step, partition.start + partition.count - a)
                file.seek(a * size)
                raw = file.read(n * size)
                if len(raw) != n * size:
                    raise ValueError(f"{self.path} ends before row {a + n}")
                data = np.frombuffer(raw, self.kind).astype(self.kind[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(np.arange(0, n * self.cols + 1, max(self.cols, 1), dtype=np.int32), pa.array(data))], names=["i", "data"])


class BinaryMatrix(DataSource):
    """Options: path, rows, cols; dtype int16 or float64; endian big or little; splits. One row (i, data) for each matrix row."""

    @classmethod
    def name(cls):
        return "binarymatrix"

    def schema(self):
        return f"i long, data array<{'smallint' if self.options.get('dtype', 'int16') == 'int16' else 'double'}>"

    def reader(self, schema):
        return _Reader(self.options)


#: Schemes that pyarrow opens.
_DIRECT = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _through_hadoop(spark: SparkSession, path: str, rows: int, cols: int, dtype: str, endian: str) -> DataFrame:
    """Rows as records of fixed length, numbered by their place: for file systems that only Hadoop knows."""
    kind = np.dtype(_KINDS[dtype, endian])
    form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{form}.recordLength": str(kind.itemsize * cols)})
    raw = spark.createDataFrame(records.map(lambda r: (r[0], bytes(r[1]))), "i long, content binary").filter(F.col("i") < rows)

    def run(batches):
        for b in batches:
            data = np.frombuffer(b"".join(v.as_py()[: kind.itemsize * cols] for v in b.column("content")), kind).astype(kind.newbyteorder("="))
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.ListArray.from_arrays(np.arange(0, b.num_rows * cols + 1, max(cols, 1), dtype=np.int32), pa.array(data))], names=["i", "data"])

    return raw.mapInArrow(run, f"i long, data array<{'smallint' if dtype == 'int16' else 'double'}>")


def read_matrix(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "int16", endian: str = "big", splits: int = 0, hadoop: bool | None = None) -> DataFrame:
    """rows(i, data). hadoop: whether the file is read through Hadoop; by its scheme if None."""
    if hadoop or hadoop is None and "://" in path and path.partition("://")[0] not in _DIRECT:
        return _through_hadoop(spark, path, rows, cols, dtype, endian)
    spark.dataSource.register(BinaryMatrix)
    return spark.read.format("binarymatrix").options(path=path, rows=rows, cols=cols, dtype=dtype, endian=endian, splits=splits).load()


def decode_shorts(content: Column, count: Column, endian: str = "big") -> Column:
    """array<smallint> of a binary column, by expressions only; for small files."""

    def one(i: Column) -> Column:
        a, b = F.substring(content, 2 * i + 1, F.lit(1)), F.substring(content, 2 * i + 2, F.lit(1))
        two = F.concat(a, b) if endian == "big" else F.concat(b, a)
        v = F.conv(F.hex(two), 16, 10).cast("int")
        return F.when(v > 32767, v - 65536).otherwise(v).cast("smallint")

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.expr("cast(array() as array<smallint>)"))


def write_matrix(path: str, values: np.ndarray, dtype: str = "int16", endian: str = "big") -> None:
    """A headerless file, written by the driver; for inputs that fit there."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(inner) as file:
        file.write(np.asarray(values).astype(_KINDS[dtype, endian]).tobytes())


def read_cells(
    spark: SparkSession, distance_file: str, n: int, weight_file: str | None = None, weights: str = "none", endian: str = "big", weight_endian: str = "big",
    transform=None, weight_transform=None, sammon: float | None = None, repetitions: int = 1, splits: int = 0,
) -> DataFrame:
    """cells(i, j, delta, w) of a distance file and its weights: none (all 1), matrix (a file like the distances) or simple (a text
    file of one number a point, w = s_i * s_j). transform changes decoded distances that aren't missing, weight_transform weights;
    sammon is the average distance for Sammon weights; repetitions repeats all cells (column repetition)."""
    from gridloom.functions.vectors import decode
    from gridloom.operators import matrix, scaling

    cells = matrix.rows_to_cells(read_matrix(spark, distance_file, n, n, "int16", endian, splits)).select("i", "j", decode(F.col("v")).alias("delta"))
    if transform:
        cells = cells.withColumn("delta", F.when(F.col("delta") >= 0, transform(F.col("delta"))).otherwise(F.col("delta")))
    change = weight_transform or (lambda c: c)
    if weights == "none":
        cells = cells.withColumn("w", F.lit(1.0))
    elif weights == "simple":
        from gridloom.sources.text import read_matrix_text

        cells = scaling.simple_weights(cells, read_matrix_text(spark, weight_file).select("i", F.col("x")[0].alias("s")), change)
    elif weights == "matrix":
        other = matrix.rows_to_cells(read_matrix(spark, weight_file, n, n, "int16", weight_endian, splits)).select("i", "j", change(decode(F.col("v"))).alias("w"))
        cells = cells.join(other, ["i", "j"])
    else:
        raise ValueError("weights must be none, simple or matrix")
    cells = scaling.sammon_weights(cells, sammon) if sammon is not None else cells
    return cells if repetitions == 1 else cells.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
