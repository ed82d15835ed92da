"""Points, centroids, matrices, logs and iteration states as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import format_doubles, parse_doubles
from gridloom.operators.scaling import Iteration
from gridloom.types import ScalingConfig


def parse_points(lines: DataFrame, dimension: int) -> DataFrame:
    """x of lines(value, ...) of numbers between single spaces. Blank lines are skipped, another number of numbers raises."""
    rows = lines.filter(F.length(F.trim("value")) > 0).withColumn("x", parse_doubles(F.col("value"), " "))
    wrong = F.raise_error(F.lit("invalid points present")).cast("array<double>")
    return rows.withColumn("x", F.when(F.size("x") == dimension, F.col("x")).otherwise(wrong)).drop("value")


def read_points(spark: SparkSession, path: str, dimension: int, line_separator: str | None = None) -> DataFrame:
    """id (unique, not dense) and x."""
    reader = spark.read if line_separator is None else spark.read.option("lineSep", line_separator)
    return parse_points(reader.text(path), dimension).select(F.monotonically_increasing_id().alias("id"), "x")


def parse_centroids(lines: DataFrame) -> DataFrame:
    """cid, x of lines whose first number is an id."""
    parts = lines.filter(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), " ").alias("p"))
    return parts.select(F.col("p")[0].cast("int").alias("cid"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda t: t.cast("double")).alias("x"))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return parse_centroids(spark.read.text(path))


def read_matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """i, x of a small file of numbers between white space, in file order; empty lines are skipped. One task reads a file."""
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("f"), F.posexplode(F.split("value", "\r?\n")).alias("k", "value")).filter(F.length("value") > 0)
    number = F.row_number().over(Window.partitionBy("f").orderBy("k")) - 1
    return lines.select(number.cast("long").alias("i"), parse_doubles(F.col("value")).alias("x"))


def write_centroids(centroids: DataFrame, path: str) -> None:
    """Lines of id and coordinates, each followed by a space."""
    centroids.select(F.concat(F.col("cid").cast("string"), F.lit(" "), format_doubles(F.col("x")), F.lit(" ")).alias("value")).write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Matrix rows in order of i, in one file; rows(i, x or data) of a small matrix."""
    column = "x" if "x" in rows.columns else "data"
    rows.orderBy("i").coalesce(1).select(format_doubles(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def read_timing_log(spark: SparkSession, path: str, column: int = 3, merged: bool = False) -> DataFrame:
    """file, value of logs between spaces, quoted by |. merged: of each folder below path only the file merged_<folder>."""
    reader = spark.read.option("sep", " ").option("quote", "|")
    if not merged:
        return reader.option("recursiveFileLookup", "true").csv(path).select(F.input_file_name().alias("file"), F.col(f"_c{column}").cast("double").alias("value"))
    rows = reader.csv(f"{path.rstrip('/')}/*/merged_*").select(F.input_file_name().alias("file"), F.col(f"_c{column}").cast("double").alias("value"))
    parts = F.split("file", "/")
    return rows.filter(F.element_at(parts, -1) == F.concat(F.lit("merged_"), F.element_at(parts, -2)))


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """One file of lines in order, through Spark's own file systems."""
    spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k int, value string").orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str, separator: str = " ", decimals: bool = False) -> None:
    """Lines of coordinates; decimals: two of them, halves to even."""
    value = F.transform("x", lambda v: (F.format_string("%.2f", F.bround(v, 2)) if decimals else v.cast("string")))
    points.select(F.array_join(value, separator).alias("value")).write.mode("overwrite").text(path)


def write_iterations(spark: SparkSession, history: list[Iteration], path: str) -> None:
    write_lines(spark, [h.line() for h in history], path)


def read_iteration(spark: SparkSession, path: str) -> Iteration:
    """The first line's state."""
    return Iteration.parse(spark.read.text(path).limit(1).collect()[0][0])


def report(config: ScalingConfig, history: list[Iteration], seconds: float) -> str:
    """The final report: settings, then loops, stress and time."""
    lines = [f"{k}: {v}" for k, v in config.__dict__.items()]
    loops = len({h.t_itr for h in history})
    lines += [f"temperature loops: {loops}", f"stress steps: {len(history)}", f"mean CG iterations: {sum(h.cg_count for h in history) / max(len(history), 1):.3f}"]
    return "\r\n".join([*lines, f"final stress: {history[-1].stress if history else float('nan')}", f"seconds: {seconds:.3f}", ""])
