"""Whole programs, from files to files: scaling, k-means, matrix products, collectives, generators.

    python -m gridloom.programs scaling config=run.properties points=100
    python -m gridloom.programs kmeans points=p centers=c out=o dimension=2 iterations=100
"""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import collectives, matrix
from gridloom.operators import kmeans as K
from gridloom.operators import scaling as S
from gridloom.sources import generators, text
from gridloom.sources.matrix import read_matrix, write_matrix
from gridloom.types import ScalingConfig


@dataclass
class Timings:
    """Milliseconds of a run: the whole, its temperature loops, and their stress steps (loop, step, ms)."""

    total: float = 0.0
    steps: list[tuple[int, int, float]] = field(default_factory=list)

    def lines(self) -> list[str]:
        loops = [(t, sum(ms for *_, ms in own)) for t, own in groupby(self.steps, key=lambda s: s[0])]
        return [f"total {self.total:.0f}", *(f"loop {t} {ms:.0f}" for t, ms in loops), *(f"step {t} {s} {ms:.0f}" for t, s, ms in self.steps)]


@dataclass
class ScalingResult:
    points: np.ndarray
    history: list[S.Iteration]
    timings: Timings
    report: str


class _Timed(list):
    """A history that notes when each entry came."""

    def __init__(self, timings: Timings):
        super().__init__()
        self.timings, self.last = timings, time.perf_counter()

    def append(self, entry: S.Iteration) -> None:
        now = time.perf_counter()
        self.timings.steps.append((entry.t_itr, entry.stress_itr, 1000 * (now - self.last)))
        self.last = now
        super().append(entry)


def scaling(spark: SparkSession, config: ScalingConfig) -> ScalingResult:
    """Distances, weights and initial points from files; points, iterations, report and timings to output_folder.

    Distances are stored big-endian, weights as the configuration says; without a weight file all weights are 1, without initial points
    they are drawn from (-1, 1). Rows stay 16-bit integers on disk and in memory.
    """
    began, n, d = time.perf_counter(), config.points, config.dimension
    if config.generate_data:
        stored = generators.constant_blocks(spark, n, n, max(1, n // 64))
    else:
        stored = read_matrix(spark, config.distance_file, n, n)
    stats = S.stored_stats(stored)
    found, t = stats.first(), S.init_temperature(stats, d, config.alpha, config.t_min_factor).first()
    weights = read_matrix(spark, config.weight_file, n, n, "int16", "big" if config.big_endian_weights else "little") if config.weight_file else None
    rows = S.stored_rows(S.stored_zero_fix(stored, found.positive_min), weights).persist(StorageLevel.MEMORY_AND_DISK)
    if config.initial_points_file:
        first = text.read_matrix_text(spark, config.initial_points_file)
    else:
        first = generators.random_points(spark, n, d)
    x = np.array([r.x for r in first.orderBy("i").collect()])  # n by d numbers, as every task holds
    if x.shape != (n, d):
        raise ValueError(f"initial points are {x.shape}, not {(n, d)}")
    timings = Timings()
    run = S.DenseScaling(rows, n, d, _Timed(timings))
    x = run.run(x, t.t_cur, t.t_min, 1 / found.sum_of_squares, config)
    rows.unpersist()
    timings.total = 1000 * (time.perf_counter() - began)
    history = list(run.history)
    report = text.report(config, history, timings.total / 1000)
    if config.output_folder:
        out = config.output_folder.rstrip("/")
        points = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, x array<double>")
        text.write_rows(points, f"{out}/{config.points_file or 'points'}")
        text.write_iterations(spark, history, f"{out}/{config.iteration_file or 'iterations'}")
        text.write_lines(spark, report.splitlines(), f"{out}/{config.out_file or 'report'}")
        text.write_lines(spark, timings.lines(), f"{out}/timings")
    return ScalingResult(x, history, timings, report)


def kmeans(spark: SparkSession, points: str, centers: str, out: str, dimension: int, iterations: int = 10) -> float:
    """Points and centers from text files, centers to a text file; returns seconds."""
    began = time.perf_counter()
    rows = text.read_points(spark, points, dimension)
    text.write_centroids(K.kmeans(rows, text.read_centroids(spark, centers), iterations), out)
    return time.perf_counter() - began


def matrix_multiply(spark: SparkSession, a: str, rows: int, cols: int, b: np.ndarray, out: str, check: bool = False) -> float:
    """A (64-bit, big-endian) x B to text; with check, the largest difference to a product of this process."""
    product = matrix.matmul_dense(read_matrix(spark, a, rows, cols, "float64"), b)
    text.write_rows(product.select("i", F.col("data").alias("x")), out)
    if not check:
        return 0.0
    local = np.array([r.data for r in read_matrix(spark, a, rows, cols, "float64").orderBy("i").collect()]) @ b
    return float(np.abs(np.array([r.data for r in product.orderBy("i").collect()]) - local).max())


def collective(spark: SparkSession, size: int = 1000, iterations: int = 10, everywhere: bool = False, out: str = "") -> list[float]:
    times = collectives.benchmark(spark, size, iterations, everywhere=everywhere)
    if out:
        collectives.write_times(spark, times, out)
    return times


def generate(spark: SparkSession, kind: str, out: str, rows: int, cols: int = 3, seed: int = 0, centers: int = 10) -> None:
    """kind: matrix (doubles 0 to 9), shorts (symmetric 16-bit), points (text, tabs), mixture (points and centers, two decimals)."""
    if kind == "matrix":
        write_matrix(out, generators.random_doubles(rows, cols, seed), "float64")
    elif kind == "shorts":
        write_matrix(out, generators.symmetric_shorts(rows, seed))
    elif kind == "points":
        text.write_points(generators.random_points(spark, rows, cols, seed), out, "\t")
    elif kind == "mixture":
        points, first = generators.gaussian_mixture(spark, rows, centers, cols, seed=seed)
        text.write_points(points, f"{out}/points", decimals=True)
        numbered = first.orderBy("cid").select(F.concat(F.array(F.col("cid").cast("string")), F.transform("x", lambda v: F.format_string("%.2f", F.bround(v, 2)))).alias("x"))
        numbered.select(F.array_join("x", " ").alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/centers")
    else:
        raise ValueError("kind must be matrix, shorts, points or mixture")


def statistics(spark: SparkSession, distance_file: str, n: int) -> DataFrame:
    return S.stored_stats(read_matrix(spark, distance_file, n, n))


def main(arguments: list[str]) -> None:
    from gridloom.session import session

    name, given = arguments[0], dict(a.split("=", 1) for a in arguments[1:])
    spark = session(f"gridloom {name}")
    whole = {"dimension", "iterations", "size", "rows", "cols", "seed", "centers_count", "n"}
    given = {k: int(v) if k in whole else v for k, v in given.items()}
    if name == "scaling":
        lines = "\n".join(r.value for r in spark.read.text(given.pop("config")).collect())
        print(scaling(spark, ScalingConfig.read(lines, **{k: int(v) if k == "points" else v for k, v in given.items()})).report)
    elif name == "kmeans":
        print(f"{kmeans(spark, **given):.3f} s")
    elif name == "collective":
        print(collective(spark, given.get("size", 1000), given.get("iterations", 10), given.get("kind") == "allreduce", given.get("out", "")))
    elif name == "generate":
        generate(spark, **given)
    elif name == "statistics":
        print(statistics(spark, **given).first())
    else:
        raise SystemExit("programs: scaling, kmeans, collective, generate, statistics")


if __name__ == "__main__":
    main(sys.argv[1:])
