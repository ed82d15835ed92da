"""Deterministic-annealing multidimensional scaling by weighted stress majorisation.

cells(i, j, delta, w): decoded distances, negative where missing, and weights. x(i, x): the configuration.
Each operator has a relational form, made of expressions and joins. DenseScaling has the same
operators over whole matrix rows as Arrow kernels; there only the N by d configuration travels to
tasks and back to the driver, never cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.vectors import axpy, decode, distance, dot, encode, sammon
from gridloom.operators.matrix import array_sums
from gridloom.session import checkpointed
from gridloom.types import DECODE, ScalingConfig

#: Distances under NEAR give no force, temperatures up to COLD count as 0.
NEAR, COLD = 1e-10, 1e-9
#: Up to so many dimensions each one is a sum of its own.
WIDE = 32
#: The configuration of a dense run may take so many bytes in each task.
DENSE_BYTES = 256 << 20
#: Matrix rows that a kernel takes at once.
BLOCK_ROWS = 64


def weights_join(distances: DataFrame, weights: DataFrame, scale: float | None = None) -> DataFrame:
    """cells from stored 16-bit distances(i, j, v) and weights(i, j, v)."""
    w = decode(F.col("s")) if scale is None else F.col("s").cast("double") * scale
    return distances.select("i", "j", decode(F.col("v")).alias("delta")).join(weights.select("i", "j", F.col("v").alias("s")), ["i", "j"]).select("i", "j", "delta", w.alias("w"))


def simple_weights(cells: DataFrame, weights: DataFrame, transform=lambda c: c) -> DataFrame:
    """cells(i, j, delta) with the weight transform(s_i * s_j) from weights(i, s)."""
    left, right = weights.select("i", F.col("s").alias("si")), weights.select(F.col("i").alias("j"), F.col("s").alias("sj"))
    return cells.join(left, "i").join(right, "j").select("i", "j", "delta", transform(F.col("si") * F.col("sj")).alias("w"))


def sammon_weights(cells: DataFrame, average: float, factor: float = 0.001) -> DataFrame:
    return cells.withColumn("w", sammon(F.col("w"), F.col("delta"), average, factor))


def zero_fix(distances: DataFrame, positive_min: Column) -> DataFrame:
    """Stored distances(i, j, v): every one from 0 to below positive_min becomes that. Missing ones stay."""
    d = decode(F.col("v"))
    return distances.withColumn("v", F.when((d >= 0) & (d < positive_min), encode(positive_min)).otherwise(F.col("v")))


def init_temperature(stats: DataFrame, dimension: int, alpha: float, t_min_factor: float) -> DataFrame:
    """t_min, t_max, t_cur from the one row of cell_stats."""
    root = F.lit(math.sqrt(2.0 * dimension))
    t_max = F.col("high") / root
    return stats.select((F.lit(t_min_factor) * F.col("positive_min") / root).alias("t_min"), t_max.alias("t_max"), (F.lit(alpha) * t_max).alias("t_cur"))


def _gap(dimension: int, t: float) -> float:
    return math.sqrt(2.0 * dimension) * t if t > COLD else 0.0


def pair_distances(cells: DataFrame, x: DataFrame) -> DataFrame:
    """cells and d, the distance of rows i and j of the configuration (0 on the diagonal)."""
    return cells.join(x.select("i", F.col("x").alias("xi")), "i").join(x.select(F.col("i").alias("j"), F.col("x").alias("xj")), "j").withColumn("d", distance(F.col("xi"), F.col("xj"))).drop("xi", "xj")


def stress(cells: DataFrame, x: DataFrame, t: float, dimension: int, inverse: float = 1.0) -> DataFrame:
    """One row, stress: over all ordered pairs with a distance, the diagonal too."""
    gap = F.lit(_gap(dimension, t))
    off = F.when(F.col("delta") >= gap, F.col("delta") - gap - F.col("d")).otherwise(-F.col("d"))
    rows = pair_distances(cells.filter("delta >= 0"), x)
    return rows.agg((F.sum(F.col("w") * off * off) * F.lit(inverse)).alias("stress"))


def v_diagonal(cells: DataFrame) -> DataFrame:
    """i, v: 1 and the weights of the row's valid pairs. Rows without one give 1."""
    valid = (F.col("i") != F.col("j")) & (F.col("delta") >= 0) & (F.col("w") != 0)
    return cells.groupBy("i").agg((F.sum(F.when(valid, F.col("w")).otherwise(0.0)) + 1).alias("v"))


def b_of_z(cells: DataFrame, x: DataFrame, t: float, dimension: int) -> DataFrame:
    """cells of B(Z): i, j, v, with the diagonal."""
    gap = F.lit(_gap(dimension, t))
    rows = pair_distances(cells.filter("i <> j and delta >= 0 and w <> 0"), x)
    off = rows.select("i", "j", F.when((F.col("d") >= NEAR) & (gap < F.col("delta")), -F.col("w") * (F.col("delta") - gap) / F.when(F.col("d") >= NEAR, F.col("d"))).otherwise(0.0).alias("v"))
    diagonal = x.select("i").join(off.groupBy("i").agg((-F.sum("v")).alias("v")), "i", "left").select("i", F.col("i").alias("j"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return off.unionByName(diagonal)


def matrix_points(cells: DataFrame, x: DataFrame, dimension: int) -> DataFrame:
    """i, x: cells(i, j, v) times the configuration."""
    right = x.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    if dimension > WIDE:
        scaled = cells.join(right, "j").select("i", F.transform("xj", lambda c: F.col("v") * c).alias("x"))
        return array_sums(scaled, "i", "x").select("i", F.col("s").alias("x"))
    return cells.join(right, "j").groupBy("i").agg(F.array(*(F.sum(F.col("v") * F.col("xj")[k]) for k in range(dimension))).alias("x"))


def v_matvec(cells: DataFrame, v: DataFrame, p: DataFrame, dimension: int, skip_missing: bool = False) -> DataFrame:
    """i, x: v_i p_i less the weighted sum of the other rows. Missing pairs count with their weight unless skip_missing."""
    off = cells.filter("i <> j and delta >= 0" if skip_missing else "i <> j").select("i", "j", F.col("w").alias("v"))
    other = matrix_points(off, p, dimension).select("i", F.col("x").alias("o"))
    rows = v.join(p, "i").join(other, "i", "left")
    zero = F.array_repeat(F.lit(0.0), dimension)
    return rows.select("i", F.zip_with("x", F.coalesce("o", zero), lambda a, b: F.col("v") * a - b).alias("x"))


@dataclass
class Solved:
    x: DataFrame
    r_t_r: float
    iterations: int


def conjugate_gradient(cells: DataFrame, v: DataFrame, bc: DataFrame, x: DataFrame, dimension: int, iterations: int, threshold: float = 1.0, exact: bool = False) -> Solved:
    """Solves V X = BC from x. The test looks at the residual before a step, after X moved; it ends when the residual is 0."""
    vx = v_matvec(cells, v, x, dimension).select("i", F.col("x").alias("vx"))
    start = x.join(bc.select("i", F.col("x").alias("bc")), "i").join(vx, "i")
    state = checkpointed(start.select("i", "x", axpy(-1.0, F.col("vx"), F.col("bc")).alias("r")).withColumn("p", F.col("r")))
    r_t_r = state.agg(F.sum(dot(F.col("r"), F.col("r")))).collect()[0][0] or 0.0
    end, done = r_t_r * threshold, 0
    for _ in range(iterations):
        if r_t_r == 0:
            break
        vp = v_matvec(cells, v, state.select("i", F.col("p").alias("x")), dimension).select("i", F.col("x").alias("vp"))
        both = checkpointed(state.join(vp, "i"))
        p_v_p = both.agg(F.sum(dot(F.col("p"), F.col("vp")))).collect()[0][0]
        if not p_v_p:
            break
        alpha, done = r_t_r / p_v_p, done + 1
        moved = both.withColumn("x", axpy(alpha, F.col("p"), F.col("x")))
        if r_t_r < end and not exact:
            state = moved
            break
        moved = moved.withColumn("r", axpy(-alpha, F.col("vp"), F.col("r")))
        now = moved.agg(F.sum(dot(F.col("r"), F.col("r")))).collect()[0][0]
        state = checkpointed(moved.select("i", "x", "r", axpy(now / r_t_r, F.col("p"), F.col("r")).alias("p")))
        r_t_r = now
    return Solved(state.select("i", "x"), r_t_r, done)


@dataclass
class Iteration:
    """Loop state; line() is its row in an iteration file."""

    t_cur: float
    stress: float = 0.0
    stress_itr: int = 0
    t_itr: int = 0
    pre_stress: float = 0.0
    t_min: float = 0.0
    cg_count: int = 0

    def line(self) -> str:
        return f"{self.t_cur},{self.stress},{self.stress_itr},{self.t_itr},{self.pre_stress},{self.t_min},{self.cg_count}"

    @classmethod
    def parse(cls, line: str) -> Iteration:
        parts = line.strip().split(",")
        if len(parts) != 7:
            raise ValueError(f"an iteration has 7 fields, not {len(parts)}")
        t, s, si, ti, pre, low, cg = parts
        return cls(float(t), float(s), int(si), int(ti), float(pre), float(low), int(cg))


def annealed(step, stress, x, t_cur: float, t_min: float, config: ScalingConfig, history: list[Iteration]):
    """Temperature loops around stress loops. step(x, t) -> x and its inner iterations; stress(x, t); each stress step is recorded in history."""
    state = Iteration(t_cur, t_min=t_min)
    while True:
        state.pre_stress, steps = stress(x, state.t_cur), 0
        gain = config.threshold + 1
        while gain >= config.threshold or config.max_stress_loops > 0:
            x, state.cg_count = step(x, state.t_cur)
            state.stress = stress(x, state.t_cur)
            gain, steps = state.pre_stress - state.stress, steps + 1
            state.stress_itr = steps
            history.append(Iteration(**state.__dict__))
            state.pre_stress = state.stress
            if config.max_stress_loops >= 0 and steps == config.max_stress_loops:
                break
        if config.max_temp_loops >= 0 and state.t_itr == config.max_temp_loops or config.max_temp_loops < 0 and state.t_cur == 0:
            return x
        state.t_itr += 1
        state.t_cur *= config.alpha
        if state.t_cur < state.t_min:
            state.t_cur = 0.0


def anneal(cells: DataFrame, x: DataFrame, t_cur: float, t_min: float, inverse: float, config: ScalingConfig) -> tuple[DataFrame, list[Iteration]]:
    """The annealing run by the relational operators, for configurations that are too large for every task."""
    d, history = config.dimension, []
    v = checkpointed(v_diagonal(cells))

    def step(x: DataFrame, t: float) -> tuple[DataFrame, int]:
        bc = matrix_points(b_of_z(cells, x, t, d), x, d)
        found = conjugate_gradient(cells, v, bc, x, d, config.cg_iterations, config.cg_threshold, config.exact_cg)
        return checkpointed(found.x), found.iterations

    return annealed(step, lambda x, t: stress(cells, x, t, d, inverse).collect()[0][0] or 0.0, x, t_cur, t_min, config, history), history


def _distances(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """From rows i to all rows, a dimension at a time."""
    out = np.zeros((len(i), len(x)))
    for column in x.T:
        out += (column[i][:, None] - column) ** 2
    return np.sqrt(out)


@dataclass
class DenseScaling:
    """The same operators over rows(i, delta, w), all n of a matrix; delta and w are arrays of doubles, or of stored 16-bit
    integers, which are decoded batch by batch in the kernels."""

    rows: DataFrame
    n: int
    dimension: int
    history: list[Iteration] = field(default_factory=list)

    def __post_init__(self):
        if self.n * self.dimension * 8 > DENSE_BYTES:
            raise ValueError("the configuration is too large to be sent to every task; use anneal()")

    def _each(self, kernel, width: int) -> np.ndarray:
        """kernel(i, delta, w) -> rows by width, gathered in order of i; n by width numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(lo, BLOCK_ROWS)
                    i = part.column("i").to_numpy().astype(int)
                    flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("delta", "w")]
                    delta, w = ((v * DECODE if v.dtype == np.int16 else v).reshape(len(i), -1) for v in flat)
                    out = np.ascontiguousarray(kernel(i, delta, w))
                    yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(np.arange(0, out.size + 1, width, dtype=np.int32), pa.array(out.ravel()))], names=["i", "x"])

        got = self.rows.select(F.col("i").cast("long").alias("i"), "delta", "w").mapInArrow(run, T.StructType([T.StructField("i", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])).toArrow()
        i = got.column("i").to_numpy()
        if len(i) != self.n or len(np.unique(i)) != self.n:
            raise ValueError("rows are missing or twice there")
        out = np.empty((self.n, width))
        out[i] = got.column("x").combine_chunks().flatten().to_numpy().reshape(self.n, width)
        return out

    def stress(self, x: np.ndarray, t: float, inverse: float = 1.0) -> float:
        gap = _gap(self.dimension, t)

        def kernel(i, delta, w):
            d = _distances(x, i)
            off = np.where(delta >= gap, delta - gap - d, -d)
            return np.where(delta >= 0, w * off * off, 0).sum(1, keepdims=True)

        return float(self._each(kernel, 1).sum() * inverse)

    def v_diagonal(self) -> np.ndarray:
        def kernel(i, delta, w):
            valid = delta >= 0
            valid[np.arange(len(i)), i] = False
            return 1 + np.where(valid, w, 0).sum(1, keepdims=True)

        return self._each(kernel, 1)

    def bc(self, x: np.ndarray, t: float) -> np.ndarray:
        gap = _gap(self.dimension, t)

        def kernel(i, delta, w):
            d = _distances(x, i)
            force = (d >= NEAR) & (gap < delta) & (delta >= 0)
            force[np.arange(len(i)), i] = False
            b = np.where(force, -w * (delta - gap) / np.where(d >= NEAR, d, 1), 0)
            b[np.arange(len(i)), i] = -b.sum(1)
            return b @ x

        return self._each(kernel, self.dimension)

    def v_matvec(self, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        def kernel(i, delta, w):
            w = w.copy()
            w[np.arange(len(i)), i] = 0
            return v[i] * p[i] - w @ p

        return self._each(kernel, self.dimension)

    def solve(self, v: np.ndarray, bc: np.ndarray, x: np.ndarray, iterations: int, threshold: float = 1.0, exact: bool = False) -> tuple[np.ndarray, float, int]:
        r = bc - self.v_matvec(v, x)
        p, r_t_r, done = r, float((r * r).sum()), 0
        end = r_t_r * threshold
        for _ in range(iterations):
            if r_t_r == 0:
                break
            vp = self.v_matvec(v, p)
            alpha, done = r_t_r / float((p * vp).sum()), done + 1
            x = x + alpha * p
            if r_t_r < end and not exact:
                break
            r = r - alpha * vp
            now = float((r * r).sum())
            p, r_t_r = r + now / r_t_r * p, now
        return x, r_t_r, done

    def run(self, x: np.ndarray, t_cur: float, t_min: float, inverse: float, config: ScalingConfig) -> np.ndarray:
        """Temperature loops around stress loops; each stress step is recorded in history."""
        v = self.v_diagonal()

        def step(x: np.ndarray, t: float) -> tuple[np.ndarray, int]:
            x, _, done = self.solve(v, self.bc(x, t), x, config.cg_iterations, config.cg_threshold, config.exact_cg)
            return x, done

        return annealed(step, lambda x, t: self.stress(x, t, inverse), x, t_cur, t_min, config, self.history)


def stored_rows(distances: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """rows(i, delta, w) of stored rows(i, data) of 16-bit integers, still stored; without weights all are 1."""
    left = distances.select("i", F.col("data").alias("delta"))
    if weights is None:
        return left.select("i", "delta", F.transform("delta", lambda v: F.lit(32767).cast("smallint")).alias("w"))
    return left.join(weights.select("i", F.col("data").alias("w")), "i")


def stored_stats(distances: DataFrame) -> DataFrame:
    """cell_stats of stored rows(i, data): each row by itself first, so cells are never rows."""
    v = F.filter(F.transform("data", decode), lambda x: x >= 0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = distances.select(v.alias("v")).select(
        F.size("v").cast("long").alias("n"), total(F.col("v")).alias("total"), F.array_min("v").alias("low"), F.array_max("v").alias("high"),
        total(F.transform("v", lambda x: x * x)).alias("squares"), F.array_min(F.filter("v", lambda x: x > 0)).alias("positive"),
    )
    return rows.agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("squares").alias("sum_of_squares"), F.min("positive").alias("positive_min"),
    )


def stored_zero_fix(distances: DataFrame, positive_min: float) -> DataFrame:
    """zero_fix of stored rows(i, data)."""
    low = F.lit(positive_min)
    return distances.withColumn("data", F.transform("data", lambda v: F.when((decode(v) >= 0) & (decode(v) < low), encode(low)).otherwise(v)))


def dense_rows(cells: DataFrame) -> DataFrame:
    """rows(i, delta, w) from full cells."""
    made = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "delta", "w"))).alias("c"))
    return made.select("i", F.transform("c", lambda c: c["delta"]).alias("delta"), F.transform("c", lambda c: c["w"]).alias("w"))
