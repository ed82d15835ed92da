"""Lloyd's k-means over points(id, x) and centroids(cid, x).

Centroids are a model of k rows. Up to BROADCAST_CELLS numbers they travel to every task, and the
nearest one is found without a shuffle; a larger model is cut into groups of that size, which pass over the points one after
another, so no task ever gets more. All forms agree: squared differences are summed exactly where products can't tell
centroids apart, ties go to the smallest id, and distances that aren't numbers raise. A step then needs one exchange of
partial sums. Loop state is cut by checkpoints, so a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.vectors import squared_distance
from gridloom.operators.matrix import array_sums
from gridloom.session import checkpointed

#: 64 MB of doubles in each task at most.
BROADCAST_CELLS = 8_000_000
#: Numbers of a block of distances.
BLOCK_CELLS = 4_000_000


def nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, x, cid, distance: ties go to the smallest cid, NaN distances raise. Expressions only."""
    model = centroids.filter("cid is not null").agg(F.sort_array(F.collect_list(F.struct("cid", "x"))).alias("model"))
    each = F.transform("model", lambda c: F.struct(squared_distance(F.col("x"), c["x"]).alias("d"), c["cid"].alias("cid")))
    best = points.join(F.broadcast(model)).select("id", "x", F.array_min(each).alias("best"))
    d = F.when(F.isnan("best.d"), F.raise_error(F.lit("a distance is not a number")).cast("double")).otherwise(F.sqrt("best.d"))
    return best.select("id", "x", F.col("best.cid").alias("cid"), d.alias("distance"))


def closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centre of each row, and the squared distance. Products find those that come into question."""
    norms = (centres * centres).sum(1)
    near, least = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), step := max(1, BLOCK_CELLS // len(centres))):
        part = x[lo : lo + step]
        own = (part * part).sum(1)
        d = norms - 2 * part @ centres.T
        if not np.isfinite(d).all() or not np.isfinite(own).all():
            raise ValueError("a distance is not a number")
        slack = 1e-12 * (norms.max() + own) * (part.shape[1] + 4)
        row, which = np.nonzero(d <= (d.min(1) + slack)[:, None])
        exact = ((part[row] - centres[which]) ** 2).sum(1)
        order = np.lexsort((which, exact, row))
        first = order[np.append(True, row[order][1:] != row[order][:-1])]
        near[lo : lo + step], least[lo : lo + step] = which[first], exact[first]
    return near, least


def nearest_in_batches(points: DataFrame, ids: np.ndarray, centres: np.ndarray) -> DataFrame:
    """id, x, cid and the squared distance by a dense kernel on Arrow batches; ids must ascend. The model is broadcast."""
    model = points.sparkSession.sparkContext.broadcast((ids, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = model.value
        for b in batches:
            if b.num_rows:
                near, d = closest(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), at)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(known[near]), pa.array(d)], names=["id", "x", "cid", "squared"])

    return points.select("id", "x").mapInArrow(run, T.StructType([points.schema["id"], points.schema["x"], T.StructField("cid", T.IntegerType()), T.StructField("squared", T.DoubleType())]))


def means(assigned: DataFrame, centroids: DataFrame, dimension: int, empty: str = "zero") -> DataFrame:
    """The mean of each centroid's points, and their number. An empty cluster becomes zeros, or keeps its place ('keep')."""
    sums = array_sums(assigned, "cid", "x")
    old = F.array_repeat(F.lit(0.0), dimension) if empty == "zero" else F.col("old")
    found = centroids.select("cid", F.col("x").alias("old")).join(sums, "cid", "left")
    return found.select("cid", F.coalesce(F.transform("s", lambda v: v / F.col("n")), old).alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def step(points: DataFrame, centroids: DataFrame, dimension: int, empty: str = "zero") -> DataFrame:
    return means(nearest(points, centroids), centroids, dimension, empty)


def kmeans(points: DataFrame, centroids: DataFrame, iterations: int = 10, empty: str = "zero", dense: bool = True) -> DataFrame:
    """cid, x, n after so many steps. dense: the batch kernel; else expressions, for models up to BROADCAST_CELLS numbers."""
    first = centroids.orderBy("cid").limit(1).collect()
    if not first:
        return centroids.select("cid", "x", F.lit(0).cast("long").alias("n"))
    dimension = len(first[0].x)
    state = checkpointed(centroids.select("cid", "x", F.lit(0).cast("long").alias("n")))
    points = points.select("id", "x").persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(iterations):
        near = nearest_in_groups(points, state, dimension) if dense else nearest(points, state)
        state = checkpointed(means(near, state, dimension, empty))
    points.unpersist()
    return state


def nearest_in_groups(points: DataFrame, centroids: DataFrame, dimension: int, cells: int = BROADCAST_CELLS) -> DataFrame:
    """id, x, cid, distance: groups of as many centroids as hold so many numbers, one after another over all points."""
    rows = centroids.filter("cid is not null").orderBy("cid").select("cid", "x")
    size, best = max(1, cells // max(dimension, 1)), None
    ids, at = [], []

    def passed() -> DataFrame:
        new = nearest_in_batches(points, np.array(ids, np.int32), np.array(at, float))
        if best is None:
            return new
        # Each pass keeps the nearer of two; equal distances stay with the smaller id.
        other = new.select("id", F.col("cid").alias("cid2"), F.col("squared").alias("squared2"))
        nearer = F.col("squared2") < F.col("squared")
        return checkpointed(best.join(other, "id").select("id", "x", F.when(nearer, F.col("cid2")).otherwise(F.col("cid")).alias("cid"), F.least("squared", "squared2").alias("squared")))

    for r in rows.toLocalIterator():  # a group at a time on the driver
        ids.append(r.cid)
        at.append(r.x)
        if len(ids) == size:
            best = passed()
            ids, at = [], []
    best = passed() if ids else best
    return best.select("id", "x", "cid", F.sqrt("squared").alias("distance"))
