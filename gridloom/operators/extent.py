"""The farthest point of each point in the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectors import distance

#: So many corners are compared in each task at most.
CORNERS = 100_000


def hull(x: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane."""
    x = np.unique(x, axis=0)
    if len(x) < 3:
        return x

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(x) + half(x[::-1]))


def farthest(points: DataFrame) -> DataFrame:
    """i, farthest (distance) of points(i, x) in the plane. Only corners of the convex hull can be farthest, so no pairs are made."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2))
        for b in batches:
            kept = hull(np.concatenate([kept, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)]))
        yield pa.RecordBatch.from_arrays([pa.array(kept.tolist(), pa.list_(pa.float64()))], names=["x"])

    found = hull(np.array([r.x for r in points.select("x").mapInArrow(corners, "x array<double>").collect()]).reshape(-1, 2))
    if len(found) > CORNERS:
        raise ValueError("too many corners to be compared in each task")
    model = points.sparkSession.createDataFrame([([p.tolist() for p in found],)], "corners array<array<double>>")
    rows = points.join(F.broadcast(model))
    return rows.select("i", F.array_max(F.transform("corners", lambda c: distance(F.col("x"), c))).alias("farthest"))
