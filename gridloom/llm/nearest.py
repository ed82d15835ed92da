"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample: a quarter of the vectors, ``least`` of them at least and ``most`` at most, so it has
more leaves as the table grows; every vector is then indexed under its leaf. A query
goes through the tree best bin first: a priority queue holds branches by their distance, and leaves are
visited in the order in which they leave the queue. How many leaves are visited is calibrated: it is
widened on sampled queries until the recall against brute force over the sample reaches the target, and for
each query until the visited leaves hold k neighbours, or all there are.

Neighbouring leaves share a bucket of at least a BUCKETS-th of all vectors and at most ``part``; a larger leaf, one
that holds a third of all vectors, is cut into several. So a query travels to few buckets, with the numbers of the leaves that it
visits there. A bucket compares the queries of each leaf with its vectors in blocks: products bound the distances, and
those within rounding of the k-th are computed again, exactly. It returns each query's k best, and those meet in one aggregation.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part;
ids that are null take no part; ties go to the smaller id; repeated ids are separate rows, but a query never finds its own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import trimmed


#: Buckets of a table that fits them, and queries that a bucket takes at once.
BUCKETS, QUERIES = 32, 2000


@dataclass(frozen=True)
class Tree:
    """Inner nodes have children; leaves have a number instead."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int
    visit: int

    def order(self, q: np.ndarray, most: int, held: np.ndarray | None = None, wanted: int = 0) -> list[int]:
        """The first leaves that a best-bin-first search visits: ``most``, and on until they hold ``wanted`` vectors (held: those of each leaf)."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < wanted):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                seen += int(held[out[-1]]) if held is not None else 0
                continue
            kids = self.children[node]
            d = ((self.centres[kids] - q) ** 2).sum(1)
            for kid, far in zip(kids, d.tolist(), strict=True):
                heapq.heappush(queue, (far, kid))
        return out

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descending to the nearest child."""
        out = np.full(len(x), -1)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centres[kids]
            near = ((c * c).sum(1) - 2 * (x[rows] @ c.T)).argmin(1)
            todo += [(int(kids[i]), rows[near == i]) for i in np.unique(near)]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        for i in range(k):
            if (own := near == i).any():
                c[i] = x[own].mean(0)
    return c, ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def grow(x: np.ndarray, branch: int, size: int) -> Tree:
    """Splits nodes of more than ``size`` sample vectors into ``branch`` clusters."""
    rng = np.random.default_rng(7)
    centres, children, leaf, todo, leaves = [x.mean(0)], [[]], [-1], [(0, x)], 0
    while todo:
        node, own = todo.pop()
        parts = []
        if len(own) > size:
            c, near = _kmeans(own, min(branch, len(own)), rng)
            parts = [(c[i], own[near == i]) for i in range(len(c)) if (near == i).any()]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for centre, rows in parts:
            children[node].append(len(centres))
            todo.append((len(centres), rows))
            centres.append(centre)
            children.append([])
            leaf.append(-1)
    return Tree(np.stack(centres), children, leaf, leaves, leaves)


def calibrate(tree: Tree, x: np.ndarray, k: int, target: float, probes: int = 200) -> Tree:
    """The fewest leaves to visit, as a share of all, with which sampled queries reach the target recall."""
    of = tree.of(x)
    queries = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)
    needed = []
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        rank = np.empty(tree.leaves, int)
        visited = tree.order(x[q], tree.leaves)
        rank[visited] = np.arange(len(visited))
        needed.append(rank[of[np.argsort(d, kind="stable")[: min(k, len(x) - 1)]]])
    ranks = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    visit = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else tree.leaves
    return Tree(tree.centres, tree.children, tree.leaf, tree.leaves, min(visit, tree.leaves))


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and x (doubles) of the vectors that take part."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_column).alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.filter(F.size("x") == (usual[0].n if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def buckets(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bucket of each leaf, and in how many it is cut: neighbours share one up to ``size``."""
    first, parts = np.zeros(len(held), np.int64), np.maximum(1, -(-held // size))
    bucket, filled = 0, 0
    for leaf, n in enumerate(held.tolist()):
        if filled and (filled + n > size or parts[leaf] > 1):
            bucket, filled = bucket + 1, 0
        first[leaf], filled = bucket, filled + n
        if parts[leaf] > 1:
            bucket, filled = bucket + int(parts[leaf]), 0
    return first, parts


def closest(y: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query numbers, rows of y and distances of each query's k nearest (ties: smaller id) but those of its own id, in blocks of queries."""
    size = (y * y).sum(1)
    for a in range(0, len(queries), step := max(1, 2_000_000 // max(len(y), 1))):
        v = queries[a : a + step]
        d = size[None] - 2 * (v @ y.T) + (v * v).sum(1)[:, None]
        d[own[a : a + step, None] == ids[None]] = np.inf
        last = np.partition(d, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        slack = 1e-9 * (size.max() + (v * v).sum(1))
        q, row = np.nonzero((d <= (last + slack)[:, None]) & np.isfinite(d))
        exact = np.sqrt(((y[row] - v[q]) ** 2).sum(1))
        order = np.lexsort((ids[row], exact, q))
        q, row, exact = q[order], row[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        yield q[rank < k] + a, row[rank < k], exact[rank < k]


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", least: int = 12_000, most: int = 100_000, branch: int = 12, leaf_size: int = 60, target: float = 0.965, part: int = 100_000) -> DataFrame:
    """query_id, rank, the neighbour's id and Euclidean distance, for the rows that is_query (over ``id``) picks."""
    rows = usable(vectors, id_column, column)
    spark = rows.sparkSession
    n = rows.count()
    out = T.StructType([T.StructField("query_id", rows.schema["id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_column, rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], out)
    sample = min(most, max(least, n // 4))
    hashed = F.pmod(F.xxhash64(F.col("id").cast("string"), "x", F.lit("tree")), F.lit(1_000_000))
    some = rows.filter(hashed < int(1_000_000 * min(1.0, sample / n)) + 1).dropDuplicates(["id", "x"]).toArrow()  # about ``sample`` rows
    x = matrix(some.column("x"))
    x = x[np.lexsort(x.T[::-1])] if some.num_rows else np.array([r.x for r in rows.limit(1).collect()])
    other = np.arange(len(x)) % 3 == 0 if len(x) > 3 * leaf_size else np.ones(len(x), bool)
    tree = calibrate(grow(x[~other] if not other.all() else x, branch, leaf_size), x[other], k, target)  # on vectors that it wasn't grown from

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(tree.of(matrix(b.column("x"))), pa.int32())], names=["id", "x", "leaf"])

    kind = T.StructType([rows.schema["id"], rows.schema["x"], T.StructField("leaf", T.IntegerType())])
    members = rows.mapInArrow(trimmed(leaves), kind)
    held = np.zeros(tree.leaves, np.int64)
    for r in members.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # a row a leaf of the bounded tree
        held[r.leaf] = r.n
    copies = rows.filter(is_query).groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0
    first, parts = buckets(held, min(part, max(1, -(-n // BUCKETS))))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, where, leaves_of = [], [], []
                for i, q in enumerate(matrix(b.column("x"))):
                    own = np.array(tree.order(q, tree.visit, held, k + copies))
                    for bucket in np.unique(first[own[held[own] > 0]]).tolist():
                        some = own[(first[own] == bucket) & (held[own] > 0)]
                        for more in range(int(parts[some[0]])):
                            at.append(i)
                            where.append(bucket + more)
                            leaves_of.append(some.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), b.column("x").take(pa.array(at, pa.int64())), pa.array(where, pa.int32()), pa.array(leaves_of, pa.list_(pa.int32()))], names=["id", "x", "bucket", "leaves"])

    number = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("leaf"))
    members = members.withColumn("bucket", (number(first) + F.pmod(F.xxhash64("id"), number(parts))).cast("int"))
    asked = rows.filter(is_query).dropDuplicates(["id", "x"]).mapInArrow(trimmed(visits), T.StructType([*kind[:2], T.StructField("bucket", T.IntegerType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))]))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        right = right.sort_values("leaf", kind="stable")
        y, ids, leaf = np.stack(right["x"].to_numpy()), right["id"].to_numpy(), right["leaf"].to_numpy()
        found = []
        for a in range(0, len(left), QUERIES):
            some = left.iloc[a : a + QUERIES]
            asks, v = some["id"].to_numpy(), np.stack(some["x"].to_numpy())
            which = np.repeat(np.arange(len(some)), [len(x) for x in some["leaves"]])
            wanted = np.concatenate(some["leaves"].to_numpy())
            hits = []
            for one in np.unique(leaf):
                lo, hi = np.searchsorted(leaf, (one, one + 1))
                sent = which[wanted == one]
                hits += [(sent[q], ids[lo:hi][row], d) for q, row, d in closest(y[lo:hi], ids[lo:hi], v[sent], asks[sent], k)]
            q, near, d = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, int), ids[:0], np.zeros(0))
            order = np.lexsort((near, d, q))
            q, near, d = q[order], near[order], d[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append(pd.DataFrame({"query_id": asks[q[top]], "id": near[top], "score": d[top]}))
        return pd.concat(found)

    scheme = T.StructType([T.StructField("query_id", rows.schema["id"].dataType), rows.schema["id"], T.StructField("score", T.DoubleType())])
    found = asked.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInPandas(best, scheme)
    # At most k rows from each visited bucket meet here.
    top = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k).alias("top"))
    flat = top.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_column), F.col("hit.score").alias("score"))
