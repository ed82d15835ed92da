"""Exact Jaccard join of documents on word shingles, by vertical partitioning.

Sets of distinct 5-word shingles are kept in one global order: shingles in few documents first, told by a
counting sketch of fixed size over all documents, then by hash. Documents with the same set form one class, and
only classes are joined. A pair with Jaccard similarity of 0.75 or more shares a shingle in the first
quarter of either set, which gives the candidates; the order is cut into fragments, the overlap of each
candidate pair is counted in each fragment separately, and the partial counts are summed per pair.

Pairs are never all emitted within a group. First each class is only paired with one class of each of its
buckets, in ROUNDS rounds. What is linked then forms components, and only classes that share a bucket but are not yet in one component are
paired in the last round, so that no link between different components is lost. Every link lies inside one component,
so then the overlaps of all classes of each component are counted, in blocks: no link inside one is lost either.

Rows get a key of their own first (docs are written once with it), and everything below goes by that key.

Defined results: null text is empty; empty sets link with nothing; rows that share a doc_id, or have none, are separate
members, and links through them count like any other; a component's id is the least doc_id that is not null (null
if there is none). keep_one keeps of each component the row with that id, of several the first read; rows with
empty sets all stay.
Sets are told apart by 64-bit hashes of their shingles (expected collisions: n * n / 2**65 for n classes).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import Scratch, chain, chunks, mix, of_rows, strings, trimmed, unused, words

WORDS = 5
BITS = 22
PIECE = 1 << 18
FRAGMENTS = 4
BLOCKS, GROUP, SIDE = 32, 1000, 10_000
ROUNDS, LEADERS = 2, 16
#: A part of a component holds about so many shingles at most; a component of more than SMALL classes has CUT parts at least, as
#: far as they hold SMALL classes each.
PART, SMALL, CUT = 1 << 19, 200, 6
#: A task remembers so many sets; beyond that some are counted or sent twice, which changes no result.
REMEMBERED = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    s, _, h = words(data, offsets)
    count = np.bincount(of_rows(offsets, s), minlength=len(offsets) - 1)
    at = np.concatenate([[0], np.cumsum(count)])
    all_of = chain(h, WORDS)
    for a, n in zip(at[:-1].tolist(), count.tolist(), strict=True):
        if n >= WORDS:
            v = np.sort(all_of[a : a + n - WORDS + 1])
            yield v[np.concatenate([[True], v[1:] != v[:-1]])]
        else:
            yield chain(h[a : a + n], n) if n else h[:0]


def key_of(v: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    a = int(np.add.reduce(mix(v ^ np.uint64(0x5851F42D4C957F2D)))) if len(v) else 0
    b = int(np.add.reduce(mix(v ^ np.uint64(0x14057B7EF767814F)))) if len(v) else 0
    return int(mix(np.array([a], np.uint64) ^ mix(np.array([b + len(v)], np.uint64)))[0].view(np.int64))


def prefix_size(n):
    return n - (3 * n + 3) // 4 + 1


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (piece is null), then this task's share of the sketch (doc columns are null)."""
    names = ["row", "doc_id", "n", "c", "piece", "task", "counts"]
    sketch = np.zeros(1 << BITS, np.uint32)
    seen: set[int] = set()
    kind = pa.int64()
    for batch in batches:
        kind = batch.column("doc_id").type
        data, offsets = strings(batch.column("text"))
        ns, keys = [], []
        for _, _, part, at in chunks(data, offsets):
            fresh = []
            for v in shingle_sets(part, at):
                ns.append(len(v))
                keys.append(key_of(v))
                if len(v) and keys[-1] not in seen:
                    fresh.append(v)
                    seen.add(keys[-1])
            if len(seen) > REMEMBERED:
                seen.clear()
            if fresh:
                place, n = np.unique(np.concatenate(fresh) >> np.uint64(64 - BITS), return_counts=True)
                sketch[place.astype(np.int64)] += n.astype(np.uint32)
        none = pa.nulls(batch.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(ns, pa.int32()), pa.array(keys, pa.int64()), none, none, pa.nulls(batch.num_rows, pa.binary())], names=names)
    task = TaskContext.get().partitionId()
    for i in range(0, 1 << BITS, PIECE):
        if (part := sketch[i : i + PIECE]).any():
            counts = zlib.compress(np.minimum(part, 65535).astype(np.uint16).tobytes() if part.max() < 65535 else b"L" + part.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([i // PIECE], pa.int32()), pa.array([task], pa.int32()), pa.array([counts])], names=names)


def _unpacked(counts: bytes) -> np.ndarray:
    raw = zlib.decompress(counts)
    return np.frombuffer(raw[1:], np.uint32) if len(raw) % 2 else np.frombuffer(raw, np.uint16)


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PIECE, np.uint64)
    for c in part["counts"]:
        total += _unpacked(c)
    return pd.DataFrame({"piece": part["piece"].iloc[:1], "counts": [zlib.compress(b"L" + np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def _levels(shares: DataFrame) -> np.ndarray:
    """How frequent the shingles of each counter are, in powers of two above chance: 2**BITS bytes at any size of the input."""
    tasks = shares.select("task").distinct().count()
    salt = F.pmod(F.xxhash64("task"), F.lit(max(1, int(tasks**0.5))))
    first = shares.withColumn("salt", salt).groupBy("piece", "salt").applyInPandas(_summed, "piece int, counts binary")
    total = np.zeros(1 << BITS, np.uint32)
    for r in first.groupBy("piece").applyInPandas(_summed, "piece int, counts binary").toLocalIterator():
        total[r.piece * PIECE : (r.piece + 1) * PIECE] = _unpacked(bytes(r.counts))
    mean = float(total.mean())
    out = np.zeros(1 << BITS, np.uint8)
    for i in range(0, 1 << BITS, PIECE):
        over = total[i : i + PIECE] / (mean + 4 * mean**0.5 + 4)
        out[i : i + PIECE] = np.where(over < 1, 0, 1 + np.log2(np.maximum(over, 1)))
    return out


def _prefixes(levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[int] = set()
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for _, _, part, at in chunks(data, offsets):
                hs, cs, ns, at_ = [], [], [], []
                for v in shingle_sets(part, at):
                    if not len(v) or (c := key_of(v)) in seen:
                        continue
                    seen.add(c)
                    p = prefix_size(len(v))
                    rank = level[(v >> np.uint64(64 - BITS)).astype(np.int64)]
                    v = v[np.argsort(rank, kind="stable")[:p]] if rank.any() else v[:p]
                    hs.append(v)
                    cs.append(np.full(p, c, np.int64))
                    ns.append(np.full(p, len(rank), np.int32))
                    at_.append(np.arange(p, dtype=np.int32))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (cs, ns, at_))], names=["h", "c", "n", "pos"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c and its shingles, in order."""
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        wanted = batch.column("c").to_pylist()
        for lo, _, part, at in chunks(data, offsets):
            out = [(wanted[lo + i], v.tobytes()) for i, v in enumerate(shingle_sets(part, at)) if wanted[lo + i] == key_of(v)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=pa.schema([("c", pa.int64()), ("set", pa.binary())]))


def overlap(p: list[np.ndarray], q: list[np.ndarray], least: int) -> int:
    """The partial overlaps of the fragments, summed; -1 as soon as those that are left can't make it ``least``."""
    total, rest_p, rest_q = 0, sum(map(len, p)), sum(map(len, q))
    for x, y in zip(p, q, strict=True):
        rest_p, rest_q = rest_p - len(x), rest_q - len(y)
        if len(x) and len(y):
            total += int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        if total + min(rest_p, rest_q) < least:
            return -1
    return total


def _linked(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    pivots = np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(64 - FRAGMENTS.bit_length() + 1)
    of = {}
    for c, raw in zip(sets["c"], sets["set"], strict=True):
        v = np.frombuffer(raw, np.uint64)
        of[c] = np.split(v, np.searchsorted(v, pivots))
    found = []
    for a, b, na, nb in zip(pairs["a"], pairs["b"], pairs["na"], pairs["nb"], strict=True):
        if a in of and b in of and (n := overlap(of[a], of[b], -(-3 * (int(na) + int(nb)) // 7))) >= 0:
            found.append((a, b, n))
    return pd.DataFrame(found, columns=["a", "b", "overlap"]).astype("int64")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """c, comp (the least c that it is linked to, directly or not) of the classes that have links."""
    edges = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "c"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels, edges["b"] == labels["c"]).groupBy("a").agg(F.min("comp").alias("low"))
        lower = labels.join(near, labels["c"] == near["a"]).select("c", "comp", F.least("comp", "low").alias("low"))
        of = labels.select(F.col("c").alias("low"), F.col("comp").alias("lower"))
        moved = lower.join(of, "low", "left").select("c", F.least("low", F.coalesce("lower", "low")).alias("new"), F.col("comp").alias("old"))
        kept = scratch.keep(moved.select("c", F.col("new").alias("comp"), (F.col("new") != F.col("old")).alias("changed")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = kept.select("c", "comp")
        if not kept.filter("changed").limit(1).count():
            scratch.drop(f"{name}-edges")
            return labels


def _possible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) whose sizes and prefixes leave 0.75 within reach.

    The prefixes are the first fragment of the order: beyond what they share, no more can overlap than what follows one of them.
    """
    rest = F.greatest(*(F.floor((3 * F.col(n) + 3) / 4) - 1 for n in ("na", "nb")))
    pairs = pairs.filter("4 * least(na, nb) >= 3 * greatest(na, nb)")
    both = pairs.join(heads.select(F.col("c").alias("a"), F.col("head").alias("ha")), "a").join(heads.select(F.col("c").alias("b"), F.col("head").alias("hb")), "b")
    found = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("shared"))
    return found.filter(7 * (F.col("shared") + rest) >= 3 * (F.col("na") + F.col("nb"))).drop("shared")


def _overlaps(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A class of part i, the classes of part j that it links with, and the overlaps; each pair of classes once."""
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    x, y = (part[part["q"] == q].drop_duplicates("c").sort_values("c") for q in (i, j))
    if not len(x) or not len(y):
        return
    ids, of = y["c"].to_numpy(), [np.frombuffer(raw, np.uint64) for raw in y["set"]]
    sizes = np.array([len(v) for v in of])
    flat = np.concatenate(of)
    order = np.argsort(flat, kind="stable")
    who = np.repeat(np.arange(len(of)), sizes)[order]
    keys, start = np.unique(flat[order], return_index=True)
    end = np.append(start[1:], len(flat))
    for c, raw in zip(x["c"], x["set"], strict=True):
        v = np.frombuffer(raw, np.uint64)
        place = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
        place = place[keys[place] == v]
        count = end[place] - start[place]
        at = np.repeat(start[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(who[at], minlength=len(of))
        good = (7 * both >= 3 * (sizes + len(v))) & ((ids > c) if i == j else True)
        yield c, ids[good], both[good]


def _links_of(part: pd.DataFrame) -> pd.DataFrame:
    found = [(min(c, d), max(c, d), n) for c, ids, both in _overlaps(part) for d, n in zip(ids.tolist(), both.tolist(), strict=True)]
    return pd.DataFrame(found, columns=["a", "b", "overlap"]).astype("int64")


def _counts_of(part: pd.DataFrame) -> pd.DataFrame:
    n: Counter[int] = Counter()
    for c, ids, _ in _overlaps(part):
        n[c] += len(ids)
        n.update(ids.tolist())
    return pd.DataFrame({"c": list(n), "n": list(n.values())}).astype("int64")


def _parts(texts: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets of the components of three classes or more, dealt out to all pairs (i, j) of the component's parts.

    Small components are one part and share groups; larger ones are cut into parts of SMALL to GROUP classes, PART shingles at most.
    """
    placed = labels.join(classes.select("c", "n"), "c")
    sizes = placed.groupBy("comp").agg(F.count("*").alias("k"), F.sum("n").alias("s")).filter("k > 2")
    total = sizes.agg(F.sum("k").alias("k"), F.sum("s").alias("s")).first()
    groups = max(BLOCKS, (total.k or 0) // GROUP, (total.s or 0) // PART)
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("k") / F.least(F.lit(GROUP), F.greatest(F.lit(SMALL), F.col("k") / CUT)), F.col("s") / PART)).cast("int").alias("parts"))
    g = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("comp"), F.lit(groups))).otherwise(F.col("comp"))
    dealt = placed.join(sizes, "comp").select("c", g.alias("g"), "parts", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("q"))
    sets = texts.join(classes.join(dealt.select("c"), "c"), "row").select("c", "text").mapInArrow(trimmed(_sets), "c long, set binary")
    sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("r")).join(sets, "c")
    return sent.select("g", F.least("q", "r").alias("i"), F.greatest("q", "r").alias("j"), "q", "c", "set")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """Members (row, doc_id, n_shingles, c: its class), all links between classes (a, b, overlap), and where they are kept."""
    _, texts, members, classes, links, scratch = _tree(docs)
    labels = components(links, scratch, "final")
    few = labels.groupBy("comp").agg(F.count("*").alias("k")).filter("k <= 2")
    pairs = links.join(labels.join(few, "comp").select(F.col("c").alias("a")), "a").select("a", "b", "overlap")
    whole = _parts(texts, classes, labels).groupBy("g", "i", "j").applyInPandas(_links_of, "a long, b long, overlap long")
    return members, pairs.unionByName(whole), scratch


def _n_links(texts: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """c and n_links of the classes that have links; the links themselves aren't written."""
    few = labels.groupBy("comp").agg(F.count("*").alias("k")).filter("k = 2")
    counts = _parts(texts, classes, labels).groupBy("g", "i", "j").applyInPandas(_counts_of, "c long, n long")
    return counts.unionByName(labels.join(few, "comp").select("c", F.lit(1).cast("long").alias("n"))).groupBy("c").agg(F.sum("n").alias("n_links"))


def _tree(docs: DataFrame) -> tuple[tuple[DataFrame, str], DataFrame, DataFrame, DataFrame, DataFrame, Scratch]:
    """Rows and the name of their key, texts, members, classes, enough links between classes to tell the components, and where they are kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    key = unused(docs.columns, "row_key")
    rows = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows", "zstd")
    texts = rows.select(F.col(key).alias("row"), "doc_id", "text")
    kind = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n", T.IntegerType()), ("c", T.LongType()), ("piece", T.IntegerType()), ("task", T.IntegerType()), ("counts", T.BinaryType())))])
    first = scratch.keep(texts.mapInArrow(trimmed(_members), kind), "first")
    members = first.filter("n is not null").select("row", "doc_id", F.col("n").alias("n_shingles"), "c")
    levels = spark.sparkContext.broadcast(_levels(first.filter("piece is not null").select("piece", "task", "counts")))

    # Postings of the prefixes. Which shingles several classes have is told by partial aggregates, and
    # the rest by joins, so that no bucket has to meet in one task.
    posts = texts.select("text").mapInArrow(trimmed(_prefixes(levels)), "h long, c long, n int, pos int")
    buckets = posts.groupBy("h").agg(F.min(F.struct("c", "n")).alias("least"), F.max("c").alias("most")).filter("least.c <> most")
    buckets = scratch.keep(buckets.select("h", F.col("least.c").alias("least_c"), F.col("least.n").alias("least_n")), "buckets")
    shared = scratch.keep(posts.join(buckets, "h"), "shared")
    scratch.drop("buckets")

    # First rounds: each class with one class of each of its buckets, another one each time. They are
    # linear in the postings, and put most of what is linked into one component.
    classes = scratch.keep(members.filter("n_shingles > 0").groupBy("c").agg(F.min("row").alias("row"), F.min("n_shingles").alias("n")), "classes")
    heads = scratch.keep(shared.groupBy("c").agg(F.collect_list("h").alias("head")), "heads")  # each at most one document's prefix
    star = shared.filter("c <> least_c").select(F.col("least_c").alias("a"), F.col("c").alias("b"), F.col("least_n").alias("na"), F.col("n").alias("nb"))
    tried = links = labels = None
    for turn in range(ROUNDS):
        if turn:
            star = _star(shared, labels, turn)
        pairs = star.select("a", "b", "na", "nb").distinct()
        pairs = scratch.keep(_possible(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), heads), f"tried-{turn}")
        if turn and not pairs.limit(1).count():
            break
        done = scratch.keep(_verified(texts, classes, pairs), f"links-{turn}")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links = done if links is None else links.unionByName(done)
        labels = components(links, scratch, f"cc-{turn}")

    # Last round: classes that share a bucket and aren't in one component yet. At the first shingle that a
    # pair shares, no more than what follows it in either set can overlap; so a bucket pairs only what that leaves within reach.
    placed = shared.select("h", "c", "n", "pos").join(labels, "c", "left").select("h", "c", "n", (F.col("n") - F.col("pos")).alias("rest"), F.coalesce("comp", "c").alias("comp"))
    placed = scratch.keep(placed.distinct(), "placed")
    mixed = placed.groupBy("h", "comp").agg(F.max("rest").alias("rest"), F.min("n").alias("low"), F.max("n").alias("high"))
    side = lambda x: mixed.select("h", *(F.col(k).alias(f"{k}_{x}") for k in ("comp", "rest", "low", "high")))
    cross = side("a").join(side("b"), "h").filter("comp_a < comp_b and 7 * least(rest_a, rest_b) >= 3 * (low_a + low_b) and 4 * high_a >= 3 * low_b and 4 * high_b >= 3 * low_a")
    member = lambda x: placed.select("h", *(F.col(k).alias(f"{v}_{x}") for k, v in (("comp", "comp"), ("c", "c"), ("n", "n"), ("rest", "rest"))))
    reach = "7 * least({ra}, {rb}) >= 3 * ({na} + {nb}) and 4 * {ha} >= 3 * {nb} and 4 * {hb} >= 3 * {na}"
    cross = cross.select("h", "comp_a", "comp_b", F.col("rest_b").alias("most_b"), "low_b", "high_b")
    pairs = cross.join(member("a"), ["h", "comp_a"]).filter(reach.format(ra="rest_a", rb="most_b", na="n_a", nb="low_b", ha="n_a", hb="high_b"))
    pairs = pairs.join(member("b"), ["h", "comp_b"]).filter(reach.format(ra="rest_a", rb="rest_b", na="n_a", nb="n_b", ha="n_a", hb="n_b"))
    first = F.col("c_a") < F.col("c_b")
    either = lambda k: (F.when(first, F.col(f"{k}_a")).otherwise(F.col(f"{k}_b")), F.when(first, F.col(f"{k}_b")).otherwise(F.col(f"{k}_a")))
    (a, b), (na, nb) = either("c"), either("n")
    more = pairs.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).distinct()
    more = scratch.keep(_possible(more.join(tried, ["a", "b"], "left_anti"), heads), "more")
    if more.limit(1).count():
        links = scratch.keep(links.unionByName(_verified(texts, classes, more)), "links")
    scratch.drop("shared", "heads", "placed", "more", *(f"tried-{turn}" for turn in range(ROUNDS)))
    return (rows, key), texts, members, classes, links, scratch


def _star(shared: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """a, b, na, nb: every class with the class of its bucket that one of LEADERS hashes of this turn picks, if it's in another component."""
    placed = shared.select("h", "c", "n").join(labels, "c", "left").select("h", "c", "n", F.coalesce("comp", "c").alias("comp"))
    lead = placed.groupBy("h").agg(F.min(F.struct(F.xxhash64("c", F.pmod("h", F.lit(LEADERS)), F.lit(turn)), "c", "n", "comp")).alias("lead"))
    rows = placed.join(lead, "h").filter("lead.comp <> comp").select("h", "c", "n", F.col("lead.c").alias("c2"), F.col("lead.n").alias("n2"))
    first = F.col("c") < F.col("c2")
    either = lambda x, y: (F.when(first, F.col(x)).otherwise(F.col(y)), F.when(first, F.col(y)).otherwise(F.col(x)))
    (a, b), (na, nb) = either("c", "c2"), either("n", "n2")
    return rows.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb"))


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that are links, and their overlap.

    Pairs are dealt out in blocks of classes, so a set travels once to each block that needs it. Blocks hold
    about GROUP classes on one side and at most about SIDE on the other.
    """
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    one = classes.join(ends, "c")
    n = ends.count()
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    dealt = pairs.select("a", "b", "na", "nb", block("a", max(BLOCKS, n // GROUP)).alias("ga"), block("b", max(1, n // SIDE)).alias("gb"))
    sets = texts.join(one, "row").select("c", "text").mapInArrow(trimmed(_sets), "c long, set binary")
    needed = dealt.select(F.col("a").alias("c"), "ga", "gb").unionByName(dealt.select(F.col("b").alias("c"), "ga", "gb")).distinct()
    sent = needed.join(sets, "c").select(F.col("ga").alias("xa"), F.col("gb").alias("xb"), "c", "set")
    return dealt.groupBy("ga", "gb").cogroup(sent.groupBy("xa", "xb")).applyInPandas(_linked, "a long, b long, overlap long")


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (to other classes) of every row."""
    _, texts, members, classes, links, scratch = _tree(docs)
    labels = components(links, scratch, "final")
    ends = scratch.keep(_n_links(texts, classes, labels), "ends")
    scratch.drop("rows", "classes", "links", *(f"links-{turn}" for turn in range(ROUNDS)))
    found = _placed(members, labels).join(ends, "c", "left")
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"))


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with component_id."""
    classes = members.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("low")).join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    comps = classes.groupBy("comp").agg(F.min("low").alias("component"))
    found = members.join(classes.join(comps, "comp").select("c", "component"), "c", "left")
    return found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component; the columns stay the same."""
    (rows, key), _, members, _, links, scratch = _tree(docs)
    labels = components(links, scratch, "final")
    full = members.filter("n_shingles > 0").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    best = full.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    stays = best.select(F.col("best.row").alias("row")).unionByName(members.filter("n_shingles = 0").select("row"))
    return rows.join(stays, rows[key] == stays["row"], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
