"""What the operators of this subpackage share: tables, scratch tables and vectorised text kernels.

Scratch tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and executors), so
a lost executor never loses them. Only a session on one machine may leave that setting out; a temporary one is set then.
"""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 19
#: Shuffle files behind a table go as soon as it is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("gridloom.scratch.dir", found)
    return found


def unused(names: list[str], name: str) -> str:
    """name, lengthened until no column bears it."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


_writes = {"lock": threading.Lock(), "now": 0, "before": None}


class Scratch:
    """Tables written to the shared folder and reread: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        conf = self.spark.conf
        with _writes["lock"]:  # the setting stays on until the last of several concurrent writes ends
            if not _writes["now"]:
                _writes["before"] = conf.get(CLEAN, None)
                conf.set(CLEAN, "true")
            _writes["now"] += 1
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        finally:
            with _writes["lock"]:
                _writes["now"] -= 1
                if not _writes["now"]:
                    conf.set(CLEAN, _writes["before"]) if _writes["before"] is not None else conf.unset(CLEAN)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def trimmed(run: Callable) -> Callable:
    """run, over batches; then the worker, which lives on, hands free memory back to the system."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n. Those of a chunk are kept, longer ones aren't."""
    made = _powers if n <= CHUNK + 1 else {}
    if not made:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(max(n, CHUNK + 1), base, np.uint64)
            step[0] = 1
            made[name] = np.multiply.accumulate(step)
    return made["up"][:n], made["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the polynomial hash of data[s:e], times BASE**s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a text column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``rows`` whole rows and about ``most`` bytes: first row, end row, bytes, offsets. A longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; none crosses texts."""
    n = len(data)
    low = LOWER[data]
    text = ~SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = text.copy(), text.copy()
    first[1:] &= ~text[:-1] | cut[1:n]
    last[:-1] &= ~text[1:] | cut[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p = prefix_hash(low)
    h = (p[e] - p[s]) * powers(n + 1)[1][s]
    return s, e, mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def of_rows(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The row that each place (a byte position) belongs to."""
    return np.searchsorted(offsets, places, "right") - 1


def with_columns(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns named in keep, then more."""
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more.values()], names=[*keep, *more])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def chain(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries of w."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    acc = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - n + 1 + j])
    return acc
