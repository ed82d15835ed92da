"""Best-fit packing by minimum bin slack.

Texts become token ids (a byte-level BPE vocabulary) and an end id; longer documents are cut into full
sequences after a first, shorter piece. Bins are filled one kind at a time: the longest piece left, then the
combination of lengths left that fills the rest best, found by subset-sum dynamic programming on a
bitset. Only the number of pieces of each length matters for this, so it runs over a table of at most
``capacity`` numbers, and a combination is used as often as the pieces allow. Pieces then find their place
by their rank among those of the same length, which hashed parts count separately.

Special tokens of the vocabulary that a text spells out get their ids, as the library gives them; with
``special=False`` they are ordinary text.

Defined results: null text counts as empty and gives the end id alone; rows are packed separately whatever their ids;
an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import trimmed

END = 2
CAPACITY = 1024
#: Pieces of one length are ranked in parts of about so many.
PART = 256
#: Beyond these characters the two libraries' character tables might differ, so such texts go through ``tokenizers``.
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ɏ]")


def encoder(vocabulary: str, ranks: str, pattern: str, special: bool = True):
    """text -> ids as uint32. ranks is the same vocabulary in another library's form, which is faster on common text."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    exact.encode_special_tokens = not special
    spelt = [t.content for t in exact.get_added_tokens_decoder().values()] if special else []
    other = re.compile("|".join([_OTHER.pattern, *map(re.escape, spelt)]))
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if other.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text), np.uint32)

    return encode


def pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY, special: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern, special)
        for batch in batches:
            doc, piece, start, length, ids = [], [], [], [], []

            def made():
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])
                for column in (doc, piece, start, length, ids):
                    column.clear()
                return out

            for i, text in enumerate(batch.column("text")):
                all_ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(all_ids) % capacity or capacity, len(all_ids), capacity), len(all_ids)]
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, value in ((doc, i), (piece, n), (start, a), (length, b - a), (ids, all_ids[a:b].tobytes())):
                        column.append(value)
                if len(doc) >= 4000:
                    yield made()
            if doc:
                yield made()

    kind = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), T.StructType(kind))


def _fullest(left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of available pieces whose sum comes nearest to room from below."""
    reach, layers = 1, []
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        copies, k = min(left[length], room // length), 1
        while copies > 0:
            k = min(k, copies)
            layers.append((length, k, reach))
            reach |= (reach << (length * k)) & ((1 << (room + 1)) - 1)
            copies -= k
            k *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> target & 1:
            out[length] = out.get(length, 0) + k
            target -= length * k
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, copies in each sequence, offset) of each run of like places."""
    left = {k: v for k, v in counts.items() if v}
    used, sequence, out = dict.fromkeys(left, 0), 0, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = {longest: 1}
        for length, copies in _fullest(left, capacity - longest):
            combination[length] = combination.get(length, 0) + copies
        left[longest] += 1
        times = min(left[x] // n for x, n in combination.items())
        offset = 0
        for length, copies in combination.items():
            out.append((length, used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += length * copies
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        sequence += times
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with a length from 1 to capacity) and sequence_id, offset. rows must be a table that reads alike each time."""
    rows = rows.drop("sequence_id", "offset")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = sorted(plan(counts, capacity))
    table = np.array(runs or [(1, 0, 0, 1, 0)], np.int64)
    parts = F.array(*(F.lit(max(1, -(-counts.get(n, 0) // PART))) for n in range(1, capacity + 1)))
    others = [c for c in rows.columns if c != "length"]
    part = F.pmod(F.xxhash64(*others), F.get(parts, (F.col("length") - 1).cast("int")))
    spread = rows.withColumn("__part", part)
    within = Window.partitionBy("length", "__part").orderBy(*others)
    numbered = spread.withColumn("__rank", F.row_number().over(within).cast("long") - 1)
    before = spread.groupBy("length", "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).select("length", "__part", "__before")
    ranked = numbered.join(before, ["length", "__part"]).select(*rows.columns, (F.col("__rank") + F.col("__before")).alias("__rank"))
    keep = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            run = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(run[:, 2] + k // run[:, 3]), pa.array(run[:, 4] + k % run[:, 3] * length)], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(place), T.StructType([*(rows.schema[c] for c in keep), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
