"""Removal of repeated passages by longest previous factors.

Every byte that lies in a string of SPAN bytes which also starts earlier (in a smaller doc_id, or earlier
in the same document) is removed; first copies stay.

The corpus is searched in parts. Each string of SPAN bytes belongs to the part named by the hash of its
least gram of GRAMS[0] bytes, so equal strings meet in one part, and strings next to each other mostly share the
gram: they travel together as one stretch of text. A part puts its places into suffix order, as far as
SPAN bytes tell them apart, with the common prefixes of neighbours; the previous and next smaller position in that
order then give each place's longest previous factor, cut at SPAN. Places whose factor reaches SPAN are later copies.
Places whose string's hash occurs once in the part are left out first: their factors can't reach SPAN. Equal
stretches are collapsed to their first before they travel and again in the part, and equal texts of a
batch likewise, so copies by the thousand cost one sort each. The number of parts follows the number of bytes.

The bytes of every part are counted first. A part of more than HOT_BYTES holds a gram that very many different
stretches share; its strings are dealt out anew by longer grams, and those of parts that are still too large by the whole string.
Level and part of a string follow from its bytes alone, so equal strings still meet.

Defined results: null text is empty; texts under SPAN bytes lose nothing; rows without doc_id come before all others;
of rows with one doc_id neither comes before the other, except by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import CHUNK, Scratch, chunks, mix, of_rows, powers, prefix_hash, strings, trimmed

#: Bytes of the grams that name the part, level by level; then whole strings.
GRAMS = (12, 40)
PART_BYTES = 2 << 20
#: Parts with more bytes of stretches than this (four times the usual) are dealt out anew.
HOT_BYTES = 24 << 20
FLUSH_BYTES = 16 << 20
NOTHING = -(1 << 63)


@dataclass(frozen=True)
class Level:
    """Grams of so many bytes name parts from first on; the strings of the parts in hot (sorted) go to the next level."""

    gram: int
    first: int
    parts: int
    hot: np.ndarray

    def part(self, gram: np.ndarray) -> np.ndarray:
        return (mix(gram) % np.uint64(self.parts)).astype(np.int32) + np.int32(self.first)


def parts_for(strings: int, gram: int, span: int) -> int:
    """How many parts so many strings of span bytes need; a stretch holds (span - gram + 2) / 2 of them on average."""
    return max(4, -(-int(strings * (1 + 2 * (span - 1) / (span - gram + 2))) // (3 * PART_BYTES)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by block prefixes and suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, span: int, size: int, some: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Start, number of strings, hash of the gram of size bytes and content hash of each stretch; some: whether the string at a place counts."""
    n = len(data)
    none = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.uint64))
    if n < span:
        return none
    p = prefix_hash(data)
    down = powers(n + 1)[1]
    gram = mix((p[size:] - p[:-size]) * down[: n - size + 1])
    least = sliding_min(gram & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64), span - size + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[: n - span + 1] == row[span - 1 :]
    s = np.flatnonzero(whole if some is None else whole & some[: n - span + 1])
    if not len(s):
        return none
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (least[s[1:]] != least[s[:-1]])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(s)))
    start = s[first]
    end = start + run + span - 1
    return start, run, least[start] >> np.uint64(32), mix((p[end] - p[start]) * down[start]) ^ mix(run.astype(np.uint64))


def dealt(data: np.ndarray, offsets: np.ndarray, span: int, levels: list[Level]) -> tuple[np.ndarray, ...]:
    """Start, number of strings, part and content hash of each stretch, of all levels."""
    out, some = [], None
    for level in levels:
        start, run, gram, content = stretches(data, offsets, span, level.gram, some)
        part = level.part(gram)
        hot = np.isin(part, level.hot)
        out.append([x[~hot] for x in (start, run, part, content)])
        if not hot.any():
            break
        edges = (np.bincount(x, minlength=len(data) + 1) for x in (start[hot], start[hot] + run[hot]))
        some = np.cumsum(np.subtract(*edges)) > 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes data[start:start + length] one after another; index arrays stay at the size of a chunk."""
    out = np.empty(int(length.sum()), np.uint8)
    for a, b, lo, hi in groups(length):
        n = length[a:b]
        out[lo:hi] = data[np.repeat(start[a:b] - (np.cumsum(n) - n), n) + np.arange(hi - lo)]
    return out


def groups(length: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of stretches of about a chunk: first, end, and their bytes' first and end if they stand one after another."""
    ends = np.cumsum(length)
    a, lo = 0, 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        yield a, b, lo, int(ends[b - 1])
        a, lo = b, int(ends[b - 1])


def content_hashes(text: np.ndarray, run: np.ndarray, span: int) -> np.ndarray:
    """A hash of each stretch; they stand one after another in text."""
    length = run + span - 1
    out = np.empty(len(run), np.uint64)
    for a, b, lo, hi in groups(length):
        p = prefix_hash(text[lo:hi])
        base = np.cumsum(length[a:b]) - length[a:b]
        out[a:b] = mix((p[base + length[a:b]] - p[base]) * powers(hi - lo + 1)[1][base]) ^ mix(run[a:b].astype(np.uint64))
    return out


def string_hashes(text: np.ndarray, run: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in text and hash of every string of span bytes of stretches that stand one after another."""
    length = run + span - 1
    at, h = np.empty(int(run.sum()), np.int32), np.empty(int(run.sum()), np.uint64)
    done = 0
    for a, b, lo, hi in groups(length):
        p = prefix_hash(text[lo:hi])
        n = run[a:b]
        own = np.repeat(np.cumsum(length[a:b]) - length[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        h[done : done + len(own)] = (p[own + span] - p[own]) * powers(hi - lo + 1)[1][own]
        at[done : done + len(own)] = own + lo
        done += len(own)
    return at, h


def _firsts(content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each stretch is the first, by position, of those with its content; others may share its position."""
    order = np.lexsort((place, doc, content))
    c, d, q = content[order], doc[order], place[order]
    head = np.ones(len(order), bool)
    head[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    out = np.empty(len(order), bool)
    out[order] = (d == d[at]) & (q == q[at])
    return out


_COLUMNS = ["part", "blob", "doc", "th", "s", "e"]
_KIND = "part int, blob binary, doc long, th long, s int, e int"


def _covered(parts: int, doc: np.ndarray, th: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Spans found on the way: any part passes them on."""
    part = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(doc), pa.binary()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=_COLUMNS)


def _fresh(batch: pa.RecordBatch, span: int, levels: list[Level]) -> Iterator[tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...] | None]]:
    """Spans (doc, th, s, e) that are later copies within the batch, and of a chunk's other stretches doc, th, place, run, part and text."""
    data, offsets = strings(batch.column("text"))
    docs, ths = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "th"))
    # Later copies of a whole text.
    order = np.lexsort((docs, ths))
    first = np.append(True, ths[order][1:] != ths[order][:-1])[: len(order)]
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    later = np.zeros(len(docs), bool)
    later[order] = docs[order] > docs[head]
    lengths = np.diff(offsets)
    gone = later & (lengths >= span)
    yield (docs[gone], ths[gone], np.zeros(gone.sum(), np.int32), lengths[gone]), None
    for lo, _, text, at in chunks(data, offsets, CHUNK):
        start, n, part, content = dealt(text, at, span, levels)
        row = of_rows(at, start)
        good = ~later[lo + row]
        start, n, part, content, row = (x[good] for x in (start, n, part, content, row))
        if not len(start):
            continue
        place, doc, th = start - at[row], docs[lo + row], ths[lo + row]
        one = _firsts(content, doc, place)
        copies = (doc[~one], th[~one], place[~one], (place + n + span - 1)[~one])
        yield copies, (doc[one], th[one], place[one], n[one], part[one], gather(text, start[one], n[one] + span - 1))


def _sizes(levels, span: int):
    """The bytes and strings of each part of the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = levels.value[-1]
        kept, size = [], 0

        def summed() -> pa.RecordBatch:
            part, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            names, which = np.unique(part, return_inverse=True)
            total = [np.bincount(which, w).astype(np.int64) for w in (n + span - 1, n)]
            return pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, total)], names=["part", "bytes", "strings"])

        for batch in batches:
            for _, found in _fresh(batch, span, levels.value):
                if found is not None and (own := found[4] >= last.first).any():
                    kept.append((found[4][own], found[3][own]))
                    size += int(own.sum())
                if size > 1 << 20:
                    yield summed()
                    kept, size = [], 0
        if kept:
            yield summed()

    return run


def _split(levels, span: int):
    def blobs(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, th, place, run, part, text = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(part, kind="stable")
        length = run + span - 1
        text = gather(text, (np.cumsum(length) - length)[order], length[order])
        ends = np.cumsum(length[order])
        cut = np.append(np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])), len(order))
        pack = zstandard.ZstdCompressor(level=3).compress
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:b]
            head = np.array([b - a], np.int64).tobytes() + doc[at].tobytes() + th[at].tobytes() + place[at].astype(np.int32).tobytes() + run[at].astype(np.int32).tobytes()
            blob = pack(head + text[ends[a] - length[order[a]] : ends[b - 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part[order[a]]], pa.int32()), pa.array([blob]), *(pa.array([0], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for copies, found in _fresh(batch, span, levels.value):
                if len(copies[0]):
                    yield _covered(levels.value[0].parts, *copies)
                if found is not None:
                    kept.append(found)
                    size += len(found[-1])
                if size > FLUSH_BYTES:
                    yield from blobs(kept)
                    kept, size = [], 0
        if size:
            yield from blobs(kept)

    return run


_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def suffix_order(text: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at ``at``, told apart by span bytes, equal ones as given; and the common prefix
    of each with the one before it (at most span, 0 for the first). Groups of equal prefixes are refined 8 bytes at a time.
    """
    n = len(at)
    padded = np.concatenate([text, np.zeros(8 + span, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    order, head = np.arange(n), np.zeros(n, bool)
    lcp = np.full(n, span, np.int32)
    head[:1], lcp[:1] = True, 0
    for k in range(0, span, 8):
        word = eight[at[order] + k].astype(np.uint64)
        if span - k < 8:
            word &= ~np.uint64(0) << np.uint64(8 * (8 - span + k))
        first = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        mixed = np.zeros(len(first), bool)
        mixed[group[word != word[first][group]]] = True
        some = np.flatnonzero(mixed[group])
        if not len(some):
            continue
        by = some[np.lexsort((word[some], group[some]))] if k else np.argsort(word, kind="stable")
        order[some], word[some] = order[by], word[by]
        new = some[1:][(group[some[1:]] == group[some[:-1]]) & (word[some[1:]] != word[some[:-1]])]
        head[new] = True
        lcp[new] = k + 7 - np.searchsorted(_BYTES, word[new] ^ word[new - 1], "right")
    return order, lcp


def _smaller_before(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it, in suffix order, of a smaller position; 0 without one."""
    to, low = np.arange(-1, len(position) - 1), lcp.copy()
    todo = np.arange(len(position))
    while len(todo):
        todo = todo[(to[todo] >= 0) & (low[todo] > 0)]
        todo = todo[position[to[todo]] >= position[todo]]
        j = to[todo]
        less, on = np.minimum(low[todo], low[j]), to[j]
        low[todo], to[todo] = less, on
    return np.where(to >= 0, low, 0)


def previous_factors(position: np.ndarray, lcp: np.ndarray, span: int) -> np.ndarray:
    """The longest previous factor, cut at span, of each suffix in suffix order; equal suffixes stand by position.

    Within a run of equal suffixes the previous smaller position is in the run, but for those at its first position; so only
    the runs' heads look beyond their run, back for the previous and ahead for the next smaller position.
    """
    head = np.flatnonzero(lcp < span)
    run = np.cumsum(lcp < span) - 1
    own, prefix = position[head], lcp[head]
    ahead = _smaller_before(own[::-1], np.append(prefix[1:], 0)[::-1])[::-1] if len(head) else prefix
    factor = np.maximum(_smaller_before(own, prefix), ahead)[run]
    return np.where(position > own[run], span, factor)


def later_copies(doc: np.ndarray, place: np.ndarray, run: np.ndarray, text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first and end number of each run of strings that are later copies; stretches stand one after another in text."""
    order = np.lexsort((place, doc))
    fresh = np.append(True, (doc[order][1:] != doc[order][:-1]) | (place[order][1:] != place[order][:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    at, h = string_hashes(text, run, span)
    of = np.repeat(np.arange(len(run), dtype=np.int32), run)
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    twice = np.zeros(len(h), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    some = np.flatnonzero(twice)
    del h, by, same, twice
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none
    number = some - (np.cumsum(run) - run)[of[some]]
    position = rank[of[some]] << 32 | number
    given = np.argsort(position, kind="stable")
    suffixes, lcp = suffix_order(text, at[some[given]], span)
    suffixes = given[suffixes]
    factors = previous_factors(position[suffixes], lcp, span)
    copies = np.sort(some[suffixes[factors >= span]])
    if not len(copies):
        return copies, copies, copies
    new = np.append(True, (copies[1:] != copies[:-1] + 1) | (of[copies[1:]] != of[copies[:-1]]))
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(copies)) - 1
    base = (np.cumsum(run) - run)[of[copies[firsts]]]
    return of[copies[firsts]], copies[firsts] - base, copies[lasts] - base + 1


def _solve(span: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame.loc[frame["blob"].isna(), ["doc", "th", "s", "e"]]
        columns = [[] for _ in range(5)]
        for blob in frame["blob"].dropna():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw[:8], np.int64)[0])
            at = 8
            for column, kind in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=False):
                column.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            columns[4].append(np.frombuffer(raw, np.uint8, offset=at))
        if not columns[0]:
            return known
        doc, th, place, count, text = (np.concatenate(c) for c in columns)
        place, count = place.astype(np.int64), count.astype(np.int64)
        length = count + span - 1
        base = np.cumsum(length) - length
        content = content_hashes(text, count, span)
        one = _firsts(content, doc, place)
        text = gather(text, base[one], length[one])
        of, first, end = later_copies(doc[one], place[one], count[one], text, span)
        kept = np.flatnonzero(one)[of]
        rest = np.flatnonzero(~one)
        found = pd.DataFrame({
            "doc": np.concatenate([doc[kept], doc[rest]]), "th": np.concatenate([th[kept], th[rest]]),
            "s": np.concatenate([place[kept] + first, place[rest]]).astype(np.int32), "e": np.concatenate([place[kept] + end + span - 1, place[rest] + length[rest]]).astype(np.int32),
        })
        return pd.concat([known, found])

    return run


def _levels(rows: DataFrame, total: int, span: int, hot_bytes: int) -> list[Level]:
    """Counts the parts of each level but the last; a level follows if some are too large (one for each hot_bytes of stretches at most)."""
    none = np.zeros(0, np.int32)
    grams = [g for g in GRAMS if g < span] + [span]
    levels = [Level(grams[0], 0, max(4, -(-total // PART_BYTES)), none)]
    for gram in grams[1:]:
        shared = rows.sparkSession.sparkContext.broadcast(levels)
        sizes = rows.mapInArrow(trimmed(_sizes(shared, span)), "part int, bytes long, strings long").groupBy("part").agg(F.sum("bytes").alias("bytes"), F.sum("strings").alias("strings"))
        hot = sizes.filter(F.col("bytes") > hot_bytes).select("part", "strings").toArrow()
        shared.destroy()
        if not hot.num_rows:
            break
        last = levels[-1]
        levels[-1] = replace(last, hot=np.sort(hot.column("part").to_numpy()))
        levels.append(Level(gram, last.first + last.parts, parts_for(int(hot.column("strings").to_numpy().sum()), gram, span), none))
    return levels


def repeated_spans(docs: DataFrame, span: int = 100, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, Scratch]:
    """doc (least long where null), th (xxhash64 of text), spans: array of s << 32 | e, bytes to remove, overlapping ones among them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    rows = keyed(docs).select("doc", "th", "text")
    levels = spark.sparkContext.broadcast(_levels(rows, total, span, hot_bytes))
    spans = rows.mapInArrow(trimmed(_split(levels, span)), _KIND).groupBy("part").applyInPandas(_solve(span), "doc long, th long, s int, e int")
    spans = spans.select("doc", "th", F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("e").cast("long")).alias("x"))
    spans = scratch.keep(spans.groupBy("doc", "th").agg(F.collect_set("x").alias("spans")), "spans")
    levels.destroy()
    return spans, scratch


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NOTHING)), "th": F.xxhash64(text), "text": text})


def remove_repeats(docs: DataFrame, span: int = 100, text: bool = True, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, kept (the bytes that remain, if text), n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spans, _ = repeated_spans(docs.select("doc_id", "text"), span, hot_bytes)
    rows = keyed(docs.select("doc_id", "text")).join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            raw = data.tobytes()
            made = []
            for i, spans_of in enumerate(batch.column("spans")):
                own = raw[offsets[i] : offsets[i + 1]]
                left, n_spans = own, 0
                if spans_of.is_valid and len(spans_of):
                    x = np.sort(spans_of.values.to_numpy(zero_copy_only=False))
                    s, e = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
                    new = np.append(True, s[1:] > e[:-1])
                    s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
                    left, n_spans = b"".join(own[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(own)], strict=True)), len(s)
                made.append((left if text else None, len(own), len(own) - len(left), n_spans, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kinds = (("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))
    return rows.mapInArrow(trimmed(run), T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)]))
