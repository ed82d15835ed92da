"""Toxicity scores by votes of the nearest labelled examples.

Texts are TF-IDF vectors over all words of the labelled examples, none left out. Weights are (1 + log count) * idf *
relevance, where relevance is 1 but for words that the examples show to go with a label: there it grows with the
square of the evidence. A word's evidence is its number of different neighbourhoods (word before, word after), so copies
of one text don't count again and again.

The examples stand in a block-max inverted index: each word's postings are cut into blocks of BLOCK examples,
and for each block the word's largest weight is kept. The postings of words that many examples hold are laid out densely,
and a batch of queries goes through them in one product; a block's bound is the largest of these sums in it plus the largest weights of
the query's other words. A query looks into the blocks of the highest bounds, and then into all whose bound reaches its
k-th neighbour so far; cosines near the k-th are summed again in double precision, so the neighbours are exact. Words that no example holds scale all cosines of a text alike and are left out of its length. Votes are
weighted by cosine and by how many labelled rows an example stands for, then calibrated on the examples'
own leave-one-out votes.

The classifier is fitted on at most ``examples`` labelled rows a class, chosen by a hash of the id.
Document frequencies are counted over all documents.

Defined results: null text counts as empty; a text without any word of an example gets the share of toxic examples;
without labelled rows every score is 0. Ties between neighbours go to the earlier example. An id that is
labelled both ways counts as toxic; of several texts with one id the least is learnt. An input column that is named like a
result is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import chunks, mix, of_rows, strings, trimmed, with_columns, words

BLOCK = 64
#: Blocks that a query looks into before it compares bounds with its k-th neighbour.
FIRST = 8
#: Words in more than one of so many examples, DENSE of them at most, have dense postings; queries that go through them at once.
SHARE, DENSE, BATCH = 16, 512, 64
#: Beyond what single precision can be wrong by.
SLACK = 1e-5
#: Evidence, in standard deviations, from which a word's relevance grows.
EVIDENT = 4.0


@dataclass(frozen=True)
class Index:
    """Examples in inverted form.

    terms: sorted word hashes; weight: idf * relevance of each. Entries of a term in blocks: entry[t] to entry[t + 1], with the
    block, its largest weight, and where its postings begin (they end where the next ones begin). Postings: example and weight, of unit length.
    column: where a term with dense postings stands in dense (examples by such terms), or -1; it has no entries.
    """

    terms: np.ndarray
    weight: np.ndarray
    entry: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    begin: np.ndarray
    example: np.ndarray
    value: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    k: int
    empty: float
    slope: float = 1.0
    shift: float = 0.0


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to its end, and which range each is of."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (start - np.cumsum(n) + n)[of], of


def inverted(row: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int) -> tuple[np.ndarray, ...]:
    """entry, block, largest, begin, example and value of an Index."""
    order = np.lexsort((row, term))
    row, term, value = row[order], term[order], value[order]
    block = row // BLOCK
    new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(row)]
    begin = np.flatnonzero(new)
    largest = np.maximum.reduceat(value, begin) if len(begin) else value
    entry = np.searchsorted(term[begin], np.arange(terms + 1))
    return entry, block[begin].astype(np.int32), largest, np.append(begin, len(row)), row.astype(np.int32), value


def _stripped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word; what isn't a letter or digit at its ends is no part of it."""
    clean = data.copy()
    odd = (data < 128) & ~(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 48) & (data <= 57))
    clean[odd] = 32
    s, _, h = words(clean, offsets)
    return of_rows(offsets, s), h


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        toxic = np.array(batch.column("toxic").to_pylist(), np.int32)
        for lo, _, part, at in chunks(data, offsets):
            row, h = _stripped(part, at)
            before, after = np.zeros_like(h), np.zeros_like(h)
            before[1:], after[:-1] = np.where(row[1:] == row[:-1], h[:-1], 0), np.where(row[1:] == row[:-1], h[1:], 0)
            around = mix(before * np.uint64(31) + after)
            key = mix(h ^ mix(around)) + toxic[lo + row].astype(np.uint64)
            _, one = np.unique(key, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(around[one].view(np.int64)), pa.array(toxic[lo + row[one]])], names=["word", "around", "toxic"])


def _hits(part: np.ndarray, at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count, for the terms that occur."""
    row, h = _stripped(part, at)
    if not len(terms) or not len(h):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    place = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    good = terms[place] == h
    both, n = np.unique(row[good] * len(terms) + place[good], return_counts=True)
    return both // len(terms), both % len(terms), n


def nearest(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k nearest examples, by cosine, of each query (terms and their weights, of unit length); skip: an example for each that doesn't count."""
    for a in range(0, len(queries), BATCH):
        group = queries[a : a + BATCH]
        common = np.zeros((len(group), index.dense.shape[1]))
        rare = []
        for i, (term, q) in enumerate(group):
            column = index.column[term]
            common[i, column[column >= 0]] = q[column >= 0]
            rare.append((term[column < 0], q[column < 0]))
        base = common.astype(np.float32) @ index.dense.T
        for i, (term, q) in enumerate(rare):
            yield _nearest(index, base[i], common[i], term, q, skip[a + i] if skip else -1)


def _nearest(index: Index, base: np.ndarray, common: np.ndarray, term: np.ndarray, q: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """base: cosines as far as words with dense postings make them; term, q: the others."""
    n, blocks = len(index.toxic), -(-len(index.toxic) // BLOCK)
    if not n:
        return np.zeros(0, int), np.zeros(0)
    if skip >= 0:
        base[skip] = -2
    entry, of = _ranges(index.entry[term], index.entry[term + 1])
    block, weight = index.block[entry], q[of]
    bound = np.maximum.reduceat(base, np.arange(0, n, BLOCK)) + np.bincount(block, weight * index.largest[entry], minlength=blocks)
    score = base.astype(float)

    def look_into(some: np.ndarray) -> None:
        chosen = np.flatnonzero(some[block])
        posting, which = _ranges(index.begin[entry[chosen]], index.begin[entry[chosen] + 1])
        score[:] += np.bincount(index.example[posting], weight[chosen][which] * index.value[posting], minlength=n)

    first = np.zeros(blocks, bool)
    first[np.argsort(-bound, kind="stable")[:FIRST]] = True
    look_into(first)
    own = score[np.repeat(first, BLOCK)[:n]]
    least = max(np.partition(own, len(own) - index.k)[len(own) - index.k] if len(own) >= index.k else 0, 0) - SLACK
    rest = ~first & (bound >= least)
    if rest.any():
        look_into(rest)
    some = np.flatnonzero(score >= least)
    if len(some) > 4 * index.k:
        some = some[score[some] >= np.partition(score[some], len(some) - index.k)[len(some) - index.k] - SLACK]
    exact = score[some] - base[some] + index.dense[some].astype(float) @ common
    order = np.lexsort((some, -exact))[: index.k]
    order = order[(exact[order] > 1e-9) & (some[order] != skip)]
    return some[order], exact[order]


def _votes(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[float, np.ndarray]]:
    for ids, cosine in nearest(index, queries, skip):
        weight = cosine**4 * index.stands_for[ids]
        yield (float((weight * index.toxic[ids]).sum() / weight.sum()) if weight.sum() > 0 else index.empty), ids


def _unit(term: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * weight[term]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def _calibrated(vote: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from votes to chances, by Newton steps with a ridge towards the vote itself."""
    z = np.stack([np.log((vote + 0.02) / (1.02 - vote)), np.ones_like(vote)], 1)
    b = np.array([1.0, 0.0])
    weight = weight * len(weight) / weight.sum()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - toxic)) + 2 * (b - [1, 0])
        b = b - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 2 * np.eye(2), g)
    return float(max(b[0], 0.1)), float(b[1])


def build(found: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, stands: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int) -> Index:
    """An index of examples, each of terms and counts."""
    full = np.array([len(t) > 0 for t, _ in found], bool)
    empty = float((stands * toxic).sum() / max(stands.sum(), 1e-9))
    if len(found) and (~full).any():
        empty = float((stands * toxic)[~full].sum() / stands[~full].sum())
    found = [x for x in found if len(x[0])]
    row = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
    term = np.concatenate([t for t, _ in found]) if found else np.zeros(0, int)
    value = np.concatenate([_unit(t, n, weight) for t, n in found]).astype(np.float32) if found else np.zeros(0, np.float32)
    held = np.bincount(term, minlength=len(terms))
    often = np.flatnonzero(held > len(found) / SHARE)
    often = often[np.argsort(-held[often], kind="stable")[:DENSE]]
    column = np.full(len(terms), -1, np.int32)
    column[often] = np.arange(len(often))
    dense = np.zeros((len(found), len(often)), np.float32)
    there = column[term] >= 0
    dense[row[there], column[term[there]]] = value[there]
    return Index(terms, weight, *inverted(row[~there], term[~there], value[~there], len(terms)), column, dense, toxic[full] if len(full) else toxic, stands[full] if len(full) else stands, k, empty)


def fit(docs: DataFrame, labels: DataFrame, examples: int = 4000, k: int = 15) -> Index:
    """labels: doc_id and toxic (0 or 1) of the rows that may be learnt from."""
    spark = docs.sparkSession
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = lambda v: labels.filter(F.col("toxic") == v).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(examples)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * examples rows
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = {v: max(1, min(sizes.get(v, 0), examples)) for v in (0, 1)}
    found = some.select("text", "toxic").mapInArrow(trimmed(_evidence), "word long, around long, toxic int")
    seen = found.distinct().groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rate = (F.col("a") + F.col("b")) * (rows[1] / (rows[0] + rows[1]))
    z = (F.col("a") - rate) / F.sqrt(rate * (rows[0] / (rows[0] + rows[1])) + 0.25)
    known = seen.select("word", F.when(F.col("a") + F.col("b") >= 4, F.abs(z)).otherwise(0.0).alias("z")).toArrow()  # the words of at most 2 * examples rows
    vocabulary, evidence = (known.column(c).to_numpy() for c in ("word", "z"))
    order = np.argsort(vocabulary.view(np.uint64))
    vocabulary, evidence = vocabulary.view(np.uint64)[order], evidence[order]
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for lo, hi, part, at in chunks(data, offsets):
                total[:-1] += np.bincount(_hits(part, at, terms)[1], minlength=len(terms))
                total[-1] += hi - lo
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "n"])

    df = np.zeros(len(vocabulary) + 1)
    counted = docs.select("text").mapInArrow(trimmed(frequencies), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.maximum(1, evidence / EVIDENT) ** 2

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for lo, hi, part, at in chunks(data, offsets):
                row, term, n = _hits(part, at, shared.value)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                pack = [np.stack([term[a:b], n[a:b]]).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), pa.array(pack, pa.binary())], names=["toxic", "x"])

    got = [(r.x, r.toxic) for r in some.select("text", "toxic").mapInArrow(trimmed(sparse), "toxic int, x binary").collect()]  # at most 2 * examples rows
    packs = [(*np.frombuffer(x, np.int32).reshape(2, -1), v) for x, v in got]
    shared.destroy()
    # Examples that share their most telling word stand together, so bounds are tight.
    lead = [int(t[np.argmax(_unit(t, n, weight))]) if len(t) else -1 for t, n, _ in packs]
    packs = [packs[i] for i in sorted(range(len(packs)), key=lambda i: (lead[i], got[i]))]
    toxic = np.array([v for *_, v in packs], float)
    index = build([(t, n) for t, n, _ in packs], toxic, np.array([sizes[v] / rows[v] for *_, v in packs]), vocabulary, weight, k)
    if len(index.toxic) < 2:
        return index
    full = [(t, n) for t, n, _ in packs if len(t)]
    del got, packs, known, evidence, order
    votes = _own_votes(docs, index, full)
    slope, shift = _calibrated(votes, index.toxic, index.stands_for)
    return replace(index, slope=slope, shift=shift)


def _own_votes(docs: DataFrame, index: Index, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The vote on each example by the others; found: their terms and counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((index, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, examples = shared.value
        for b in batches:
            ids = b.column("id").to_numpy()
            own = [vote for vote, _ in _votes(known, [(examples[i][0], _unit(*examples[i], known.weight)) for i in ids], ids.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.float64())], names=["id", "vote"])

    got = spark.range(len(found)).mapInArrow(trimmed(run), "id long, vote double").toArrow()
    out = np.empty(len(found))
    out[got.column("id").to_numpy()] = got.column("vote").to_numpy()
    shared.destroy()
    return out


def score(docs: DataFrame, index: Index, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all of docs), then toxicity, vote and evidence (numbers of the nearest examples)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("toxicity", "vote", "evidence")]
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        known: dict[bytes, tuple[float, float, list]] = {}
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            out = [(index.empty, index.empty, [])] * batch.num_rows
            for lo, _, part, at in chunks(data, offsets, rows=2048):
                row, term, n = _hits(part, at, index.terms)
                if len(known) > 20_000:
                    known.clear()
                rows = np.unique(row)
                starts = np.searchsorted(row, rows)
                keys, fresh = [], {}
                for a, b in zip(starts.tolist(), np.append(starts, len(row))[1:].tolist(), strict=True):
                    keys.append(hashlib.blake2b(term[a:b].tobytes() + n[a:b].tobytes(), digest_size=16).digest())
                    if keys[-1] not in known and keys[-1] not in fresh:
                        fresh[keys[-1]] = (term[a:b], _unit(term[a:b], n[a:b], index.weight))
                for key, (vote, ids) in zip(fresh, _votes(index, list(fresh.values())), strict=True):
                    chance = 1 / (1 + np.exp(-(index.slope * np.log((vote + 0.02) / (1.02 - vote)) + index.shift)))
                    known[key] = (float(chance), vote, ids.tolist())
                for i, key in zip(rows.tolist(), keys, strict=True):
                    out[lo + i] = known[key]
            made = list(zip(*out, strict=True)) or [(), (), ()]
            yield with_columns(batch, keep, {"toxicity": pa.array(made[0], pa.float64()), "vote": pa.array(made[1], pa.float64()), "evidence": pa.array(made[2], pa.list_(pa.int32()))})

    fields = [docs.schema[c] for c in keep] + [T.StructField("toxicity", T.DoubleType()), T.StructField("vote", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.IntegerType()))]
    return docs.mapInArrow(trimmed(run), T.StructType(fields))
