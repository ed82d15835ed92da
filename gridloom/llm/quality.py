"""Quality scores by positive-unlabelled learning.

A text is described by shares of character classes, of repeated words, word pairs and lines, and by its
length; each measure is cut into bins at its quantiles over all documents, so the model is additive and free in shape. The
model minimises the non-negative unbiased risk  pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)])  with
logistic loss. The class prior pi is estimated as the least ratio of unlabelled to positive mass among
the regions that a first model scores highest; the unlabelled mass is that of all documents.

Quantiles come from histograms of all documents over cells of the 16 high bits of a float, which are
monotone and 1/128 wide. Only the gradient steps use bounded samples: ``positives`` trusted rows and about ``unlabelled`` texts.

Defined results: null text counts as empty; without any trusted row the score is the prior of 0.5; rows that repeat are each scored;
an input column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import chunks, mix, of_rows, prefix_hash, powers, strings, trimmed, with_columns, words

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": map(ord, ".,;:'\"-()?"), "shout": map(ord, "!"), "bar": map(ord, "|"), "sign": map(ord, "#$%&*+/<=>@[\\]^_`{}~"), "wide": range(128, 256),
}
_CLASS = np.zeros(256, np.int64)
for _i, _of in enumerate(_CLASSES.values()):
    _CLASS[list(_of)] = _i + 1
MEASURES = [*_CLASSES, "log_bytes", "word_length", "same_word", "new_words", "new_pairs", "new_lines", "upper_first", "odd_end", "longest_word", "words_a_line"]
BINS = 10


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each row has."""
    k = keys ^ mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(k)
    k = k[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    return np.bincount(rows[order][first], minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    k = len(_CLASSES) + 1
    by_class = np.bincount(row * k + _CLASS[data], minlength=n * k).reshape(n, k)[:, 1:]
    ratio = lambda a, b: a / np.maximum(b, 1)
    s, e, h = words(data, offsets)
    of = of_rows(offsets, s)
    count = np.bincount(of, minlength=n)
    together = of[1:] == of[:-1]
    repeated = np.bincount(of[1:][together & (h[1:] == h[:-1])], minlength=n)
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[together]
    at = np.flatnonzero((data == 10) | (np.arange(len(data)) + 1 == np.repeat(offsets[1:], size))) + 1
    begin = np.concatenate([[0], at[:-1]]) if len(at) else at
    p = prefix_hash(data)
    line = (p[at] - p[begin]) * powers(len(data) + 1)[1][begin]
    of_line = of_rows(offsets, begin) if len(at) else at
    lines = np.bincount(of_line, minlength=n)
    first = np.bincount(of[(data[s] >= 65) & (data[s] < 91)], minlength=n) if len(s) else np.zeros(n)
    odd = np.bincount(of[np.isin(_CLASS[data[e - 1]], (7, 8, 9))], minlength=n) if len(s) else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, e - s)
    pairs = np.bincount(of[1:][together], minlength=n)
    rest = [np.log1p(size), ratio(np.bincount(of, e - s, minlength=n), count), ratio(repeated, count), ratio(_distinct(of, h, n), count), ratio(_distinct(of[1:][together], pair, n), pairs), ratio(_distinct(of_line, line, n), lines), ratio(first, count), ratio(odd, count), np.log1p(longest), np.log1p(ratio(count, lines))]
    return np.concatenate([ratio(by_class, size[:, None]), np.stack(rest, 1)], 1).astype(np.float32)


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray
    weights: np.ndarray
    prior: float


def _design(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One-hot bins of each measure, and 1."""
    out = np.ones((len(x), x.shape[1] * BINS + 1), np.float32)
    for j in range(x.shape[1]):
        out[:, j * BINS : (j + 1) * BINS] = np.searchsorted(cuts[j], x[:, j], "left")[:, None] == np.arange(BINS)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, ridge: float | None = None) -> np.ndarray:
    """Adam on the non-negative risk: while its negative part is below 0, that part alone is raised."""
    ridge = 1e-4 if ridge is None else ridge
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        fp, fu = p @ w.astype(np.float32), u @ w.astype(np.float32)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        of_negative = _sigmoid(fu) @ u / len(u) - prior * (_sigmoid(fp) @ p) / len(p)
        g = -of_negative if negative < 0 else of_negative - prior * (_sigmoid(-fp) @ p) / len(p)
        g = g + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _firsts(p: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
    """A first model of either half of the rows."""
    return [_minimise(x, y, 0.5, steps=150, ridge=1e-2).astype(np.float32) for x, y in zip(p, u, strict=True)]


def class_prior(mass_p: np.ndarray, mass_u: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass, over regions above a score."""
    return float(min(1.0, np.min(mass_u / mass_p)))


def _cells(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.maximum(x, 0), np.float32).view(np.uint32) >> 16


def _edge(cell: np.ndarray) -> np.ndarray:
    """The largest number of a cell."""
    return ((cell.astype(np.uint32) << 16) | 0xFFFF).view(np.float32).astype(float)


def cuts_of(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BINS - 1 cuts of a measure from the counts of its cells; a measure that has one value for most gets them where it hasn't."""
    order = np.argsort(cells)
    cells, total = cells[order], np.cumsum(n[order])
    pick = lambda shares, below: _edge(cells[np.minimum(np.searchsorted(total, below + shares * (total[-1] - below)), len(cells) - 1)])
    cuts = pick(np.linspace(0, 1, BINS + 1)[1:-1], 0)
    if cuts[-1] == cuts[0] and (at := np.searchsorted(_edge(cells), cuts[0], "right")) < len(cells):
        cuts[1:] = pick(np.linspace(0, 1, BINS)[1:-1], total[at - 1] if at else 0)
    return np.maximum.accumulate(cuts)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """measure, cell and the number of this task's documents in it."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for _, _, part, at in chunks(data, offsets):
            for j, cells in enumerate(_cells(measures(part, at)).T):
                found[j] = found.get(j, np.zeros(1 << 16, np.int64)) + np.bincount(cells, minlength=1 << 16)
    for j, n in found.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), j, np.int32)), pa.array(some, pa.int32()), pa.array(n[some])], names=["measure", "cell", "n"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for lo, hi, part, at in chunks(data, offsets):
            x = measures(part, at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("positive", "sampled", "half")), pa.array([r.tobytes() for r in x], pa.binary())], names=["positive", "sampled", "half", "x"])


def fit(docs: DataFrame, trusted: DataFrame, positives: int = 5000, unlabelled: int = 10000) -> Model:
    """trusted: the doc_ids of trusted positives. Both samples are chosen by a hash of the id, of copies of a text one each."""
    chosen = trusted.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("trusted")), "doc_id").limit(positives)
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(text.alias("text")).mapInArrow(trimmed(_histograms), "measure int, cell int, n long").groupBy("measure", "cell").agg(F.sum("n").alias("n")).toArrow()  # some thousand cells a measure
    measure, cell, n = (counted.column(c).to_numpy() for c in ("measure", "cell", "n"))
    nothing = Model(np.zeros((len(MEASURES), BINS - 1)), np.zeros(len(MEASURES) * BINS + 1), 0.5)
    if not len(n):
        return nothing
    total = int(n[measure == 0].sum())
    cuts = np.stack([cuts_of(cell[measure == j], n[measure == j]) for j in range(len(MEASURES))])

    id_hash = lambda salt: F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(salt))
    half = F.pmod(id_hash("half"), F.lit(2)).cast("int")
    sampled = F.pmod(id_hash("unlabelled"), F.lit(1_000_000)) < int(1_000_000 * min(1, unlabelled / total))
    rows = docs.select("doc_id", text.alias("text"), sampled.alias("sampled"), half.alias("half"))
    rows = rows.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "doc_id", "left")  # at most ``positives`` ids
    rows = rows.withColumn("positive", F.coalesce("positive", F.lit(False))).filter("positive or sampled").dropDuplicates(["doc_id", "text"])
    some = rows.select("text", "positive", "sampled", "half").mapInArrow(trimmed(_describe), "positive boolean, sampled boolean, half int, x binary").toArrow()
    x = np.stack([np.frombuffer(v, np.float32) for v in some.column("x").to_pylist()]) if some.num_rows else np.zeros((0, len(MEASURES)), np.float32)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # the same at any partitioning
    mark = lambda c: np.array(some.column(c).to_pylist())[order]
    x = x[order]
    positive, taken, side = (mark(c) for c in ("positive", "sampled", "half")) if len(x) else (np.zeros(0, bool),) * 3
    if not positive.any() or not taken.any():
        return nothing
    d = _design(x, cuts)
    p, u = d[positive], d[taken]
    halves = lambda which: [d[which & (side == h)] for h in (0, 1)]
    prior = 0.5
    if all(len(y) for y in (*halves(positive), *halves(taken))):
        first = _firsts(halves(positive), halves(taken))
        prior = float(np.clip(np.mean(_priors(docs, text, half, first, cuts, halves(positive))), 0.05, 0.98))
    return Model(cuts, _minimise(p, u, prior), prior)


def _priors(docs: DataFrame, text, half, first: list[np.ndarray], cuts: np.ndarray, positives: list[np.ndarray]) -> list[float]:
    """For each half's first model the prior that the other half of the documents, all of them, and of the positives shows."""
    scores = [np.sort(positives[1 - h] @ first[h])[::-1] for h in (0, 1)]
    levels = [s[np.minimum((np.linspace(0.2, 0.97, 40) * len(s)).astype(int), len(s) - 1)] for s in scores]

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 41), np.int64)
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            side = batch.column("half").to_numpy()
            for lo, hi, part, at in chunks(data, offsets):
                d = _design(measures(part, at), cuts)
                for h in (0, 1):
                    f = np.sort(d[side[lo:hi] == 1 - h] @ first[h])
                    out[h, :40] += len(f) - np.searchsorted(f, levels[h], "left")
                    out[h, 40] += len(f)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(82), pa.int32()), pa.array(out.ravel())], names=["k", "n"])

    total = np.zeros(82)
    for r in docs.select(text.alias("text"), half.alias("half")).mapInArrow(trimmed(above), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # 82 numbers
        total[r.k] = r.n
    found = []
    for h, counts in enumerate(total.reshape(2, 41)):
        if counts[40] and len(scores[h]):
            mass_p = (scores[h][None] >= levels[h][:, None]).mean(1)
            found.append(class_prior(mass_p, counts[:40] / counts[40]))
    return found or [1.0]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all of docs), then quality_score: the estimated chance of good quality."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for lo, hi, part, at in chunks(data, offsets, rows=4096):
                out[lo:hi] = _sigmoid(_design(measures(part, at), model.cuts) @ model.weights)
            yield with_columns(batch, keep, {"quality_score": pa.array(out)})

    return docs.mapInArrow(trimmed(run), T.StructType([docs.schema[c] for c in keep] + [T.StructField("quality_score", T.DoubleType())]))
