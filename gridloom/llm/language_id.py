"""Language identification by nearest centroid.

A text becomes counts of hashed byte trigrams of its letters, weighted by TF-IDF and scaled to unit
length. Each language keeps several centroids, found by spherical k-means; a text gets the language of
the centroid nearest by cosine. Texts farther from every centroid than the calibrated distance are
rejected if they have at least EVIDENCE bytes, and so are all texts without a letter (``und``).

Document frequencies cover all learning documents. The clustering alone is fitted on about ``sample`` different
texts among them, spread evenly over languages (40 a language at least), chosen by a hash of the text.

Defined results: null or letterless text is ``und`` with score 0; rows with null lang or null doc_id are
scored but not learnt from; without any learning row all texts are ``und``; ties go to the language first by name;
repeated texts weigh as one in the clustering; an input column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.shared import chunks, mix, strings, trimmed, with_columns

DIM = 4096
ROWS = 128
#: Shorter texts, in bytes, are too little to be called far from all languages.
EVIDENCE = 40
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    names: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    least: float


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by DIM: counts of hashed byte trigrams that hold a letter."""
    rows = len(offsets) - 1
    low = _LETTER[data].astype(np.uint64)
    if len(low) < 3:
        return np.zeros((rows, DIM), np.float32)
    gram = low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    good = (row[:-2] == row[2:]) & (gram != 0x202020)
    place = row[:-2][good] * DIM + (mix(gram[good]) % np.uint64(DIM)).astype(np.int64)
    return np.bincount(place, minlength=rows * DIM).reshape(rows, DIM).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(count) * idf)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIM + 1, np.int64), 0
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for lo, hi, part, at in chunks(data, offsets, rows=ROWS):
            total[:DIM] += (counts(part, at) > 0).sum(0)
            n += hi - lo
    total[DIM] = n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(total)], names=["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for lo, hi, part, at in chunks(data, offsets, rows=ROWS):
            x = counts(part, at)
            places = [np.flatnonzero(r) for r in x]
            packed = [pa.array([v.tobytes() for v in column], pa.binary()) for column in ((p.astype(np.uint16) for p in places), (r[p] for r, p in zip(x, places, strict=True)))]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), *packed], names=["lang", "place", "n"])


def _dense(place: bytes, n: bytes) -> np.ndarray:
    out = np.zeros(DIM, np.float32)
    out[np.frombuffer(place, np.uint16)] = np.frombuffer(n, np.float32)
    return out


#: So many languages are fitted at once; further ones in further groups.
LANGUAGES = 100


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, from points chosen farthest first."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[nearest == i].mean(0) if (nearest == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def fit(docs: DataFrame, learn: Column, clusters: int = 3, sample: int = 2400) -> Model:
    """Learns from text and lang of the documents that ``learn`` picks."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = rows.select("text").mapInArrow(trimmed(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for r in found:  # DIM + 1 rows at any size
        df[r.feature] = r.n
    texts = rows.select("lang", "text", F.xxhash64("text", F.lit("language sample")).alias("h"))
    sizes = {r.lang: r.n for r in texts.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # a row a language
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])).astype(np.float32) + 1
    names = sorted(sizes)
    if not names:
        return Model(idf, [], np.zeros((0, DIM), np.float32), np.zeros(0, int), 0.0)
    each = max(40, sample // len(names))
    hashed = F.pmod("h", F.lit(1_000_000))
    centres, owner, nearest = [], [], [1.0]
    for first in range(0, len(names), LANGUAGES):
        group = names[first : first + LANGUAGES]
        share = F.create_map(*(F.lit(v) for k in group for v in (k, each / sizes[k])))
        # Different texts, about ``each`` a language, so about LANGUAGES * each sparse vectors come together.
        some = texts.filter(hashed < share[F.col("lang")] * 1_000_000).dropDuplicates(["lang", "h"]).mapInArrow(trimmed(_vectors), "lang string, place binary, n binary").toArrow()
        langs = np.array(some.column("lang").to_pylist(), object)
        x = weighted(np.stack([_dense(*v) for v in zip(some.column("place").to_pylist(), some.column("n").to_pylist(), strict=True)]), idf) if len(langs) else np.zeros((0, DIM), np.float32)
        order = np.lexsort((x @ np.arange(1, DIM + 1, dtype=np.float32), langs.astype(str))) if len(langs) else np.zeros(0, int)  # the same at any partitioning
        langs, x = langs[order], x[order]
        full = x.any(1) if len(x) else np.zeros(0, bool)
        for i, name in enumerate(group, first):
            own = x[(langs == name) & full] if len(langs) else x
            if len(own):
                c = _clusters(own, clusters)
                centres.append(c)
                owner += [i] * len(c)
                nearest.append(float((own @ c.T).max(1).min()))
    return Model(idf, names, np.concatenate(centres) if centres else np.zeros((0, DIM), np.float32), np.array(owner, int), min(nearest) / 2)


def detect(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all of docs), then lang_pred, lang_score and lang_rejected."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score", "lang_rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.names, "und"], object)
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            pred, score, enough = np.full(batch.num_rows, len(model.names)), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for lo, hi, part, at in chunks(data, offsets, rows=ROWS):
                ascii_letter = (_LETTER[part] != 32) & (part < 128)
                seen = np.concatenate([[0], np.cumsum(ascii_letter)])
                has = seen[at[1:]] > seen[at[:-1]]
                for i in np.flatnonzero(~has & (np.diff(at) > 0)):
                    has[i] = any(c.isalpha() for c in part[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
                if len(model.owner) and has.any():
                    near = weighted(counts(part, at), model.idf) @ model.centroids.T
                    best = near.argmax(1)
                    pred[lo:hi] = np.where(has, model.owner[best], len(model.names))
                    enough[lo:hi] = np.diff(at) >= EVIDENCE
                    score[lo:hi] = np.where(has, np.clip(near.max(1), 0, 1), 0)
            yield with_columns(batch, keep, {"lang_pred": pa.array(names[pred].tolist(), pa.string()), "lang_score": pa.array(score), "lang_rejected": pa.array((pred == len(model.names)) | enough & (score < model.least))})

    fields = [docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    return docs.mapInArrow(trimmed(run), T.StructType(fields))
