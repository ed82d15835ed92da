"""Benchmark decontamination over canonical templates, in DataFrame operations only.

Texts become tokens, words and numbers, and each window of tokens is read in two ways. In the plain reading numbers
and units (after a number) are typed placeholders and words are lower-cased. In the other, capitalised words are
placeholders for names as well. What stands before a word makes no difference, so quotation marks, line breaks and
beginnings of sentences don't hide a match. Windows of WINDOW tokens are hash-joined with those of the benchmark; an
item with fewer tokens gives one window of its own length.

A matched window counts if its slots hold the item's own values, or if all windows of its run (the same reading and
alignment) are consistent: equal values of the item stand for equal values in the document. So a copied question is
found even when its numbers, names or units were changed.

A document is contaminated by an item when half of the item's windows match, or ``many`` of them.

Documents are cut into chunks of CHUNK tokens and what a window needs beyond, so a place never carries more than its
chunk along. Up to BROADCAST_WINDOWS windows of the benchmark go to every task; more of them are joined by shuffling narrow
rows (document, place, hash), and only documents that were hit are read again for their slots.

Defined results: null text counts as empty and matches nothing; each row is judged by its own text, and contaminated()
reports for a doc_id the most windows of any of its rows (rows without a doc_id report as one); clean() drops the
contaminated rows alone; items without an item_id or any token, and windows of fewer than LITERAL plain words (unless
the item has no other), match nothing; repeated items count once; equal items are reported under each item_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.native import let
from gridloom.llm.shared import Scratch

WINDOW = 8
CHUNK = 32
LITERAL = 3
#: Benchmark windows up to this count are broadcast (about 100 bytes each); beyond it narrow rows are shuffled.
BROADCAST_WINDOWS = 200_000
TOKEN = r"[0-9]+(?:[.,:/-][0-9]+)*%?|\p{L}+(?:['’-]\p{L}+)*"
UNITS = tuple("kg g mg km m cm mm mi ft in lb oz l ml h min s ms hours hour minutes minute seconds second days day weeks week months month years year meters metres kilometers kilometres miles grams kilograms pounds dollars euros cents degrees percent".split())
#: Kinds of tokens: words, and what may be placeholders.
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
PLAIN, NAMES = 0, 1


SLOTS = "array<struct<c:int,v:bigint>>"


def templates(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns named and t: array of (v: hash of a token's value, k: its kind)."""
    rows = texts.select(*keep, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("raw"))
    number = lambda x: x < ":"  # noqa: E731  a token begins with a digit or a letter

    def token(x: Column, i: Column) -> Column:
        low = F.lower(x)
        unit = F.coalesce(number(F.get("raw", i - 1)), F.lit(False)) & low.isin(*UNITS)
        kind = F.when(number(x), NUMBER).when(unit, UNIT).when((low != x) & (F.length(x) > 1), NAME).otherwise(WORD)
        return F.struct(F.xxhash64(low).alias("v"), kind.alias("k"))

    return rows.select(*keep, F.transform("raw", token).alias("t"))


def _places(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, base, at (a place in the chunk), v and k of the chunk: a row for each token."""
    cut = let(F.col("t"), lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(CHUNK)), lambda b: F.struct(b.alias("base"), F.slice(t, b + 1, F.lit(CHUNK + WINDOW - 1)).alias("t")))))
    chunks = rows.select(*keep, F.explode_outer(cut).alias("c")).filter("c is not null")  # outer: else Spark filters on a copy of what makes the array
    chunks = chunks.select(*keep, F.col("c.base").alias("base"), F.col("c.t.v").alias("v"), F.col("c.t.k").alias("k"))
    return chunks.select(*keep, "base", "v", "k", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.size("k")) - 1)).alias("at"))


def _window(size: int, reading: int) -> Column:
    """The hash of so many tokens from a place on; null beyond the end, and in the reading with names where there is none."""
    v, k = ([F.get(c, F.col("at") + i) for i in range(size)] for c in ("v", "k"))
    fits = F.col("at") + size <= F.size("k")
    slot = (NUMBER, UNIT) if reading == PLAIN else (NUMBER, UNIT, NAME)
    tokens = [F.when(kind.isin(*slot), kind.cast("long")).otherwise(value) for value, kind in zip(v, k, strict=True)]
    if reading == NAMES:
        some = F.lit(False)
        for kind in k:
            some = some | (kind == NAME)
        fits = fits & some
    return F.when(fits, F.xxhash64(*tokens, F.lit(size), F.lit(reading)))


def _slots(v: Column, k: Column, at: Column, size: Column, reading: Column) -> Column:
    """(kind, value) of the placeholders among ``size`` tokens from a place on."""

    def slot(i: Column) -> Column:
        kind = F.get(k, at + i)
        return F.when((kind != WORD) & ((kind != NAME) | (reading == NAMES)), F.struct(kind.alias("c"), F.get(v, at + i).alias("v")))

    return F.array_compact(F.transform(F.sequence(F.lit(0), size - 1), slot)).cast(SLOTS)


def _every(sizes: list[int]) -> list[tuple[int, int]]:
    return [(size, reading) for size in sizes for reading in (PLAIN, NAMES)]


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_pos, reading, size, w and item_slots of each window."""
    rows = templates(benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text").distinct(), "item_id")
    rows = rows.withColumn("whole", F.least(F.lit(WINDOW), F.size("t")))
    sizes = sorted(r.whole for r in rows.select("whole").distinct().collect()) or [WINDOW]  # at most WINDOW numbers
    windows = F.array(*(F.struct(F.lit(r).alias("reading"), F.lit(n).alias("size"), _window(n, r).alias("w")) for n, r in _every(sizes)))
    made = _places(rows, "item_id", "whole").withColumn("windows", windows).select("*", F.explode("windows").alias("x")).select("*", "x.reading", "x.size", "x.w").filter("size = whole and w is not null")
    made = made.withColumn("slots", _slots(F.col("v"), F.col("k"), F.col("at"), F.col("size"), F.col("reading")))
    made = made.withColumn("plain", F.col("size") - F.size("slots"))
    made = made.withColumn("most", F.max("plain").over(Window.partitionBy("item_id", "reading")))
    made = made.filter((F.col("plain") >= F.least(F.lit(LITERAL), "most", "size")) & (F.col("plain") > 0))
    return made.select("item_id", (F.col("base") + F.col("at")).alias("item_pos"), "reading", "size", "w", F.col("slots").alias("item_slots"))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th, item_id, item_pos, reading, pos, item_slots and slots of each window that a document shares with an item."""
    sizes = sorted(r.n for r in items.select(F.col("size").alias("n")).distinct().collect()) or [WINDOW]  # at most WINDOW numbers
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    hit = F.struct("reading", "size", "item_id", "item_pos", "item_slots")
    small = items.count() <= BROADCAST_WINDOWS
    places = _places(templates(texts, "doc_id", "th"), "doc_id", "th")
    if small:
        # The hashes first, by generated code, then a row for each.
        found = places.select("*", *(_window(n, r).alias(f"w_{n}_{r}") for n, r in _every(sizes)))
        found = found.select("doc_id", "th", "base", "at", "v", "k", F.explode_outer(F.array(*(f"w_{n}_{r}" for n, r in _every(sizes)))).alias("w")).filter("w is not null")
        found = found.join(F.broadcast(items), "w").withColumn("pos", F.col("base") + F.col("at"))
        return found.select("doc_id", "th", "item_id", "item_pos", "reading", "pos", "item_slots", _slots(F.col("v"), F.col("k"), F.col("at"), F.col("size"), F.col("reading")).alias("slots"))
    windows = places.select("doc_id", "th", (F.col("base") + F.col("at")).alias("pos"), *(_window(n, r).alias(f"w_{n}_{r}") for n, r in _every(sizes)))
    windows = windows.select("doc_id", "th", "pos", F.explode_outer(F.array(*(f"w_{n}_{r}" for n, r in _every(sizes)))).alias("w")).filter("w is not null")
    found = windows.join(items, "w").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", hit.alias("hit"))).alias("hits"))
    found = found.select(F.col("doc_id").alias("hit_doc"), F.col("th").alias("hit_th"), "hits")
    again = texts.join(found, texts["doc_id"].eqNullSafe(found["hit_doc"]) & (texts["th"] == found["hit_th"]))
    rows = templates(again, "doc_id", "th", "hits")
    filled = let(F.col("t"), lambda t: F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), h["hit"].alias("hit"), _slots(t["v"], t["k"], h["pos"], h["hit"]["size"], h["hit"]["reading"]).alias("slots"))))
    rows = rows.select("doc_id", "th", F.explode_outer(filled).alias("x"))
    return rows.select("doc_id", "th", "x.hit.item_id", "x.hit.item_pos", "x.hit.reading", "x.pos", "x.hit.item_slots", "x.slots")


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, many: int = 10) -> DataFrame:
    """doc_id, th (hash of text), item_id, n_windows (of the item, matched) and of_windows (the item's), for each contaminated row."""
    items = Scratch(docs.sparkSession, "benchmark").keep(_items(benchmark), "items")
    of = items.groupBy("item_id").agg(F.count_distinct("item_pos").alias("of_windows"))
    hits = _hits(docs, items)
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(x["item_slots"].alias("a"), x["slots"].alias("b")))
    own = F.when(F.to_json(F.struct("item_slots")) == F.to_json(F.struct(F.col("slots").alias("item_slots"))), F.col("item_pos"))
    hits = hits.select("doc_id", "th", "item_id", "item_pos", "reading", (F.col("pos") - F.col("item_pos")).alias("shift"), own.alias("own"), pairs.alias("pairs"))
    # One run has at most the item's own windows; both steps share one exchange of the hits.
    runs = hits.repartition("doc_id", "th", "item_id").groupBy("doc_id", "th", "item_id", "reading", "shift")
    runs = runs.agg(F.collect_set("item_pos").alias("at"), F.collect_set("own").alias("own"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    fits = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    runs = runs.select("doc_id", "th", "item_id", F.when(fits, F.col("at")).otherwise(F.col("own")).alias("at"))
    found = runs.groupBy("doc_id", "th", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"))
    found = found.join(of, "item_id")
    return found.filter((F.col("n_windows") >= share * F.col("of_windows")) | (F.col("n_windows") >= many)).select("doc_id", "th", "item_id", "n_windows", "of_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, many: int = 10) -> DataFrame:
    """doc_id, item_id, n_windows and of_windows, for each contaminated pair."""
    found = matches(docs, benchmark, share, many)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("of_windows").alias("of_windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; the columns stay the same."""
    bad = matches(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__bad"), F.col("th").alias("__th")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (text == bad["__th"]), "left_anti")
