"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. ``trigram_query`` derives from it a Boolean query in disjunctive
form: alternatives, each a set of trigrams that a matching text must all hold (over A-Z folded to a-z). The
inverted index keeps, for each trigram that some rule names, the postings (doc_id). A rule's
alternatives intersect their postings, and only candidate texts are verified by the rule's expression;
a rule from which no mandatory trigram follows scans all texts.

Defined results: null text counts as empty; a null doc_id is a row like any other; rows that repeat are
each reported; other columns are kept, but for one that is named like the result, which find_secrets replaces. redact
changes no column but text. The result has one row per input row.

Places are running sums of the lengths of what stands between and in the matches, so long texts with many
matches cost n log n.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre  # the parser's opcodes
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.native import blocks, let, maxima, part, sums
from gridloom.llm.shared import unused


@dataclass(frozen=True)
class Rule:
    """kind, expression (Java and Python syntax), and which group must have how many characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values of the contract, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 characters: a match is a maximal run
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # likewise
)

MOST_STRINGS = 64


def _and(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    out = {x | y for x in a for y in b}
    return [x for x in out if not any(y < x for y in out)]


def _grams(strings: set[str]) -> list[frozenset]:
    """Some string of the set occurs: alternatives of mandatory trigrams."""
    out = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [x for x in out if not any(y < x for y in out)]


def trigram_query(pattern: str) -> list[frozenset]:
    """Alternatives of mandatory trigrams; an empty alternative makes every text a candidate."""
    must, exact = _sequence(parser.parse(pattern))
    return must if exact is None else _and(must, _grams(exact))


def _sequence(tokens) -> tuple[list[frozenset], set[str] | None]:
    """What must hold, and all strings that can be matched where they are few."""
    must, exact, whole = [frozenset()], {""}, True
    for op, arg in tokens:
        also, strings = _token(op, arg)
        must = _and(must, also)
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            must = _and(must, _grams(exact))
            must = must if strings is None else _and(must, _grams(strings))
            exact, whole = {""}, False
    return (must, exact) if whole else (_and(must, _grams(exact)), None)


def _token(op, arg) -> tuple[list[frozenset], set[str] | None]:
    nothing = [frozenset()]
    if op is sre.LITERAL:
        return nothing, {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return nothing, {chr(c).lower() for _, c in arg}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return nothing, {""}
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(x is not None for _, x in parts):
            return nothing, set().union(*(x for _, x in parts))
        return list({q for m, x in parts for q in (m if x is None else _and(m, _grams(x)))}), None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        m, x = _sequence(inner)
        if (low, high) == (0, 1) and x is not None:
            return nothing, x | {""}
        if low >= 1:
            return (m if x is None else _and(m, _grams(x))), None
    return nothing, None


BITS = 62


def _index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings of the trigrams that the rules name: gram (its number), doc_id."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    return low.select("doc_id", F.explode(held).alias("gram"))


def _candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, dict[str, str | None]]:
    """For doc_ids that are some rule's candidates, a flag for each rule; and the flags' names (None: scan all)."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for x in q for g in x})
    flags = {k: None if frozenset() in q else f"__may_{k}" for k, q in queries.items()}
    if not any(flags.values()):
        return None, flags
    word = lambda i: f"__held{i // BITS}"
    bit = lambda i: 1 << i % BITS
    bits = [
        F.bit_or(F.when((F.col("gram") >= w) & (F.col("gram") < w + BITS), F.expr(f"shiftleft(1L, gram - {w})")).otherwise(F.lit(0))).alias(word(w))
        for w in range(0, len(grams), BITS)
    ]
    held = _index(docs, grams).groupBy("doc_id").agg(*bits)  # a document's postings meet here

    def all_of(alternative: frozenset) -> Column:
        wanted: dict[str, int] = {}
        for g in alternative:
            wanted[word(grams.index(g))] = wanted.get(word(grams.index(g)), 0) | bit(grams.index(g))
        out = F.lit(True)
        for name, mask in wanted.items():
            out = out & (F.col(name).bitwiseAND(F.lit(mask)) == F.lit(mask))
        return out

    def any_of(query: list[frozenset]) -> Column:
        out = F.lit(False)
        for alternative in query:
            out = out | all_of(alternative)
        return out

    found = held.select(F.col("doc_id").alias("__doc"), *(any_of(queries[k]).alias(f) for k, f in flags.items() if f))
    some = F.lit(False)
    for f in flags.values():
        some = some | F.col(f) if f else some
    return found.filter(some), flags


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(rule: Rule, number: int) -> Column:
    """The rule's matches in ``__text``: array of (start, kind number, end) in code points, failing ones dropped."""
    text, pattern = F.col("__text"), F.lit(rule.pattern)
    sizes = lambda strings: F.transform(strings, F.length)
    gaps = sizes(F.split(text, rule.pattern, -1))
    whole = lambda group: sizes(F.regexp_extract_all(text, pattern, F.lit(group)))

    def spans(m: Column) -> Column:
        ends = sums(F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["whole"])), m["whole"], lambda g, w: g + w))
        every = F.transform(ends, lambda e, i: F.struct((e - F.get(m["whole"], i)).alias("start"), F.lit(number).alias("kind"), e.alias("end"), F.get(m["part"], i).alias("n")))
        kept = F.filter(every, lambda x: x["n"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    found = let(F.struct(gaps.alias("gaps"), whole(0).alias("whole"), whole(rule.group).alias("part")), spans)
    return F.when(F.rlike(text, pattern), found.cast(SPANS)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """docs and ``into``: array of (start, kind number, end) by start, then kind as listed in rules."""
    docs = docs.drop(into)
    names = docs.columns
    candidates, flags = _candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)
    rows = docs if candidates is None else docs.join(candidates, docs["doc_id"].eqNullSafe(candidates["__doc"]), "left")
    rows = rows.withColumn("__text", F.coalesce("text", F.lit("")))
    none = F.expr(f"cast(array() as {SPANS})")
    each = [_spans(r, i) if flags[r.kind] is None else F.when(F.col(flags[r.kind]), _spans(r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select(*(F.col(f"`{c}`") for c in names), F.array_sort(F.concat(*each)).alias(into))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced; the columns stay the same."""
    into = unused(docs.columns, "secret_spans")
    spans = F.col(into)
    reach = maxima(F.transform(spans, lambda x: x["end"]))

    def cut(m: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(m["reach"], i - 1)).otherwise(F.lit(0))
        parts = F.transform(spans, lambda x, i: F.when(x["start"] >= before(i), F.concat(part(m["cut"], before(i), x["start"]), F.lit(by))).otherwise(""))
        return F.concat(F.array_join(parts, ""), part(m["cut"], F.element_at(m["reach"], -1), F.length("text")))

    clean = let(F.struct(blocks(F.col("text")).alias("cut"), reach.alias("reach")), cut)
    found = find_secrets(docs, rules, into)
    return found.withColumn("text", F.when(F.size(into) > 0, clean).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))
