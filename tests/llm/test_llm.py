"""The operators of llm against SQL, brute force, exact round trips and held-out rows, and on edge cases."""

import hashlib
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import chat, decontaminate, language_id, native, nearest, ngram_join, packing, quality, queries, repeats, secret_scan, toxicity
from gridloom.llm.shared import shared_dir, strings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, h long, c long, n int, pos int, secrets string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, "x") for i, t in rows], SCHEMA)


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "und", "vex", "sol", "bri") for b in ("na", "do", "se", "ti", "ro", "pel", "us", "ing")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows():
    base, other = prose(1, 120), prose(2, 60)
    words = base.split()
    rows = [(1, base), (2, base), (3, " ".join([*words[:60], "CHANGED", *words[61:]])), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "ONE"), (9, "a b c d"), (10, other), (10, other), (None, base), (None, None)]
    rows += [(11, prose(3, 20_000)), (12, base[:400] + other), (13, other + " " + other), (14, "é ö ñ 日本語 ✓ " * 3), (15, "\x85\xa0\x1c<|endoftext|></s> &amp;[INST]"), (16, "x" * 300), (17, "x" * 99), (18, "x" * 100)]
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, edge_rows()).persist()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).persist()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, duck, sf_dir, same):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


# Secrets


def test_trigram_queries():
    def grams(p):
        return {frozenset(x) for x in secret_scan.trigram_query(p)}

    assert grams("abcd") == {frozenset({"abc", "bcd"})}
    assert grams("(abc|xyz)+q?") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert grams("[0-9]+abc[a-z]*") == {frozenset({"abc"})}
    assert grams("ab?c.*") == {frozenset()} and grams("[0-9a-f]{24,}") == {frozenset()}


def by_hand(text):
    text, out = text or "", []
    kinds = ((r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "assign"), (r"AKIA[A-Z0-9]+", 0, 20, "access"), (r"[0-9a-f]+", 0, 24, "hex"))
    for k, (p, group, least, kind) in enumerate(kinds):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_secrets_by_hand(spark, none):
    rows = [(1, None), (2, ""), (1, "é token = \"abcdef\" PassWord:'x' api_key==zzzzzz APIKEY=1234567"), (None, "token=token\"=abcdefgh"), (3, "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " " + "ab0" * 9), (4, "ſecret=abcdef toKen=abcdef toKen=abcdef"), (5, "token=abcdef " * 300), (6, "0" * 23 + " " + "f" * 24 + "g" * 9)]
    got = secret_scan.find_secrets(docs_of(spark, rows)).select("text", secret_scan.spans_text(F.col("secrets")).alias("s")).collect()
    assert sorted((r.text or "", r.s) for r in got) == sorted((t or "", by_hand(t)) for _, t in rows)
    assert secret_scan.find_secrets(none).count() == 0
    clean = secret_scan.redact(docs_of(spark, rows))
    assert clean.schema == docs_of(spark, rows).schema and {r.secrets for r in clean.collect()} == {"x"}
    texts = [r.text for r in clean.collect()]
    assert None in texts and "[SECRET] " * 300 in texts
    assert all(by_hand(t) == "" for t in texts)


def test_secrets_of_long_texts(spark):
    """Tens of thousands of matches in one text: places and redaction stay linear."""
    text = "é token=abcdef, " * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secret_scan.find_secrets(docs, into="found").select(F.size("found").alias("n"), F.element_at("found", -1).alias("last")).collect()[0]
    assert (found.n, found.last.start, found.last.end) == (30_000, 16 * 29_999 + 2, 16 * 29_999 + 14)
    assert secret_scan.redact(docs).collect()[0].text == "é [SECRET], " * 30_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 65])
def test_running_sums(spark, n):
    values = np.random.default_rng(n).integers(-9, 9, n).tolist()
    got = spark.createDataFrame([(values,)], "v array<int>").select(native.sums(F.col("v")).alias("s"), native.maxima(F.col("v")).alias("m")).collect()[0]
    assert got.s == np.cumsum(values).tolist() and got.m == np.maximum.accumulate(np.array(values, int)).tolist()


# N-gram join


def brute_clusters(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in seen.get(g, ())}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for g in s:
            seen.setdefault(g, []).append(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted(((d, len(s), ids.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_ngram_join_edges(edges, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.cluster(edges).collect()), key=str)
    assert got == brute_clusters(edge_rows())
    assert ngram_join.cluster(none).count() == 0
    assert ngram_join.keep_one(edges).columns == edges.columns


def test_ngram_join_by_row(spark):
    """Links through rows without an id count; of each component one row stays, whatever ids it shares."""
    w = prose(40, 60).split()
    far = [*w[:20], "x1", "x2", *w[22:]]
    texts = {"a": " ".join(w), "bridge": " ".join([*w[:40], "y1", *w[41:]]), "b": " ".join([*far[:40], "y1", *far[41:]]), "c": prose(41, 50), "d": prose(42, 50)}
    rows = [(1, texts["a"]), (None, texts["bridge"]), (3, texts["b"])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.cluster(docs_of(spark, rows)).collect()), key=str)
    assert got == brute_clusters(rows) and {c for *_, c in got} == {1}
    rows += [(5, texts["a"]), (5, texts["c"]), (7, texts["d"]), (7, texts["d"]), (None, None), (None, ""), (None, "lonely"), (None, "lonely")]
    left = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs_of(spark, rows)).collect()), key=str)
    assert left == sorted([(1, texts["a"]), (5, texts["c"]), (7, texts["d"]), (None, None), (None, ""), (None, "lonely")], key=str)
    clash = docs_of(spark, rows).withColumn("row_key", F.lit(1)).withColumn("row", F.lit(2))
    assert ngram_join.keep_one(clash).columns == clash.columns and ngram_join.keep_one(clash).count() == 6


def test_ngram_join_chains_and_groups(spark):
    """Chains whose ends aren't similar, a group of near copies, and one passage that many texts share."""
    rows, passage = [], prose(77, 30)
    for g in range(4):
        w = prose(100 + g, 80).split()
        for k in range(12):
            rows.append((len(rows), " ".join(w)))
            w[(7 * k) % 80] = f"new{g}{k}"
    near = prose(500, 100).split()
    for k in range(60):
        w = list(near)
        for j in random.Random(k).sample(range(100), k % 4):
            w[j] = f"edit{k}"
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, f"{prose(900 + k, 25)} {passage}") for k in range(80)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.cluster(docs_of(spark, rows)).collect()), key=str)
    assert got == brute_clusters(rows)


def test_ngram_join_query(spark, sf_dir, documents):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.queries()["op2_ngram_join"](spark, sf_dir).collect()), key=str)
    assert got == brute_clusters(list(documents.itertuples(index=False, name=None)))


def test_ngram_join_counts_all_links(spark, monkeypatch):
    """n_links and join() against brute force, with components in one part and in several."""
    rows, base = [], prose(600, 90).split()
    for k in range(40):
        w = list(base)
        for j in random.Random(k).sample(range(90), k % 5):
            w[j] = f"edit{k}"
        rows.append((len(rows), " ".join(w)))
    for g in range(5):
        w = prose(650 + g, 60).split()
        for k in range(2 + g):
            rows.append((len(rows), " ".join(w)))
            w[(11 * k) % 60] = f"new{g}{k}"
    rows.append((len(rows), rows[0][1].upper()))
    sets = {i: frozenset(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    linked = lambda p, q: p != q and 4 * len(p & q) >= 3 * len(p | q)
    want = {i: sum(linked(p, q) for q in set(sets.values())) for i, p in sets.items()}
    docs = docs_of(spark, rows)
    assert {r.doc_id: r.n_links for r in ngram_join.cluster(docs).collect()} == want
    monkeypatch.setattr(ngram_join, "GROUP", 7)
    members, links, _ = ngram_join.join(docs)
    of = {r.c: sets[r.doc_id] for r in members.collect()}
    got = [(frozenset((r.a, r.b)), r.overlap) for r in links.collect()]
    assert dict(got) == {frozenset((a, b)): len(of[a] & of[b]) for a in of for b in of if linked(of[a], of[b])} and len(dict(got)) == len(got)


# Chat


def test_chat_parts_and_round_trip(spark):
    part = T._parse_datatype_string(f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = [(1, 1, "user", [("text", "see [END] &lt; <image>", None, None), ("image", None, "s3://a", None), ("audio", None, "b", 7), ("text", None, None, None)]), (1, 2, "assistant", [("text", "[TURN]ok</s>", None, None)]), (1, None, None, []), (2, 0, "assistant", [("document", None, None, None)])]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, part)).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("user", "see [END] &lt; <image><image><audio>"), ("assistant", "[TURN]ok</s>")]
    assert got[1].loss == "[TURN]ok</s>"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(1, "image", "s3://a", 256), (1, "audio", "b", 7)]
    a = got[1].attachments[0]
    assert got[1].formatted[a.place :].startswith("see")
    assert [x.tokens for x in got[2].attachments] == [512]
    assert chat.format_chats(spark.createDataFrame([], part)).count() == 0


def test_chat_ties_and_long_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "<b"), (1, 0, "user", "(a"), (1, 0, "user", "<b")] + [(2, i, "assistant", f"[{i}] " * 20) for i in range(3000)]
    docs = spark.createDataFrame(turns, kind).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    made = chat.format_chats(docs).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("mask")).alias("loss"))
    got = {r.conv_id: r for r in made.collect()}
    assert [t.text for t in got[1].turns] == ["(a", "<b", "<b"]
    assert got[2].loss == "".join(f"[{i}] " * 20 for i in range(3000)) and len(got[2].turns) == 3000


# Language


def test_language_query(spark, sf_dir):
    got = queries.queries()["op4_language_id"](spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    out = got[got.held_out]
    assert set(out.doc_id) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 4 == 2}
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(edges, none):
    model = language_id.fit(edges, F.lit(True))
    got = {(r.doc_id, r.text): r for r in language_id.detect(edges, model).collect()}
    assert got[4, None].lang_pred == got[5, ""].lang_pred == got[6, "  \t\n "].lang_pred == "und" and got[4, None].lang_rejected
    assert got[14, "é ö ñ 日本語 ✓ " * 3].lang_pred == "en" and len(got) == 20
    empty = language_id.fit(none, F.lit(True))
    assert {r.lang_pred for r in language_id.detect(edges, empty).collect()} == {"und"}
    assert language_id.detect(none, model).count() == 0


def test_more_than_a_thousand_languages(spark):
    """Each language is learnt, the rarest too."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q " * 8, f"l{i:04d}") for i in range(1010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    model = language_id.fit(docs, F.lit(True))
    assert model.names == [r[2] for r in rows] and set(model.owner) == set(range(1010))
    got = {r.lang: r.lang_pred for r in language_id.detect(docs.filter("doc_id >= 1000"), model).collect()}
    assert got == {r[2]: r[2] for r in rows[1000:]}


# Packing


def test_packing_query(spark, sf_dir, documents):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = queries.queries()["op5_packing"](spark, sf_dir).toPandas()
    by = dict(tuple(got.sort_values("piece").groupby("doc_id")))
    for d, t in documents.itertuples(index=False, name=None):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        p = by[d]
        assert p.length.sum() == len(ids) and (p.length.iloc[1:] == 1024).all() and (p.piece.tolist() == list(range(len(p)))) and (len(p) == -(-len(ids) // 1024))
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(p.start, p.length, strict=True)] == p.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1


def test_fast_encoder_is_exact():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    encode = packing.encoder(*files)
    r = random.Random(0)
    common = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0x250)]]
    texts = ["".join(r.choice(common) for _ in range(200)) for _ in range(200)] + [t or "" for _, t in edge_rows()] + ["  a\n\n b\t c  ", "don't we'll", "１２ ½ ² x y"]
    for t in texts:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids
    special = "a <|endoftext|> b"
    assert 50256 in encode(special) and encode(special).tolist() == exact.encode(special, add_special_tokens=False).ids
    exact.encode_special_tokens = True
    assert packing.encoder(*files, special=False)(special).tolist() == exact.encode(special, add_special_tokens=False).ids


def test_fullest_combinations():
    """The subset-sum bitset against all combinations."""
    r = random.Random(8)
    for _ in range(200):
        left = {n: r.randint(0, 3) for n in r.sample(range(1, 40), r.randint(0, 6))}
        room = r.randint(0, 60)
        sums = {0}
        for n, copies in left.items():
            sums = {s + n * k for s in sums for k in range(copies + 1) if s + n * k <= room}
        got = packing._fullest(left, room)
        assert sum(n * k for n, k in got) == max(sums) and all(0 < k <= left[n] for n, k in got)


def test_packing_edges_and_plan(spark, edges, none):
    import public_tokenizers as P

    files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    made = packing.pieces(edges, *files).persist()
    got = packing.pack(made).toPandas()
    assert len(got) == made.count() and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got[got.doc_id == 5].length.tolist() == [1] and (got.doc_id == 10).sum() == 2
    assert packing.pack(packing.pieces(none, *files)).count() == 0
    assert sum(1 for *_, o in packing.plan({600: 3, 424: 3}) if o == 0) == 1  # each bin full, as one kind
    r = random.Random(5)
    counts = {n: r.randint(1, 9) for n in r.sample(range(1, 1025), 200)}
    bins = {}
    for length, first, sequence, copies, _ in packing.plan(counts):
        times = (min([f for n, f, *_ in packing.plan(counts) if n == length and f > first], default=counts[length]) - first) // copies
        for t in range(times):
            bins[sequence + t] = bins.get(sequence + t, 0) + copies * length
    assert sum(bins.values()) == sum(n * c for n, c in counts.items()) and max(bins.values()) <= 1024


# Repeats


def brute_repeats(rows, span=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, out = {}, []
    key = lambda d: -1 if d is None else d
    for i in order:
        b = (rows[i][1] or "").encode()
        for s in range(len(b) - span + 1):
            x = b[s : s + span]
            first[x] = min(first.get(x, (1 << 60, 0)), (key(rows[i][0]), s))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first[b[s : s + span]] < (key(d), s):
                gone[s : s + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    r, rows = random.Random(9), []
    pool = [prose(300 + i, 40) for i in range(12)]
    for d in range(120):
        rows.append((r.randrange(10_000), " ".join(r.choice(pool)[r.randrange(60) :][: r.randrange(40, 260)] if r.random() < 0.6 else prose(r.random(), 15) for _ in range(r.randrange(1, 8)))))
    return [*rows, (20_000, "ab" * 400), (20_001, "ab" * 60), (20_002, pool[0] * 3), *[(30_000 + i, pool[1]) for i in range(30)]]


@pytest.mark.parametrize("rows", [edge_rows(), repeat_rows()], ids=["edges", "repeats"])
def test_repeats_by_hand(spark, rows):
    got = repeats.remove_repeats(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows)


def shared_line_rows():
    """A passage of 70 bytes in all texts, between ever different words, and a whole repeated one in some."""
    line, whole = "All rights reserved; see the licence for what may be done with this ab", prose(77, 30)
    return [(d, f"{prose(d, 30)} {line} {prose(d + 1000, 30)}" + f" {whole}" * (d % 7 == 0)) for d in range(150)]


@pytest.mark.parametrize("rows", [edge_rows(), repeat_rows(), shared_line_rows()], ids=["edges", "repeats", "line"])
@pytest.mark.parametrize("hot_bytes", [0, 20_000])
def test_repeats_with_parts_dealt_anew(spark, rows, hot_bytes):
    """Parts that are too large go on to longer grams and then to whole strings; the result stays the same."""
    docs = docs_of(spark, rows)
    keyed = repeats.keyed(docs).select("doc", "th", "text")
    levels = repeats._levels(keyed, 1, 100, hot_bytes)
    assert [level.gram for level in levels] == [12, 40, 100] and all(len(level.hot) for level in levels[:-1])
    got = repeats.remove_repeats(docs, hot_bytes=hot_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows)


def test_repeats_levels(spark):
    """A level follows only for what is too large, and equal strings share a part whatever stands around them."""
    rows = shared_line_rows()
    keyed = repeats.keyed(docs_of(spark, rows)).select("doc", "th", "text")
    assert len(repeats._levels(keyed, 1, 100, 1 << 30)) == 1
    levels = repeats._levels(keyed, 1 << 28, 100, 12_000)
    assert len(levels) > 1 and len(levels[0].hot) < levels[0].parts / 2
    part_of = {}
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        start, run, part, _ = repeats.dealt(data, np.array([0, len(data)]), 100, levels)
        assert sorted(x for a, n in zip(start, run, strict=True) for x in range(a, a + n)) == list(range(len(data) - 99))
        for a, n, where in zip(start, run, part, strict=True):
            for x in range(a, a + n):
                assert part_of.setdefault(text.encode()[x : x + 100], where) == where


def test_repeats_empty_and_kernels(none):
    assert repeats.remove_repeats(none).count() == 0
    x = np.random.default_rng(0).integers(0, 1000, 500)
    for w in (1, 7, 85, 500, 501):
        assert repeats.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_previous_factors():
    """Suffix order, common prefixes and longest previous factors against brute force."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        span = int(rng.integers(1, 20))
        text = rng.integers(97, 99, rng.integers(span, 150)).astype(np.uint8)
        at = np.arange(len(text) - span + 1)
        strings_at = [text.tobytes()[i : i + span] for i in at]
        common = lambda x, y: next((k for k in range(span) if x[k] != y[k]), span)  # noqa: E731, B023
        order, lcp = repeats.suffix_order(text, at, span)
        assert order.tolist() == sorted(at.tolist(), key=lambda i: (strings_at[i], i))  # noqa: B023
        assert lcp.tolist() == [0] + [common(strings_at[a], strings_at[b]) for a, b in zip(order[1:], order[:-1], strict=True)]
        got = np.empty(len(at), int)
        got[order] = repeats.previous_factors(at[order], lcp, span)
        assert got.tolist() == [max((common(strings_at[i], strings_at[j]) for j in range(i)), default=0) for i in at]


# Toxicity and quality


def auc(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()) if len(a) and len(b) else 1.0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity", "toxic", 0.8), ("op8_quality", "quality", 0.9)])
def test_held_out(name, label, least, spark, sf_dir):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    out = got[got.held_out].merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    assert auc(out[out[label] == 1].score, out[out[label] == 0].score) > least
    assert got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}


def toxic_rows():
    r = random.Random(3)
    rows = [(i, f"{prose(1000 + i, 30)} {'vile rotten ' if i % 3 == 0 else ''}{prose(2000 + i, r.randrange(5, 30))}") for i in range(300)]
    return rows, [(i, int(i % 3 == 0)) for i in range(300)]


def test_toxicity_neighbours_are_exact(spark):
    """The block-max index against cosines of whole vectors, over all words."""
    rows, labels = toxic_rows()
    rows = [(i, f"{t} rare{i // 3} odd{i % 40}") for i, t in rows]
    index = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    n, v = len(index.toxic), len(index.terms)
    assert n == 300 and v == len({w for _, t in rows for w in t.split()}) and 0 < index.dense.shape[1] < v
    dense = np.zeros((n, v))
    for t in range(v):
        if index.column[t] >= 0:
            dense[:, t] = index.dense[:, index.column[t]]
        for e in range(index.entry[t], index.entry[t + 1]):
            own = slice(index.begin[e], index.begin[e + 1])
            dense[index.example[own], t] = index.value[own]
            assert index.largest[e] == index.value[own].max() and set(index.example[own] // toxicity.BLOCK) == {index.block[e]}
    assert (dense**2).sum(1) == pytest.approx(np.ones(n), abs=1e-5)
    rng = np.random.default_rng(1)
    asked, skips = [], [-1, 0, 7] * 30
    for turn in range(90):
        term = np.flatnonzero(rng.random(v) < (0.02 if turn % 2 else 0.3))
        asked.append((term, rng.random(len(term)) ** 4 + 1e-3))
    for (term, q), skip, (ids, cosine) in zip(asked, skips, toxicity.nearest(index, asked, skips), strict=True):
        every = dense[:, term] @ q
        if skip >= 0:
            every[skip] = 0
        want = np.sort(every[every > 1e-9])[::-1][: index.k]
        assert cosine == pytest.approx(want, abs=1e-9) and len(set(ids)) == len(ids) and skip not in ids
        assert every[ids] == pytest.approx(cosine, abs=1e-9)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs_of(spark, [*rows, (900, "you vile thing"), (901, None)]), index).collect()}
    assert got[900] > 0.7 and got[901] < 0.5 and all((got[i] > 0.5) == bool(t) for i, t in labels)


def test_labels_and_ids_twice(spark):
    """An id labelled both ways is toxic; of two texts with one id the least is learnt; clashing columns are replaced."""
    docs = docs_of(spark, [(1, "vile words here"), (1, "a rotten thing"), (2, "all is well today"), (3, "well and good today")]).withColumn("toxicity", F.lit("mine")).withColumn("quality_score", F.lit("mine")).withColumn("lang_pred", F.lit("mine"))
    index = toxicity.fit(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"))
    assert index.toxic.sum() == 1 and len(index.toxic) == 3 and len(index.terms) == 3 + 4 + 2
    assert dict(toxicity.score(docs, index).dtypes)["toxicity"] == "double"
    assert dict(quality.score(docs, quality.fit(docs, docs.select("doc_id"))).dtypes)["quality_score"] == "double"
    assert {r.lang_pred for r in language_id.detect(docs, language_id.fit(docs, F.lit(True))).collect()} == {"en"}


def test_quality_parts():
    """Cuts are quantiles to within a cell; the prior of a mixture whose parts the score tells apart is found."""
    rng = np.random.default_rng(2)
    x = rng.gamma(2, 3, 20_000).astype(np.float32)
    cell, n = np.unique(quality._cells(x), return_counts=True)
    assert quality.cuts_of(cell, n) == pytest.approx(np.quantile(x, np.arange(1, 10) / 10), rel=0.02)
    mostly = np.where(rng.random(20_000) < 0.95, 0, x).astype(np.float32)
    cell, n = np.unique(quality._cells(mostly), return_counts=True)
    cuts = quality.cuts_of(cell, n)
    assert cuts[0] < 1e-30 and len(np.unique(cuts)) == 9 and (np.diff(cuts) >= 0).all()
    t = np.linspace(-1, 1, 40)
    above = lambda s: (s[None] >= t[:, None]).mean(1)
    good, bad = rng.normal(1.5, 1, 50_000), rng.normal(-3, 1, 50_000)
    assert quality.class_prior(above(good), 0.7 * above(good) + 0.3 * above(bad)) == pytest.approx(0.7, abs=0.01)


def test_scores_on_edges(spark, edges, none):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    index = toxicity.fit(edges, no_labels)
    assert {r.toxicity for r in toxicity.score(edges, index).collect()} == {0.0} and toxicity.score(none, index).count() == 0
    model = quality.fit(edges, edges.filter("doc_id in (1, 10)").select("doc_id"))
    scores = [r.quality_score for r in quality.score(edges, model).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    assert quality.score(none, quality.fit(none, none.select("doc_id"))).count() == 0
    assert {r.quality_score for r in quality.score(edges, quality.fit(edges, none.select("doc_id"))).collect()} == {0.5}


# Decontamination


ITEM = "Anna has 12 apples and buys 30 kg of flour in Paris. How many apples does Anna keep if she gives 12 apples to Bob?"


def test_reparameterised_questions(spark, none):
    items = spark.createDataFrame([(1, ITEM), (2, "Short one here."), (3, None), (4, ""), (5, "12 34 56"), (2, "Short one here.")], "item_id long, text string")
    changed = ITEM.replace("12", "7,5").replace("Anna", "Carla").replace("30 kg", "4 lb").replace("Paris", "Oslo")
    broken = changed.replace("gives 7,5", "gives 8")
    rows = [(1, f"Before. {ITEM} After that."), (2, f"Well now. {changed} More."), (3, f"Well now. {broken}"), (4, "Nothing of that kind stands here at all, really nothing."), (5, None), (6, ""), (None, ITEM), (7, "We saw it. Short one here."), (8, "9 9 9 9 9 9"), (9, prose(5, 20_000))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), items).collect()}
    assert {(1, 1), (2, 1), (None, 1), (7, 2)} <= got
    assert not {d for d, _ in got} & {4, 5, 6, 8, 9} and (3, 1) not in got
    left = {r.doc_id for r in decontaminate.clean(docs_of(spark, rows), items).collect()}
    assert left == {3, 4, 5, 6, 8, 9}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs_of(spark, rows), items.limit(0)).count() == 0


def test_what_stands_before_makes_no_difference(spark, monkeypatch):
    story = "Maria bought 12 apples at the market. Maria then sold 5 apples to a friend. Maria has how many apples left?"
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, story), (3, ITEM)], "item_id long, text string")
    half = "Maria bought 12 apples at the market. Maria then sold 5 apples to a friend. Maria lost 9 apples to many others."
    rows = [(1, 'He asked "What is the capital of France?"'), (2, "so\nwhat is\nthe capital of france"), (3, story.replace("Maria", "Bertha").replace("12", "77")), (4, f"(“{story}”)"), (5, half), (None, ITEM), (None, "clean text without an id"), (7, ITEM), (7, "clean text of a shared id"), (8, "WHAT IS THE CAPITAL OF FRANCE")]
    docs = docs_of(spark, rows)
    want = {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (None, 3), (7, 3), (8, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want
    assert {(r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()} == {(None, rows[6][1]), (7, rows[8][1])}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want


def test_large_benchmarks_give_the_same(spark, sf_dir, monkeypatch):
    find = lambda: sorted(map(tuple, queries.queries()["op9_decontamination"](spark, sf_dir).collect()))
    want = find()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert find() == want and want


# Neighbours


def test_neighbours_query(spark, sf_dir):
    got = queries.queries()["op10_nearest_neighbours"](spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.tolist() == pytest.approx([d[ids == v][0] for v in own.vec_id])
        best = ids[np.lexsort((ids, np.where(ids == q, np.inf, d)))[:10]]
        hits.append(len(set(best) & set(own.vec_id)) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_edges(spark):
    kind = "vec_id long, embedding array<float>, leaf int, part int"
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [0.0, -1.0])]
    got = nearest.search(spark.createDataFrame([(*r, 1, 1) for r in rows], kind), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 9)] and got[0].score == pytest.approx(2**0.5)
    assert nearest.search(spark.createDataFrame([], kind), F.col("id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0], 1, 1) for i in range(5000)], kind)
    got = nearest.search(same, F.col("id") % 1000 == 0, part=512).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11)) and {r.score for r in got} == {0.0}


def test_closest_is_exact():
    rng = np.random.default_rng(3)
    y = rng.integers(-2, 3, (300, 4)).astype(float)
    ids, own = rng.permutation(300), rng.integers(0, 300, 40)
    v = y[[int(np.flatnonzero(ids == i)[0]) for i in own]]
    got = [np.concatenate(x) for x in zip(*nearest.closest(y, ids, v, own, 10), strict=True)]
    for q in range(40):
        d = np.sqrt(((y - v[q]) ** 2).sum(1))
        d[ids == own[q]] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert got[1][got[0] == q].tolist() == want.tolist() and got[2][got[0] == q].tolist() == d[want].tolist()


def test_buckets():
    held = np.array([3, 4, 0, 5, 40, 1, 2, 9, 10])
    first, parts = nearest.buckets(held, 10)
    assert parts.tolist() == [1, 1, 1, 1, 4, 1, 1, 1, 1] and first.tolist() == [0, 0, 0, 1, 2, 6, 6, 7, 8]


def test_neighbours_are_as_many_as_there_are(spark, monkeypatch):
    """Visits are widened until k neighbours are found, repeated ids and small leaves notwithstanding."""
    plain = nearest.calibrate
    monkeypatch.setattr(nearest, "calibrate", lambda *a: replace(plain(*a), visit=1))
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)] + [(0, rng.normal(size=4).tolist()) for _ in range(12)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0, leaf_size=4, least=200).toPandas()
    assert got.groupby("query_id").size().tolist() == [10] * 4 and (got.query_id != got.vec_id).all()


@pytest.mark.parametrize("n", [4000, 16_000])
def test_neighbours_recall_at_two_sizes(spark, n):
    """The tree is grown from a quarter of the vectors; recall against brute force holds, and leaves grow in number."""
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, 16))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = nearest.search(table, F.col("id") % 100 == 0, least=1000).toPandas()
    hits = []
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id)) / 10)
    assert np.mean(hits) >= 0.9


# Pipeline


def test_stages_on_edges(spark, sf_dir, edges, none):
    """Every stage on nulls, repeated ids, long texts, clashing columns and an empty table."""
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        got, empty = stage(spark, edges, sf_dir), stage(spark, none, sf_dir)
        assert empty.count() == 0 and empty.columns == got.columns
        if name != "best-fit packing":
            assert got.schema.names == edges.schema.names and {r.secrets for r in got.collect()} <= {"x"}
    kept = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, edges, sf_dir).collect()), key=str)
    assert sum(t == edge_rows()[0][1] for _, t in kept) == 1 and (None, None) in kept
    assert P.sequences(spark, edges, sf_dir).select("doc_id").distinct().count() == len({d for d, _ in edge_rows()})


def test_scratch_needs_a_shared_folder(spark):
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = P.languages(spark, docs, sf_dir).persist()
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.count()
    rows = [(r.doc_id, r.text) for r in first.select("doc_id", "text").collect()]
    second = P.near_copies(spark, first, sf_dir).persist()
    kept = {d for d, _, c in brute_clusters(rows) if d == c}
    assert {r.doc_id for r in second.select("doc_id").collect()} == kept and second.columns == docs.columns
    third = P.benchmark(spark, second, sf_dir).persist()
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r.text.split()) for r in third.collect() for i in items)
    fourth = P.secrets(spark, third, sf_dir).persist()
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert all(by_hand(r.text) == "" and r.n_chars == len(r.text) for r in fourth.collect())
    last = P.sequences(spark, fourth, sf_dir).toPandas()
    assert set(last.doc_id) == {r.doc_id for r in fourth.select("doc_id").collect()} and last.groupby("sequence_id").length.sum().max() <= 1024
    whole = P.run(spark, sf_dir).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert whole[names].sort_values(names).reset_index(drop=True).equals(last[names].sort_values(names).reset_index(drop=True))


def test_strings_of_slices():
    import pyarrow as pa

    data, offsets = strings(pa.array(["a", None, "bc", ""]).slice(1, 3))
    assert data.tobytes() == b"bc" and offsets.tolist() == [0, 0, 2, 2]
