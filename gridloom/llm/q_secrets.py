"""op1: secrets in documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import secret_scan as S
from gridloom.llm.shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = S.find_secrets(docs)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    all_spans = S.spans_text(F.col("secrets"))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(all_spans, 256).alias("base_sha256"), all_spans.alias("spans"),
    )


def _kind(name: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""list_filter(list_transform(range(len(regexp_extract_all(t, '{pattern}'))), lambda i: {{
        's': coalesce(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i + 1], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i], lambda x: length(x))), 0),
        'k': {number}, 'w': length(regexp_extract_all(t, '{pattern}')[i + 1]), 'n': length(regexp_extract_all(t, '{pattern}', {group})[i + 1]), 'kind': '{name}'}}),
        lambda x: x.n >= {least})"""


_ANY = "".join  # letters in either case are spelt out
_EITHER = lambda w: _ANY(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_ASSIGN = "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + "|" + _EITHER("api") + "_?" + _EITHER("key") + r''')["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'''

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_kind('assign', 0, _ASSIGN, 2, 6)} AS a, {_kind('access', 1, 'AKIA[A-Z0-9]+', 0, 20)} AS b,
    {_kind('hex', 2, '[0-9a-f]{{24,}}'.replace('{{', '{').replace('}}', '}'), 0, 24)} AS c FROM d),
g AS (SELECT *, array_to_string(list_transform(list_sort(list_concat(list_concat(
    list_transform(a, lambda x: {{'s': x.s, 'k': x.k, 'w': x.w, 'kind': x.kind}}), list_transform(b, lambda x: {{'s': x.s, 'k': x.k, 'w': x.w, 'kind': x.kind}})),
    list_transform(c, lambda x: {{'s': x.s, 'k': x.k, 'w': x.w, 'kind': x.kind}}))),
    lambda x: x.kind || ':' || x.s::BIGINT || ':' || (x.s + x.w)::BIGINT), ',') AS spans FROM f)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM g
"""
