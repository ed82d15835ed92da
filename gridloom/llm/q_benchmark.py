"""op9: documents that hold benchmark items."""

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate as D
from gridloom.llm.shared import table


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_units = ", ".join(f"'{u}'" for u in D.UNITS)
_token = D.TOKEN.replace("'", "''")


def _templates(name: str, key: str) -> str:
    return f"""{name}_raw AS (SELECT {key}, regexp_extract_all(coalesce(text, ''), '{_token}') AS raw FROM {name}),
{name}_all AS (SELECT {key}, list_transform(range(1, len(raw) + 1), lambda i: {{
    'v': lower(raw[i]),
    'p': CASE WHEN raw[i][1] BETWEEN '0' AND '9' THEN '<number>'
        WHEN i > 1 AND raw[i - 1][1] BETWEEN '0' AND '9' AND lower(raw[i]) IN ({_units}) THEN '<unit>' ELSE lower(raw[i]) END,
    'n': raw[i] <> lower(raw[i]) AND length(raw[i]) > 1}}) AS t FROM {name}_raw),
{name}_t AS (SELECT {key}, 0 AS reading, list_transform(t, lambda x: {{'v': x.v, 'c': x.p}}) AS t FROM {name}_all
    UNION ALL SELECT {key}, 1, list_transform(t, lambda x: {{'v': x.v, 'c': CASE WHEN x.n AND x.p[1] <> '<' THEN '<name>' ELSE x.p END}}) FROM {name}_all)"""


def _windows(key: str, table: str, size: str, also: str = "") -> str:
    """All windows; of the reading with names only those that hold one."""
    return f"""SELECT * FROM (SELECT {key}, reading, p AS pos, array_to_string(list_transform(t[p + 1:p + {size}], lambda x: x.c), ' ') AS w, {size} AS size,
    list_filter(t[p + 1:p + {size}], lambda x: x.c[1] = '<') AS slots
    FROM (SELECT {key}, reading, t, {also} unnest(range(0, len(t) - {size} + 1)) AS p FROM {table} WHERE len(t) >= {size}))
    WHERE (reading = 0 OR contains(w, '<name>'))"""


OP9_SQL = f"""
WITH {_templates('documents', 'doc_id')}, {_templates('benchmark', 'item_id')},
i0 AS ({_windows('item_id', "(SELECT item_id, reading, t, least(8, len(t)) AS m FROM benchmark_t WHERE len(t) > 0 AND item_id IS NOT NULL)", 'm', 'm,')}),
i1 AS (SELECT *, size - len(slots) AS plain, max(size - len(slots)) OVER (PARTITION BY item_id, reading) AS most FROM i0),
items AS (SELECT * FROM i1 WHERE plain >= least(3, most, size) AND plain > 0),
ofs AS (SELECT item_id, count(DISTINCT pos) AS of_windows FROM items GROUP BY 1),
d AS ({' UNION ALL '.join(_windows('doc_id', 'documents_t', str(m)) + f' AND EXISTS (SELECT 1 FROM items WHERE items.size = {m})' for m in range(1, D.WINDOW + 1))}),
hits AS (SELECT doc_id, item_id, d.reading, items.pos AS item_pos, d.pos - items.pos AS shift, items.slots AS a, d.slots AS b FROM d JOIN items ON d.w = items.w AND d.size = items.size AND d.reading = items.reading),
pairs AS (SELECT doc_id, item_id, reading, shift, unnest(a) AS a, unnest(b) AS b FROM hits),
bad AS (SELECT DISTINCT doc_id, item_id, reading, shift FROM (SELECT doc_id, item_id, reading, shift, a FROM pairs GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT b) > 1)),
good AS (SELECT * FROM hits WHERE a = b OR NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id IS NOT DISTINCT FROM hits.doc_id AND bad.item_id = hits.item_id AND bad.reading = hits.reading AND bad.shift = hits.shift)),
n AS (SELECT doc_id, item_id, count(DISTINCT item_pos) AS n_windows FROM good GROUP BY 1, 2)
SELECT doc_id, item_id, n_windows, of_windows FROM n JOIN ofs USING (item_id) WHERE n_windows >= 0.5 * of_windows OR n_windows >= 10
"""
