"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import programs
from gridloom.functions import vectors as V
from gridloom.operators import collectives, extent, kmeans, matrix, stats
from gridloom.operators import scaling as S
from gridloom.plans import inputs as I
from gridloom.plans.inputs import EMB, SQL
from gridloom.sources import generators, text
from gridloom.sources.matrix import decode_shorts, read_cells, read_matrix
from gridloom.types import ITERATION, ScalingConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
D = 2
HOT, ALPHA, FACTOR = 0.1, 0.95, 0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame, key: str, column: str = "x") -> DataFrame:
    """key, k, v rounded: arrays as rows, which both engines hash alike."""
    return df.select(key, F.posexplode(column).alias("k", "v")).select(key, "k", F.round("v", 6).alias("v"))


# Sources and parsing


@query(f"WITH {EMB} SELECT id, len(x)::BIGINT AS dimension, round(list_sum(x), 6) AS total FROM emb")
def scan_points(spark, sf_dir):
    return I.embeddings(spark, sf_dir).select("id", F.size("x").cast("long").alias("dimension"), F.round(V.total(F.col("x")), 6).alias("total"))


@query("SELECT o_orderkey AS id, o_totalprice AS x0, o_custkey::DOUBLE AS x1 FROM orders")
def parse_points_text(spark, sf_dir):
    lines = I.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")).alias("value"))
    return text.parse_points(lines, 2).select(F.col("o_orderkey").alias("id"), F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("SELECT n_nationkey AS cid, n_regionkey::DOUBLE AS x0, n_nationkey::DOUBLE AS x1 FROM nation")
def parse_centroids_text(spark, sf_dir):
    lines = I.table(spark, sf_dir, "nation").select(F.concat_ws(" ", "n_nationkey", "n_regionkey", "n_nationkey").alias("value"))
    return text.parse_centroids(lines).select("cid", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query(f"WITH {SQL} SELECT i, j, v FROM dshort")
def scan_distances(spark, sf_dir):
    return I.distances(spark, sf_dir)


@query("SELECT count(*) AS n_blocks FROM embeddings")
def block_count(spark, sf_dir):
    return stats.block_count(I.embeddings(spark, sf_dir))


# K-means


def _near(points: str, centres: str) -> str:
    return f"""SELECT id, px, cid, d FROM (SELECT p.id, p.x AS px, c.cid, sqrt(list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - c.x[k]) * (p.x[k] - c.x[k])))) AS d,
        row_number() OVER (PARTITION BY p.id ORDER BY list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - c.x[k]) * (p.x[k] - c.x[k]))), c.cid) AS r FROM {points} p, {centres} c) WHERE r = 1"""


def _steps(n: int, seeds: str, points: str = EMB, d: int = 64) -> str:
    parts = [points, f"c0 AS ({seeds})"]
    for s in range(1, n + 1):
        parts += [
            f"a{s} AS ({_near('emb', f'c{s - 1}')})",
            f"m{s} AS (SELECT cid, k, sum(px[k]) / count(*) AS v FROM a{s}, (SELECT unnest(range(1, {d + 1})) AS k) GROUP BY cid, k)",
            f"n{s} AS (SELECT cid, count(*) AS n FROM a{s} GROUP BY cid)",
            f"l{s} AS (SELECT cid, list(v ORDER BY k) AS x FROM m{s} GROUP BY cid)",
            f"c{s} AS (SELECT c.cid, coalesce(l.x, list_transform(range({d}), lambda k: 0::DOUBLE)) AS x, coalesce(n.n, 0) AS n FROM c{s - 1} c LEFT JOIN l{s} l USING (cid) LEFT JOIN n{s} n USING (cid))",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT cid, n, (k - 1)::INTEGER AS k, round(x[k], 6) AS v FROM c{n}, (SELECT unnest(range(1, {d + 1})) AS k)"


_SEEDS = "SELECT (id + 1)::INTEGER AS cid, x FROM emb WHERE id < 5"
_FAR = _SEEDS + " UNION ALL SELECT 6, list_transform(x, lambda v: v + 1000::DOUBLE) FROM emb WHERE id = 0"


def _centres(df: DataFrame) -> DataFrame:
    return df.select("cid", "n", F.posexplode("x").alias("k", "v")).select("cid", "n", "k", F.round("v", 6).alias("v"))


@query(f"WITH {EMB}, c AS ({_SEEDS}) SELECT id, cid, round(d, 6) AS distance FROM ({_near('emb', 'c')})")
def nearest_centroid(spark, sf_dir):
    return kmeans.nearest(I.embeddings(spark, sf_dir), I.seeds(spark, sf_dir)).select("id", "cid", F.round("distance", 6).alias("distance"))


@query(_steps(1, _SEEDS))
def kmeans_step(spark, sf_dir):
    return _centres(kmeans.step(I.embeddings(spark, sf_dir), I.seeds(spark, sf_dir), 64))


@query(_steps(3, _SEEDS))
def kmeans_3_iters(spark, sf_dir):
    return _centres(kmeans.kmeans(I.embeddings(spark, sf_dir), I.seeds(spark, sf_dir), 3))


@query(_steps(1, _FAR))
def kmeans_empty_cluster(spark, sf_dir):
    return _centres(kmeans.step(I.embeddings(spark, sf_dir), I.seeds(spark, sf_dir, far=True), 64))


# Statistics


def _stats(source: str) -> str:
    return f"""SELECT count(*) AS n, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high,
        round(sum(v * v), 6) AS sum_of_squares, round(min(v) FILTER (v > 0), 6) AS positive_min FROM {source}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("n", *(F.round(c, 6).alias(c) for c in df.columns if c != "n"))


@query(f"WITH {SQL}, r AS (SELECT v::DOUBLE AS v FROM dshort) {_stats('r')}")
def matrix_stats(spark, sf_dir):
    return _rounded(stats.cell_stats(I.distances(spark, sf_dir), F.col("v").cast("double"), skip_missing=False))


@query(f"WITH {SQL}, r AS (SELECT delta AS v FROM cells WHERE delta >= 0) {_stats('r')}")
def matrix_stats_scaled(spark, sf_dir):
    return _rounded(stats.cell_stats(I.distances(spark, sf_dir), V.decode(F.col("v"))))


@query("SELECT event_type, round(max(value), 6) AS high, round(min(value), 6) AS low, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def log_summary(spark, sf_dir):
    return stats.log_summary(I.table(spark, sf_dir, "events"), "event_type", "value").select("event_type", *(F.round(c, 6).alias(c) for c in ("high", "low", "mean")))


# Scaling, piece by piece


@query(f"WITH {SQL} SELECT i, j, round(delta, 6) AS delta, round(w, 6) AS w FROM cells WHERE delta >= 0 AND w <> 0 AND i <> j")
def missing_filter(spark, sf_dir):
    return I.cells(spark, sf_dir).filter("delta >= 0 and w <> 0 and i <> j").select("i", "j", F.round("delta", 6).alias("delta"), F.round("w", 6).alias("w"))


@query(f"WITH {SQL}, s AS (SELECT min(delta) AS m FROM cells WHERE delta > 0) SELECT i, j, (CASE WHEN delta >= 0 AND delta < m THEN trunc(m * 32767::DOUBLE) ELSE v END)::SMALLINT AS v FROM dshort JOIN cells USING (i, j), s")
def zero_fix(spark, sf_dir):
    d = I.distances(spark, sf_dir)
    low = stats.cell_stats(d, V.decode(F.col("v"))).select("positive_min")
    return S.zero_fix(d.crossJoin(F.broadcast(low)), F.col("positive_min")).select("i", "j", "v")


@query(f"WITH {SQL} SELECT round({FACTOR}::DOUBLE * min(delta) FILTER (delta > 0) / sqrt({2 * D}::DOUBLE), 6) AS t_min, round(max(delta) / sqrt({2 * D}::DOUBLE), 6) AS t_max, round({ALPHA}::DOUBLE * (max(delta) / sqrt({2 * D}::DOUBLE)), 6) AS t_cur FROM cells WHERE delta >= 0")
def init_temperature(spark, sf_dir):
    found = S.init_temperature(stats.cell_stats(I.distances(spark, sf_dir), V.decode(F.col("v"))), D, ALPHA, FACTOR)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(f"WITH {SQL} SELECT i, j, round(delta, 6) AS delta, round(w, 6) AS w FROM cells")
def weights_join(spark, sf_dir):
    return I.cells(spark, sf_dir).select("i", "j", F.round("delta", 6).alias("delta"), F.round("w", 6).alias("w"))


@query(f"WITH {SQL}, a AS (SELECT avg(delta) AS a FROM cells WHERE delta >= 0) SELECT i, j, round(w / greatest(delta, 0.001::DOUBLE * a), 6) AS w FROM cells, a")
def sammon_weights(spark, sf_dir):
    c = I.cells(spark, sf_dir)
    mean = c.filter("delta >= 0").agg(F.avg("delta").alias("a")).first().a
    return S.sammon_weights(c, mean).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {SQL}, s AS (SELECT i, 1 + i * 0.5::DOUBLE AS s FROM pts) SELECT c.i, c.j, round(a.s * b.s, 6) AS w FROM cells c JOIN s a ON a.i = c.i JOIN s b ON b.i = c.j")
def simple_weights(spark, sf_dir):
    s = I.configuration(spark, sf_dir).select("i", (1 + F.col("i") * F.lit(0.5)).alias("s"))
    return S.simple_weights(I.cells(spark, sf_dir).drop("w"), s).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {SQL} SELECT i, round(v, 6) AS v FROM v")
def v_diagonal(spark, sf_dir):
    return S.v_diagonal(I.cells(spark, sf_dir)).select("i", F.round("v", 6).alias("v"))


_PAIRS = "pairs AS (SELECT c.*, sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1)) AS d FROM cells c JOIN x p ON p.i = c.i JOIN x q ON q.i = c.j)"


@query(f"WITH {SQL}, {_PAIRS} SELECT i, j, round(d, 6) AS d FROM pairs")
def pairwise_distance(spark, sf_dir):
    return S.pair_distances(I.cells(spark, sf_dir), I.configuration(spark, sf_dir)).select("i", "j", F.round("d", 6).alias("d"))


@query("WITH p AS (SELECT s_suppkey AS i, s_nationkey::DOUBLE AS a, round(s_acctbal * 100)::BIGINT::DOUBLE AS b FROM supplier) SELECT p.i, round(max(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))), 6) AS farthest FROM p, p q GROUP BY p.i")
def supplier_farthest(spark, sf_dir):
    p = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.array(F.col("s_nationkey").cast("double"), F.round(F.col("s_acctbal") * 100).cast("long").cast("double")).alias("x"))
    return extent.farthest(p).select("i", F.round("farthest", 6).alias("farthest"))


def _gap_sql(t: float) -> str:
    return f"(sqrt({2 * D}::DOUBLE) * {t!r}::DOUBLE)" if t > 1e-9 else "0::DOUBLE"


def _stress_sql(t: float, pairs: str = "pairs") -> str:
    g = _gap_sql(t)
    return f"(SELECT sum(w * pow(CASE WHEN delta >= {g} THEN delta - {g} - d ELSE -d END, 2)) FROM {pairs} WHERE delta >= 0)"


@query(f"WITH {SQL}, {_PAIRS} SELECT round({_stress_sql(HOT)} * (SELECT 1::DOUBLE / sum(delta * delta) FROM cells WHERE delta >= 0), 6) AS stress")
def stress_hot(spark, sf_dir):
    c = I.cells(spark, sf_dir)
    total = stats.cell_stats(I.distances(spark, sf_dir), V.decode(F.col("v"))).select("sum_of_squares")
    return S.stress(c, I.configuration(spark, sf_dir), HOT, D).crossJoin(F.broadcast(total)).select(F.round(F.col("stress") * (F.lit(1.0) / F.col("sum_of_squares")), 6).alias("stress"))


@query(f"WITH {SQL}, {_PAIRS} SELECT round({_stress_sql(0)}, 6) AS stress")
def stress_cold(spark, sf_dir):
    return S.stress(I.cells(spark, sf_dir), I.configuration(spark, sf_dir), 0.0, D).select(F.round("stress", 6).alias("stress"))


def _b_sql(t: float, x: str = "x", pairs: str = "pairs", tag: str = "") -> str:
    g = _gap_sql(t)
    return f"""off{tag} AS (SELECT i, j, CASE WHEN d >= 1e-10 AND {g} < delta THEN -w * (delta - {g}) / CASE WHEN d >= 1e-10 THEN d END ELSE 0::DOUBLE END AS v FROM {pairs} WHERE i <> j AND delta >= 0 AND w <> 0),
        b{tag} AS (SELECT * FROM off{tag} UNION ALL SELECT {x}.i, {x}.i, coalesce((SELECT -sum(v) FROM off{tag} o WHERE o.i = {x}.i), 0) FROM {x}),
        bc{tag} AS (SELECT b{tag}.i, sum(v * x0) AS x0, sum(v * x1) AS x1 FROM b{tag} JOIN {x} ON {x}.i = b{tag}.j GROUP BY b{tag}.i)"""


_LONG = lambda t: f"SELECT i, 0 AS k, round(x0, 6) AS v FROM {t} UNION ALL SELECT i, 1, round(x1, 6) FROM {t}"


@query(f"WITH {SQL}, {_PAIRS}, {_b_sql(HOT)} SELECT i, j, round(v, 6) + 0::DOUBLE AS v FROM b")
def b_of_z(spark, sf_dir):
    return S.b_of_z(I.cells(spark, sf_dir), I.configuration(spark, sf_dir), HOT, D).select("i", "j", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query(f"WITH {SQL}, {_PAIRS}, {_b_sql(HOT)} {_LONG('bc')}")
def bc_product(spark, sf_dir):
    x = I.configuration(spark, sf_dir)
    return flat(S.matrix_points(S.b_of_z(I.cells(spark, sf_dir), x, HOT, D), x, D), "i")


def _vp_sql(p: str, name: str) -> str:
    return f"{name} AS (SELECT v.i, v.v * p.x0 - coalesce(o.x0, 0) AS x0, v.v * p.x1 - coalesce(o.x1, 0) AS x1 FROM v JOIN {p} p ON p.i = v.i LEFT JOIN (SELECT c.i, sum(w * q.x0) AS x0, sum(w * q.x1) AS x1 FROM cells c JOIN {p} q ON q.i = c.j WHERE c.i <> c.j GROUP BY c.i) o ON o.i = v.i)"


@query(f"WITH {SQL}, {_vp_sql('x', 'vx')} {_LONG('vx')}")
def v_matvec(spark, sf_dir):
    c = I.cells(spark, sf_dir)
    return flat(S.v_matvec(c, S.v_diagonal(c), I.configuration(spark, sf_dir), D), "i")


def _cg_sql(steps: int, t: float, x: str = "x", pairs: str = "pairs", tag: str = "") -> tuple[str, str]:
    """Common table expressions of so many full steps, and the name of the last configuration."""
    out = [_b_sql(t, x, pairs, tag), _vp_sql(x, f"vx{tag}"), f"r{tag}0 AS MATERIALIZED (SELECT i, bc{tag}.x0 - vx{tag}.x0 AS x0, bc{tag}.x1 - vx{tag}.x1 AS x1 FROM bc{tag} JOIN vx{tag} USING (i))", f"p{tag}0 AS (SELECT * FROM r{tag}0)", f"y{tag}0 AS (SELECT i, x0, x1 FROM {x})"]
    for s in range(1, steps + 1):
        a, b = f"{tag}{s - 1}", f"{tag}{s}"
        out += [
            _vp_sql(f"p{a}", f"vp{b}").replace(" AS (", " AS MATERIALIZED (", 1),
            f"al{b} AS MATERIALIZED (SELECT (SELECT sum(x0 * x0 + x1 * x1) FROM r{a}) / (SELECT sum(p.x0 * q.x0 + p.x1 * q.x1) FROM p{a} p JOIN vp{b} q USING (i)) AS a)",
            f"y{b} AS MATERIALIZED (SELECT y.i, y.x0 + a * p.x0 AS x0, y.x1 + a * p.x1 AS x1 FROM y{a} y JOIN p{a} p USING (i), al{b})",
            f"r{b} AS MATERIALIZED (SELECT r.i, r.x0 - a * q.x0 AS x0, r.x1 - a * q.x1 AS x1 FROM r{a} r JOIN vp{b} q USING (i), al{b})",
            f"be{b} AS (SELECT (SELECT sum(x0 * x0 + x1 * x1) FROM r{b}) / (SELECT sum(x0 * x0 + x1 * x1) FROM r{a}) AS b)",
            f"p{b} AS MATERIALIZED (SELECT r.i, r.x0 + b * p.x0 AS x0, r.x1 + b * p.x1 AS x1 FROM r{b} r JOIN p{a} p USING (i), be{b})",
        ]
    return ", ".join(out), f"y{tag}{steps}"


def _cg(spark, sf_dir, steps: int) -> DataFrame:
    c, x = I.cells(spark, sf_dir), I.configuration(spark, sf_dir)
    bc = S.matrix_points(S.b_of_z(c, x, HOT, D), x, D)
    return flat(S.conjugate_gradient(c, S.v_diagonal(c), bc, x, D, steps, exact=True).x, "i")


@query("WITH {}, {}, {} {}".format(SQL, _PAIRS, _cg_sql(1, HOT)[0], _LONG(_cg_sql(1, HOT)[1])))
def cg_step_1(spark, sf_dir):
    return _cg(spark, sf_dir, 1)


@query("WITH {}, {}, {} {}".format(SQL, _PAIRS, _cg_sql(3, HOT)[0], _LONG(_cg_sql(3, HOT)[1])))
def cg_3_steps(spark, sf_dir):
    return _cg(spark, sf_dir, 3)


def _after(x: str) -> str:
    return f"after AS (SELECT c.*, sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1)) AS d FROM cells c JOIN {x} p ON p.i = c.i JOIN {x} q ON q.i = c.j)"


@query("WITH {}, {}, {}, {} SELECT round({}, 6) AS pre_stress, round({}, 6) AS post_stress".format(SQL, _PAIRS, _cg_sql(2, HOT)[0], _after(_cg_sql(2, HOT)[1]), _stress_sql(HOT), _stress_sql(HOT, "after")))
def smacof_iteration(spark, sf_dir):
    c, x = I.cells(spark, sf_dir), I.configuration(spark, sf_dir)
    bc = S.matrix_points(S.b_of_z(c, x, HOT, D), x, D)
    moved = S.conjugate_gradient(c, S.v_diagonal(c), bc, x, D, 2, exact=True).x
    post = S.stress(c, moved, HOT, D).select(F.round("stress", 6).alias("post_stress"))
    return S.stress(c, x, HOT, D).select(F.round("stress", 6).alias("pre_stress")).crossJoin(post)


@query()
def scaling_run(spark, sf_dir):
    """A whole annealing run by the dense kernels: a row for each stress step."""
    config = ScalingConfig(dimension=D, alpha=0.5, cg_iterations=8, max_stress_loops=2, max_temp_loops=4)
    d = I.distances(spark, sf_dir)
    found = stats.cell_stats(d, V.decode(F.col("v")))
    s, t = found.collect()[0], S.init_temperature(found, D, config.alpha, config.t_min_factor).collect()[0]
    fixed = S.zero_fix(d, F.lit(s.positive_min))
    rows = S.stored_rows(matrix.cells_to_rows(fixed), matrix.cells_to_rows(I.weights(spark, sf_dir))).persist()
    x = I.configuration(spark, sf_dir).orderBy("i").collect()
    import numpy as np

    run = S.DenseScaling(rows, len(x), D)
    run.run(np.array([r.x for r in x]), t.t_cur, t.t_min, 1 / s.sum_of_squares, config)
    rows.unpersist()
    return spark.createDataFrame([(k, h.t_cur, h.stress, h.stress_itr, h.t_itr, h.cg_count) for k, h in enumerate(run.history)], "step int, t_cur double, stress double, stress_itr int, t_itr int, cg_count int")


# Matrices


@query(f"WITH {EMB}, b AS (SELECT (id * 4 + j) AS z, id AS k, j, ((id * 7 + j * 3) % 11)::DOUBLE AS v FROM (SELECT unnest(range(64)) AS id), (SELECT unnest(range(4)) AS j)) SELECT e.id AS i, b.j, round(sum(e.x[b.k + 1] * b.v), 6) AS v FROM emb e, b GROUP BY e.id, b.j")
def matmul(spark, sf_dir):
    a = matrix.rows_to_cells(I.embeddings(spark, sf_dir).select(F.col("id").alias("i"), F.col("x").alias("data")))
    b = spark.range(256).select(F.floor(F.col("id") / 4).alias("i"), (F.col("id") % 4).alias("j"), ((F.floor(F.col("id") / 4) * 7 + F.col("id") % 4 * 3) % 11).cast("double").alias("v"))
    return matrix.matmul(a, b).select("i", "j", F.round("v", 6).alias("v"))


@query(ORACLE["matmul"])
def matmul_dense(spark, sf_dir):
    import numpy as np

    b = np.array([[(k * 7 + j * 3) % 11 for j in range(4)] for k in range(64)], float)
    rows = matrix.matmul_dense(I.embeddings(spark, sf_dir).select(F.col("id").alias("i"), F.col("x").alias("data")), b)
    return matrix.rows_to_cells(rows).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {SQL}, r AS (SELECT i, list(v ORDER BY j) AS data FROM dshort GROUP BY i), b AS (SELECT CASE WHEN i < 7 THEN 0 ELSE (1 + (i - 7) // 6) END::INTEGER AS block, i, data FROM r) SELECT block, min(i) AS start, count(*) AS block_rows, 25::BIGINT AS matrix_rows, 25::BIGINT AS matrix_cols, sum(list_sum(data))::BIGINT AS total FROM b GROUP BY block")
def row_blocks(spark, sf_dir):
    rows = matrix.cells_to_rows(I.distances(spark, sf_dir))
    made = matrix.to_blocks(rows, 25, 4)
    return made.select("block", "start", "block_rows", "matrix_rows", "matrix_cols", F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"WITH {SQL} SELECT (i)::INTEGER AS row, (j)::INTEGER AS col, v::DOUBLE AS v FROM dshort")
def ordered_gather(spark, sf_dir):
    rows = matrix.cells_to_rows(I.distances(spark, sf_dir).withColumn("v", F.col("v").cast("double")))
    whole = matrix.ordered_gather(rows, 25).select(F.posexplode("matrix").alias("row", "data"))
    return whole.select("row", F.posexplode("data").alias("col", "v"))


@query(f"WITH {SQL} SELECT round(sum(delta * w), 6) AS v FROM cells")
def inner_product(spark, sf_dir):
    c = I.cells(spark, sf_dir)
    return matrix.inner_product(c.select("i", "j", F.col("delta").alias("v")), c.select("i", "j", F.col("w").alias("v"))).select(F.round("v", 6).alias("v"))


# Collectives


_SENT = "sent AS (SELECT s_suppkey AS worker, list_transform(range(16), lambda k: (k * s_nationkey)::BIGINT) AS list FROM supplier)"


def _sent(spark, sf_dir) -> DataFrame:
    payload = spark.range(16).agg(F.sort_array(F.collect_list("id")).alias("list"))
    sent = collectives.broadcast(payload, I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), "s_nationkey"))
    return sent.select("worker", F.transform("list", lambda v: v * F.col("s_nationkey").cast("long")).alias("list"))


@query(f"WITH {_SENT}, g AS (SELECT worker, list_sum(list)::BIGINT AS s, row_number() OVER (ORDER BY worker) - 1 AS pos FROM sent) SELECT pos::INTEGER AS pos, s AS total FROM g")
def collective_gather(spark, sf_dir):
    whole = collectives.gather(_sent(spark, sf_dir), "worker", "list").select(F.posexplode("gathered").alias("pos", "list"))
    return whole.select("pos", F.aggregate("list", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"WITH {_SENT} SELECT (k - 1)::INTEGER AS pos, sum(list[k])::BIGINT AS total FROM sent, (SELECT unnest(range(1, 17)) AS k) GROUP BY k")
def collective_reduce(spark, sf_dir):
    return collectives.reduce(_sent(spark, sf_dir), "list")


@query(f"WITH {_SENT}, t AS (SELECT (k - 1)::INTEGER AS pos, sum(list[k])::BIGINT AS total FROM sent, (SELECT unnest(range(1, 17)) AS k) GROUP BY k) SELECT worker, pos, total FROM sent, t")
def collective_allreduce(spark, sf_dir):
    return collectives.allreduce(_sent(spark, sf_dir), "worker", "list").select("worker", F.posexplode("total").alias("pos", "total"))


@query("SELECT s_suppkey AS worker, (CASE WHEN s_nationkey % 3 = 1 THEN 1000 - s_nationkey ELSE 0 END)::BIGINT AS cumulative FROM supplier")
def collective_local_times(spark, sf_dir):
    sent = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), (F.col("s_nationkey") % 3).cast("string").alias("host"), F.col("s_nationkey").cast("long").alias("time"))
    return collectives.local_elapsed(sent, "1", 1000).select("worker", "cumulative")


@query("SELECT unnest(range((SELECT count(*) FROM region)))::BIGINT AS round, true AS cumulative")
def collective_times_sink(spark, sf_dir):
    """Rounds of broadcast and allreduce, their cumulative times written as text and read again."""
    path = I.shared_path(spark, "times")
    programs.collective(spark, 16, I.table(spark, sf_dir, "region").count(), True, path)
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^Time:(\d+)$", 1).cast("long").alias("ms"))
    whole = lines.agg(F.sort_array(F.collect_list("ms")).alias("ms")).select(F.posexplode("ms").alias("round", "ms"))
    return whole.select(F.col("round").cast("long").alias("round"), (F.col("ms") >= 0).alias("cumulative"))


# Files: binary and text sources and sinks


@query(f"WITH {SQL} SELECT i, j, v FROM dshort")
def binary_shorts(spark, sf_dir):
    """Distances through a big-endian file, in four row ranges."""
    path = I.stored(spark, I.distances(spark, sf_dir), "distances")
    return matrix.rows_to_cells(read_matrix(spark, path, 25, 25, splits=4)).select("i", "j", "v")


@query(f"WITH {SQL} SELECT i, j, v FROM wshort")
def binary_shorts_little(spark, sf_dir):
    path = I.stored(spark, I.weights(spark, sf_dir), "weights", endian="little")
    return matrix.rows_to_cells(read_matrix(spark, path, 25, 25, endian="little", splits=3)).select("i", "j", "v")


@query(f"WITH {SQL} SELECT i, j, delta AS v FROM cells")
def binary_doubles(spark, sf_dir):
    path = I.stored(spark, I.cells(spark, sf_dir).select("i", "j", F.col("delta").alias("v")), "doubles", "float64")
    return matrix.rows_to_cells(read_matrix(spark, path, 25, 25, "float64", splits=2)).select("i", "j", "v")


@query(f"WITH {SQL} SELECT i, j, v FROM dshort")
def binary_through_hadoop(spark, sf_dir):
    path = I.stored(spark, I.distances(spark, sf_dir), "hadoop")
    return matrix.rows_to_cells(read_matrix(spark, path, 25, 25, hadoop=True)).select("i", "j", "v")


@query(f"WITH {SQL}, r AS (SELECT i, CASE WHEN i < 7 THEN 0 ELSE 1 + (i - 7) // 6 END AS part FROM pts) SELECT min(i) AS start, count(*) AS n FROM r GROUP BY part")
def row_ranges(spark, sf_dir):
    """Where the row ranges of a file begin, and how many rows they have: one row more in the first ones."""
    rows = read_matrix(spark, I.stored(spark, I.distances(spark, sf_dir), "ranges"), 25, 25, splits=4)
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min("i").alias("start"), F.count("*").alias("n")).select("start", "n")


@query(f"WITH {SQL} SELECT (i * 25 + j)::INTEGER AS k, v FROM dshort")
def shorts_by_expressions(spark, sf_dir):
    files = spark.read.format("binaryFile").load(I.stored(spark, I.distances(spark, sf_dir), "expressions"))
    return files.select(F.posexplode(decode_shorts(F.col("content"), F.lit(625))).alias("k", "v"))


@query(f"WITH {SQL} SELECT i, j, round(delta * 2, 6) AS delta, round(w * w, 6) AS w FROM (SELECT i, j, CASE WHEN delta >= 0 THEN delta ELSE delta / 2 END AS delta, w FROM cells)")
def rows_with_matrix_weights(spark, sf_dir):
    """Distances and weights from files, both transformed; missing distances stay."""
    d, w = I.stored(spark, I.distances(spark, sf_dir), "d"), I.stored(spark, I.weights(spark, sf_dir), "w", endian="little")
    cells = read_cells(spark, d, 25, w, "matrix", weight_endian="little", transform=lambda c: c * 2, weight_transform=lambda c: c * c)
    return cells.select("i", "j", F.round("delta", 6).alias("delta"), F.round("w", 6).alias("w"))


@query(f"WITH {SQL}, s AS (SELECT i, 1 + i * 0.5::DOUBLE AS s FROM pts) SELECT c.i, c.j, round(a.s * b.s / greatest(delta, 0.00025::DOUBLE), 4) AS w, r AS repetition FROM cells c JOIN s a ON a.i = c.i JOIN s b ON b.i = c.j, (SELECT unnest([1, 2]) AS r)")
def rows_with_simple_weights(spark, sf_dir):
    """A weight for each point from a text file, Sammon weights of average 0.25, two repetitions."""
    path = I.shared_path(spark, "simple")
    text.write_rows(I.configuration(spark, sf_dir).select("i", F.array(1 + F.col("i") * F.lit(0.5)).alias("x")), path)
    cells = read_cells(spark, I.stored(spark, I.distances(spark, sf_dir), "d"), 25, path, "simple", sammon=0.25, repetitions=2)
    return cells.select("i", "j", F.round("w", 4).alias("w"), "repetition")


@query(f"WITH {SQL} SELECT i, j, round(delta * 625)::BIGINT AS v FROM cells")
def rounded_cells(spark, sf_dir):
    return matrix.rounded_cells(read_matrix(spark, I.stored(spark, I.distances(spark, sf_dir), "rounded"), 25, 25), 25)


@query(f"WITH {SQL}, r AS (SELECT delta AS v FROM cells WHERE delta >= 0) {_stats('r')}")
def stored_stats(spark, sf_dir):
    """Statistics of a stored matrix, row by row."""
    return _rounded(programs.statistics(spark, I.stored(spark, I.distances(spark, sf_dir), "stats"), 25))


@query(f"WITH {SQL}, s AS (SELECT min(delta) AS m FROM cells WHERE delta > 0) SELECT i, j, (CASE WHEN delta >= 0 AND delta < m THEN trunc(m * 32767::DOUBLE) ELSE v END)::SMALLINT AS v FROM dshort JOIN cells USING (i, j), s")
def stored_zero_fix(spark, sf_dir):
    rows = read_matrix(spark, I.stored(spark, I.distances(spark, sf_dir), "fix"), 25, 25)
    return matrix.rows_to_cells(S.stored_zero_fix(rows, S.stored_stats(rows).first().positive_min))


@query(f"WITH {SQL} SELECT i, 0 AS k, x0 AS v FROM x UNION ALL SELECT i, 1, x1 FROM x")
def matrix_text_round_trip(spark, sf_dir):
    path = I.shared_path(spark, "points")
    text.write_rows(I.configuration(spark, sf_dir), path)
    return text.read_matrix_text(spark, path).select("i", F.posexplode("x").alias("k", "v"))


@query("SELECT n_nationkey AS cid, n_regionkey::DOUBLE AS x0, n_nationkey / 4::DOUBLE AS x1 FROM nation")
def centroids_round_trip(spark, sf_dir):
    path = I.shared_path(spark, "centroids")
    text.write_centroids(I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cid"), F.array(F.col("n_regionkey").cast("double"), F.col("n_nationkey") / F.lit(4.0)).alias("x")), path)
    return text.read_centroids(spark, path).select("cid", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query("SELECT s_suppkey AS id, s_nationkey::DOUBLE AS x0, round(s_acctbal) AS x1 FROM supplier")
def points_round_trip(spark, sf_dir):
    """Points as text of two decimals, the first of which tells them apart."""
    path = I.shared_path(spark, "points")
    text.write_points(I.table(spark, sf_dir, "supplier").select(F.array(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"), F.round("s_acctbal")).alias("x")), path, decimals=True)
    return text.read_points(spark, path, 3).select(F.col("x")[0].cast("long").alias("id"), F.col("x")[1].alias("x0"), F.col("x")[2].alias("x1"))


@query("SELECT 0.5::DOUBLE AS t_cur, count(*) / 8::DOUBLE AS stress, 2 AS stress_itr, 3 AS t_itr, 1.5::DOUBLE AS pre_stress, 0.25::DOUBLE AS t_min, count(*)::INTEGER AS cg_count FROM nation")
def iteration_round_trip(spark, sf_dir):
    n, path = I.table(spark, sf_dir, "nation").count(), I.shared_path(spark, "iteration")
    text.write_iterations(spark, [S.Iteration(0.5, n / 8, 2, 3, 1.5, 0.25, n)], path)
    return spark.createDataFrame([tuple(text.read_iteration(spark, path).__dict__.values())], ITERATION)


@query("SELECT event_type AS folder, round(max(value), 6) AS high, round(min(value), 6) AS low, round(avg(value), 6) AS mean FROM events WHERE event_id % 2 = 0 GROUP BY event_type")
def merged_logs(spark, sf_dir):
    """Logs in a folder for each kind; only the file merged_<folder> counts."""
    root = I.shared_path(spark, "logs")
    lines = I.table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 2 == 0, "merged_").otherwise("other_").alias("start"), F.concat_ws(" ", F.lit("a"), F.lit("|b c|"), F.lit("d"), F.col("value").cast("string")).alias("value"))
    for kind in [r[0] for r in lines.select("event_type").distinct().collect()]:  # a row a kind of event
        for start in ("merged_", "other_"):
            lines.filter((F.col("event_type") == kind) & (F.col("start") == start)).select("value").coalesce(1).write.text(f"{root}/{kind}/{start}{kind}")
    rows = text.read_timing_log(spark, f"{root}/*", merged=False)
    rows = rows.withColumn("folder", F.element_at(F.split("file", "/"), -3)).filter(F.element_at(F.split("file", "/"), -2) == F.concat(F.lit("merged_"), F.col("folder")))
    return stats.log_summary(rows, "folder", "value").select("folder", *(F.round(c, 6).alias(c) for c in ("high", "low", "mean")))


@query("SELECT b AS block, k::INTEGER AS k, (((k * 100 + 32768) % 65536) - 32768)::SMALLINT AS v FROM (SELECT unnest([0, 1]) AS b), (SELECT unnest(range((SELECT 25 * count(*) FROM nation))) AS k)")
def two_blocks(spark, sf_dir):
    return generators.two_blocks(spark, I.table(spark, sf_dir, "nation").count(), 25)


@query("SELECT unnest(range((SELECT count(*) FROM nation)))::BIGINT AS i")
def parallel_array(spark, sf_dir):
    return spark.range(I.table(spark, sf_dir, "nation").count()).withColumnRenamed("id", "i")


@query("SELECT event_id % 10 AS t_itr, avg(event_id % 7) AS mean_cg FROM events GROUP BY 1")
def mean_cg_iterations(spark, sf_dir):
    history = I.table(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("t_itr"), (F.col("event_id") % 7).alias("cg_count"))
    return stats.mean_cg_iterations(history)


@query(ORACLE["cg_step_1"])
def cg_early_end(spark, sf_dir):
    """The test fails at once: the first step moves the configuration and ends the loop."""
    c, x = I.cells(spark, sf_dir), I.configuration(spark, sf_dir)
    bc = S.matrix_points(S.b_of_z(c, x, HOT, D), x, D)
    return flat(S.conjugate_gradient(c, S.v_diagonal(c), bc, x, D, 3, threshold=1e9).x, "i")


@query(ORACLE["smacof_iteration"])
def anneal_one_step(spark, sf_dir):
    """One stress step of the relational annealing loop."""
    c, x = I.cells(spark, sf_dir), I.configuration(spark, sf_dir)
    config = ScalingConfig(dimension=D, cg_iterations=2, exact_cg=True, max_stress_loops=1, max_temp_loops=0)
    before = S.stress(c, x, HOT, D).select(F.round("stress", 6).alias("pre_stress"))
    _, history = S.anneal(c, x, HOT, 0.0, 1.0, config)
    return before.crossJoin(spark.createDataFrame([(history[-1].stress,)], "s double").select(F.round("s", 6).alias("post_stress")))


# Programs


_SUPPLIERS = "emb AS (SELECT s_suppkey AS id, [s_nationkey::DOUBLE, round(s_acctbal)] AS x FROM supplier)"


@query(_steps(3, "SELECT id::INTEGER AS cid, x FROM emb WHERE id <= 5", _SUPPLIERS, 2))
def kmeans_program(spark, sf_dir):
    """Points and centers as text files, three steps, centers as text; sizes come from one more assignment by the step before."""
    root = I.shared_path(spark, "kmeans")
    rows = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("cid"), F.array(F.col("s_nationkey").cast("double"), F.round("s_acctbal")).alias("x"))
    text.write_points(rows, f"{root}/points")
    text.write_centroids(rows.filter("cid <= 5"), f"{root}/centers")
    programs.kmeans(spark, f"{root}/points", f"{root}/centers", f"{root}/two", 2, 2)
    programs.kmeans(spark, f"{root}/points", f"{root}/two", f"{root}/three", 2, 1)
    sizes = kmeans.nearest(text.read_points(spark, f"{root}/points", 2), text.read_centroids(spark, f"{root}/two")).groupBy("cid").agg(F.count("*").alias("n"))
    return _centres(text.read_centroids(spark, f"{root}/three").join(sizes, "cid", "left").select("cid", "x", F.coalesce("n", F.lit(0)).alias("n")))


@query(f"WITH {SQL}, b AS (SELECT i AS k, unnest(range(3)) AS j FROM pts) SELECT c.i, b.j::INTEGER AS j, round(sum(c.delta * ((b.k * 7 + b.j * 3) % 11)), 6) AS v FROM cells c JOIN b ON b.k = c.j GROUP BY c.i, b.j")
def matrix_program(spark, sf_dir):
    """A stored matrix of doubles times a small one, written as text; the product of this process is the same."""
    import numpy as np

    root = I.shared_path(spark, "product")
    a = I.stored(spark, I.cells(spark, sf_dir).select("i", "j", F.col("delta").alias("v")), "a", "float64")
    b = np.array([[(k * 7 + j * 3) % 11 for j in range(3)] for k in range(25)], float)
    if programs.matrix_multiply(spark, a, 25, 25, b, root, check=True) > 1e-9:
        raise ValueError("the products differ")
    return flat(text.read_matrix_text(spark, root), "i").withColumnRenamed("k", "j")


@query()
def scaling_program(spark, sf_dir):
    """Scaling from files to files; the iterations that it wrote."""
    root = I.shared_path(spark, "scaling")
    d, w = I.stored(spark, I.distances(spark, sf_dir), "d"), I.stored(spark, I.weights(spark, sf_dir), "w")
    text.write_rows(I.configuration(spark, sf_dir), f"{root}/first")
    config = ScalingConfig(distance_file=d, weight_file=w, initial_points_file=f"{root}/first", points=25, dimension=D, alpha=0.5, cg_iterations=8, max_stress_loops=2, max_temp_loops=2, output_folder=root)
    programs.scaling(spark, config)
    return spark.read.schema(ITERATION).csv(f"{root}/iterations")


# Generators


@query()
def gaussian_mixture(spark, sf_dir):
    n = I.table(spark, sf_dir, "customer").count()
    return generators.gaussian_mixture(spark, n, 10, 2)[0].select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query()
def random_points(spark, sf_dir):
    return generators.random_points(spark, I.table(spark, sf_dir, "customer").count(), 3)
