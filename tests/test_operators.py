"""Known values and properties of the engine's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import programs
from gridloom.functions import vectors as V
from gridloom.operators import collectives, extent, kmeans, matrix, stats
from gridloom.operators import scaling as S
from gridloom.sources import generators, text
from gridloom.sources.matrix import decode_shorts, read_matrix, write_matrix
from gridloom.types import ScalingConfig

N = 4


@pytest.fixture(scope="module")
def micro(spark):
    """Four points: distances 10000 |i - j|, one pair missing, one weight 0."""
    d = [(i, j, -1 if {i, j} == {0, 3} else 10000 * abs(i - j)) for i in range(N) for j in range(N)]
    w = [(i, j, 0 if {i, j} == {1, 2} else 32767) for i in range(N) for j in range(N)]
    x = [(0, [0.0, 0.0]), (1, [0.25, 0.5]), (2, [0.5, -0.25]), (3, [1.0, 0.25])]
    distances = spark.createDataFrame(d, "i long, j long, v int").withColumn("v", F.col("v").cast("smallint"))
    weights = spark.createDataFrame(w, "i long, j long, v int").withColumn("v", F.col("v").cast("smallint"))
    s = stats.cell_stats(distances, V.decode(F.col("v"))).collect()[0]
    fixed = S.zero_fix(distances, F.lit(s.positive_min))
    return distances, fixed, S.weights_join(fixed, weights).persist(), spark.createDataFrame(x, "i long, x array<double>"), s


def rows(df):
    return np.array([r.x for r in df.orderBy("i").collect()])


def test_stats_and_temperature(micro):
    distances, fixed, _, _, s = micro
    assert (s.n, s.low) == (14, 0) and s.high == pytest.approx(0.6103701895199438)
    assert s.total == pytest.approx(4.272591326639607) and s.sum_of_squares == pytest.approx(2.0490347254003667) and s.positive_min == pytest.approx(0.3051850947599719)
    t = S.init_temperature(stats.cell_stats(distances, V.decode(F.col("v"))), 2, 0.95, 0.5).collect()[0]
    assert (t.t_min, t.t_max, t.t_cur) == pytest.approx((0.07629627368999298, 0.3051850947599719, 0.2899258400219733))
    assert {r.v for r in fixed.filter("i = j").collect()} == {10000}


def test_stress_v_and_bc(micro):
    _, _, cells, x, s = micro
    for t, want in ((0.2899258400219733, 1.6295360999956943), (0.1, 0.7389315879470045), (0.0, 0.4366509414352738)):
        assert S.stress(cells, x, t, 2, 1 / s.sum_of_squares).collect()[0][0] == pytest.approx(want)
    assert [r.v for r in S.v_diagonal(cells).orderBy("i").collect()] == pytest.approx([3, 3, 3, 3])
    b = S.b_of_z(cells, x, 0.0, 2)
    assert all(abs(r.s) < 1e-12 for r in b.groupBy("i").agg(F.sum("v").alias("s")).collect())
    want = [[-0.6824146176, 0], [-0.4425650809, 0.4659818485], [0.3301332441, -0.4887642971], [0.7948464544, 0.0227824485]]
    assert rows(S.matrix_points(b, x, 2)) == pytest.approx(np.array(want), abs=1e-9)


@pytest.mark.parametrize(("steps", "r_t_r", "stress"), [(1, 0.17197648227311116, 0.3211422878070309), (2, 0.16801566023068354, 0.3967923704711328), (3, 0.011529073119985855, 0.34998150007070605)])
def test_conjugate_gradient(micro, steps, r_t_r, stress):
    _, _, cells, x, s = micro
    v, bc = S.v_diagonal(cells), S.matrix_points(S.b_of_z(cells, x, 0.0, 2), x, 2)
    got = S.conjugate_gradient(cells, v, bc, x, 2, steps, exact=True)
    assert got.r_t_r == pytest.approx(r_t_r)
    assert S.stress(cells, got.x, 0.0, 2, 1 / s.sum_of_squares).collect()[0][0] == pytest.approx(stress)
    dense = S.DenseScaling(S.dense_rows(cells).persist(), N, 2)
    start = rows(x)
    y, r, _ = dense.solve(dense.v_diagonal(), dense.bc(start, 0.0), start, steps, exact=True)
    assert y == pytest.approx(rows(got.x), abs=1e-12) and r == pytest.approx(r_t_r)
    assert dense.stress(y, 0.0, 1 / s.sum_of_squares) == pytest.approx(stress)


def test_conjugate_gradient_converges_to_solution(micro):
    _, _, cells, x, _ = micro
    dense = S.DenseScaling(S.dense_rows(cells).persist(), N, 2)
    bc, v = dense.bc(rows(x), 0.0), dense.v_diagonal()
    w = np.array([[c.w for c in cells.filter(f"i = {i}").orderBy("j").collect()] for i in range(N)])
    m = np.diag(v.ravel()) - (w - np.diag(np.diag(w)))
    y, _, done = dense.solve(v, bc, rows(x), 50, exact=True, threshold=0)
    assert y == pytest.approx(np.linalg.solve(m, bc), abs=1e-8) and done <= 50


def test_annealing_loops(micro):
    _, _, cells, x, s = micro
    dense = S.DenseScaling(S.dense_rows(cells).persist(), N, 2)
    dense.run(rows(x), 0.29, 0.076, 1 / s.sum_of_squares, ScalingConfig(dimension=2, alpha=0.5, cg_iterations=3, max_stress_loops=2, max_temp_loops=2))
    assert [(h.t_itr, h.stress_itr) for h in dense.history] == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert dense.history[-1].t_cur == 0.0
    with pytest.raises(Exception, match="broadcast|missing"):
        S.DenseScaling(S.dense_rows(cells), N + 1, 2).stress(np.zeros((N + 1, 2)), 0.0)


def lloyd(x, centres, steps):
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        centres = np.stack([x[near == c].mean(0) if n[c] else np.zeros(x.shape[1]) for c in range(len(centres))])
    return centres, n


@pytest.mark.parametrize("dense", [True, False])
def test_kmeans_against_numpy(spark, tmp_path, dense):
    rng = np.random.default_rng(4)
    x, first = rng.normal(size=(1000, 2)).round(2) * 30, rng.normal(size=(10, 2)).round(2) * 30
    (tmp_path / "p").write_text("".join(f"{a} {b}\n" for a, b in x.tolist()))
    (tmp_path / "c").write_text("".join(f"{i + 1} {a} {b}\n" for i, (a, b) in enumerate(first.tolist())))
    points, centres = text.read_points(spark, str(tmp_path / "p"), 2), text.read_centroids(spark, str(tmp_path / "c"))
    steps = 10 if dense else 2
    want, n = lloyd(x, first, steps)
    got = kmeans.kmeans(points, centres, steps, dense=dense).orderBy("cid").collect()
    assert np.array([r.x for r in got]) == pytest.approx(want, abs=1e-9) and [r.n for r in got] == n.tolist() and n.sum() == 1000
    grouped = kmeans.nearest_in_groups(points, centres, 2, cells=6).groupBy("cid").count().collect()
    assert {r.cid: r["count"] for r in grouped} == {c + 1: k for c, k in enumerate(lloyd(x, first, 1)[1].tolist()) if k}


def test_kmeans_edges(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [2.0])], "id long, x array<double>")
    centres = spark.createDataFrame([(2, [1.0]), (1, [1.0]), (3, [99.0])], "cid int, x array<double>")
    assert {r.cid for r in kmeans.nearest(points, centres).collect()} == {1}
    got = {r.cid: r.x for r in kmeans.step(points, centres, 1).collect()}
    assert got == {1: [1.0], 2: [0.0], 3: [0.0]}
    assert {r.cid: r.x for r in kmeans.step(points, centres, 1, empty="keep").collect()}[3] == [99.0]
    assert kmeans.kmeans(points, centres.limit(0), 2).count() == 0
    bad = spark.createDataFrame([(1, [float("nan")])], "id long, x array<double>")
    with pytest.raises(Exception, match="not a number"):
        kmeans.nearest(bad, centres).collect()
    with pytest.raises(Exception, match="not a number"):
        kmeans.nearest_in_groups(bad, centres, 1).collect()


@pytest.mark.parametrize("endian", ["big", "little"])
@pytest.mark.parametrize("splits", [1, 4, 50])
def test_binary_matrix(spark, tmp_path, endian, splits):
    values = np.arange(37 * 3).reshape(37, 3).astype(np.int16)
    values[0] = [-1, 32767, -32768]
    write_matrix(str(tmp_path / "m"), values, "int16", endian)
    got = read_matrix(spark, str(tmp_path / "m"), 37, 3, "int16", endian, splits).orderBy("i").collect()
    assert [r.i for r in got] == list(range(37)) and [r.data for r in got] == values.tolist()
    write_matrix(str(tmp_path / "d"), values / 3, "float64", endian)
    assert read_matrix(spark, f"file://{tmp_path}/d", 37, 3, "float64", endian, splits).orderBy("i").collect()[5].data == (values / 3)[5].tolist()


def test_shorts_by_expressions(spark):
    df = spark.createDataFrame([(bytes.fromhex("0001FFFE012C7FFF80000000"),)], "content binary")
    assert df.select(decode_shorts(F.col("content"), F.lit(6))).collect()[0][0] == [1, -2, 300, 32767, -32768, 0]


def test_fixed_point_codec(spark):
    got = spark.range(32768).select("id", V.encode(V.decode(F.col("id"))).alias("v")).filter("id <> v").orderBy("id").collect()
    assert len(got) == 448 and (got[0].id, got[0].v) == (257, 256)


def test_row_ranges():
    assert matrix.row_ranges(37, 4) == [(0, 10), (10, 9), (19, 9), (28, 9)]
    assert matrix.row_ranges(2, 3)[-1] == (2, 0)


def test_products(spark):
    left = np.random.default_rng(6).integers(-5, 6, (4, 7)).astype(float)
    b = matrix.from_column_major(list(range(21)), 7)
    assert b[:, 1].tolist() == list(range(7, 14))
    a = spark.createDataFrame([(i, v) for i, v in enumerate(left.tolist())], "i long, data array<double>")
    assert [r.data for r in matrix.matmul_dense(a, b).orderBy("i").collect()] == (left @ b).tolist()
    cells = spark.createDataFrame([(i, j, float(b[i, j])) for i in range(7) for j in range(3)], "i long, j long, v double")
    got = matrix.cells_to_rows(matrix.matmul(matrix.rows_to_cells(a), cells)).orderBy("i").collect()
    assert [r.data for r in got] == (left @ b).tolist()
    with pytest.raises(Exception, match="missing"):
        matrix.ordered_gather(a, 5).collect()


def test_array_sums(spark):
    rows = spark.createDataFrame([(k % 3, [float(k), -1.0, 0.5 * k]) for k in range(50)] + [(None, [1.0, 1.0, 1.0])], "key int, x array<double>")
    got = {r.key: (r.s, r.n) for r in matrix.array_sums(rows, "key", "x").collect()}
    assert got == {c: ([float(sum(range(c, 50, 3))), -1.0 * len(range(c, 50, 3)), 0.5 * sum(range(c, 50, 3))], len(range(c, 50, 3))) for c in range(3)}
    assert matrix.array_sums(rows.limit(0), "key", "x").count() == 0


def test_farthest(spark):
    x = np.random.default_rng(9).integers(-20, 20, (300, 2)).astype(float)
    for part in (x, x[:1], x[:2], np.ones((5, 2)), np.stack([np.arange(6.0), np.arange(6.0)], 1)):
        points = spark.createDataFrame([(i, v) for i, v in enumerate(part.tolist())], "i long, x array<double>")
        want = np.sqrt(((part[:, None] - part[None]) ** 2).sum(2)).max(1)
        assert [r.farthest for r in extent.farthest(points).orderBy("i").collect()] == pytest.approx(want.tolist())


def annealing_twin(delta, w, x, t, t_min, inverse, c):
    """The whole run over full arrays, written apart from the operators."""
    n, d = x.shape
    off = ~np.eye(n, dtype=bool)
    seen, out, t_itr = delta >= 0, [], 0
    v = np.diag(1 + np.where(off & seen, w, 0).sum(1)) - np.where(off, w, 0)

    def far(x):
        return np.linalg.norm(x[:, None] - x[None], axis=2)

    def stress(x, t):
        gap = np.sqrt(2 * d) * t if t > 1e-9 else 0
        return (w * (np.where(delta >= gap, delta - gap, 0) - far(x)) ** 2)[seen].sum() * inverse

    while True:
        pre = stress(x, t)
        for step in range(1, c.max_stress_loops + 1):
            gap, dist = np.sqrt(2 * d) * t if t > 1e-9 else 0, far(x)
            b = np.zeros((n, n))
            force = off & seen & (dist >= 1e-10) & (delta > gap)
            b[force] = -(w * (delta - gap))[force] / dist[force]
            np.fill_diagonal(b, -b.sum(1))
            r = b @ x - v @ x
            p, rr, cg, end = r, (r * r).sum(), 0, (r * r).sum() * c.cg_threshold
            while cg < c.cg_iterations and rr:
                vp = v @ p
                a, cg = rr / (p * vp).sum(), cg + 1
                x = x + a * p
                if rr < end and not c.exact_cg:
                    break
                r = r - a * vp
                p, rr = r + (r * r).sum() / rr * p, (r * r).sum()
            post = stress(x, t)
            out.append((t, post, step, t_itr, pre, t_min, cg))
            pre = post
        if t_itr == c.max_temp_loops:
            return x, out
        t_itr, t = t_itr + 1, t * c.alpha
        t = t if t >= t_min else 0.0


@pytest.mark.parametrize("exact", [True, False])
def test_whole_runs_against_numpy(spark, tmp_path, exact):
    """The program, from files to files, and the relational loop against arrays in this process; one early end among them."""
    rng = np.random.default_rng(12)
    n, d = 20, 2
    at = rng.random((n, 3))
    stored = np.round(30000 * np.linalg.norm(at[:, None] - at[None], axis=2) / 2).astype(np.int16)
    stored[3, 9] = stored[9, 3] = -1
    weights = rng.integers(0, 3, (n, n)).astype(np.int16) * 10000
    weights = np.maximum(weights, weights.T)
    x = rng.uniform(-1, 1, (n, d))
    write_matrix(str(tmp_path / "d"), stored)
    write_matrix(str(tmp_path / "w"), weights, endian="little")
    (tmp_path / "x").write_text("".join("\t".join(map(repr, row)) + "\t\n" for row in x.tolist()))
    lines = f"DistanceMatrixFile={tmp_path}/d\nWeightMatrixFile={tmp_path}/w\nInitialPointsFile={tmp_path}/x\nNumberDataPoints={n}\nTargetDimension={d}\nAlpha=.5\nCGIterations=6\nIsBigEndian=false\nMaxTempLoops=2\nMaxStressLoops=2\nOutputFolder={tmp_path}/out\nExactCGIter={str(exact).lower()}\nCGErrorThreshold=.2"
    config = ScalingConfig.read(lines)
    got = programs.scaling(spark, config)
    delta, w = stored / 32767, weights / 32767
    good = delta[delta >= 0]
    low = good[good > 0].min()
    fixed = np.where((delta >= 0) & (delta < low), np.trunc(low * 32767) / 32767, delta)
    t, t_min = 0.5 * good.max() / np.sqrt(2 * d), 0.5 * low / np.sqrt(2 * d)
    want, steps = annealing_twin(fixed, w, x, t, t_min, 1 / (good**2).sum(), config)
    assert got.points == pytest.approx(want, abs=1e-8)
    assert [tuple(h.__dict__.values()) for h in got.history] == [pytest.approx(s, rel=1e-8) for s in steps]
    assert exact or any(h.cg_count < 6 for h in got.history)
    assert np.array([r.x for r in text.read_matrix_text(spark, f"{tmp_path}/out/points").orderBy("i").collect()]) == pytest.approx(want, abs=1e-8)
    assert spark.read.text(f"{tmp_path}/out/iterations").count() == 6 and "temperature loops: 3" in {r.value for r in spark.read.text(f"{tmp_path}/out/report").collect()}
    times = [r.value.split() for r in spark.read.text(f"{tmp_path}/out/timings").collect()]
    assert [t[0] for t in times] == ["total"] + ["loop"] * 3 + ["step"] * 6
    if not exact:
        cells = spark.createDataFrame([(i, j, float(fixed[i, j]), float(w[i, j])) for i in range(n) for j in range(n)], "i long, j long, delta double, w double").persist()
        start = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, x array<double>")
        one = ScalingConfig(dimension=d, alpha=0.5, cg_iterations=3, cg_threshold=0.2, max_stress_loops=1, max_temp_loops=1)
        y, history = S.anneal(cells, start, t, t_min, 1 / (good**2).sum(), one)
        want, steps = annealing_twin(fixed, w, x, t, t_min, 1 / (good**2).sum(), one)
        assert rows(y) == pytest.approx(want, abs=1e-8) and [h.cg_count for h in history] == [s[-1] for s in steps]


def test_generator_programs(spark, tmp_path):
    programs.generate(spark, "matrix", str(tmp_path / "m"), 6, 4)
    got = np.array([r.data for r in read_matrix(spark, str(tmp_path / "m"), 6, 4, "float64").orderBy("i").collect()])
    assert got.shape == (6, 4) and set(got.ravel()) <= set(range(10))
    programs.generate(spark, "shorts", str(tmp_path / "s"), 5)
    assert read_matrix(spark, str(tmp_path / "s"), 5, 5).count() == 5
    programs.generate(spark, "points", str(tmp_path / "p"), 7, 3)
    assert {len(r.x) for r in text.read_matrix_text(spark, str(tmp_path / "p")).collect()} == {3}
    programs.generate(spark, "mixture", str(tmp_path / "g"), 30, 2, centers=4)
    assert text.read_points(spark, str(tmp_path / "g/points"), 2).count() == 30
    assert [r.cid for r in text.read_centroids(spark, str(tmp_path / "g/centers")).orderBy("cid").collect()] == [1, 2, 3, 4]
    assert programs.matrix_multiply(spark, str(tmp_path / "m"), 6, 4, np.ones((4, 2)), str(tmp_path / "o"), check=True) == 0
    (tmp_path / "logs/a").mkdir(parents=True)
    (tmp_path / "logs/a/merged_a").write_text("x y z 3\n")
    (tmp_path / "logs/a/merged_b").write_text("x y z 9\n")
    assert [r.value for r in text.read_timing_log(spark, str(tmp_path / "logs"), merged=True).collect()] == [3.0]


def test_closest_centres_are_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-3, 4, (400, 3)) * 1e4 + 1.0, rng.integers(-3, 4, (60, 3)) * 1e4 + 1.0
    near, d = kmeans.closest(x, c)
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert near.tolist() == every.argmin(1).tolist() and d.tolist() == every.min(1).tolist()


def test_text_sources(spark, tmp_path):
    (tmp_path / "p").write_text("1.5 2\n\n 3 4 \n")
    assert sorted(r.x for r in text.read_points(spark, str(tmp_path / "p"), 2).collect()) == [[1.5, 2.0], [3.0, 4.0]]
    (tmp_path / "q").write_text("1 2 3\n")
    with pytest.raises(Exception, match="invalid points"):
        text.read_points(spark, str(tmp_path / "q"), 2).collect()
    (tmp_path / "m").write_text("1\t2\t\n\n3  4\n")
    assert [(r.i, r.x) for r in text.read_matrix_text(spark, str(tmp_path / "m")).orderBy("i").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    centres = spark.createDataFrame([(1, [1.5, -2.0])], "cid int, x array<double>")
    text.write_centroids(centres, str(tmp_path / "c"))
    assert text.read_centroids(spark, str(tmp_path / "c")).collect()[0] == (1, [1.5, -2.0])
    text.write_iterations(spark, [S.Iteration(0.5, 1.25, 2, 3, 4.0, 0.1, 7)], str(tmp_path / "i"))
    assert text.read_iteration(spark, str(tmp_path / "i")) == S.Iteration(0.5, 1.25, 2, 3, 4.0, 0.1, 7)
    with pytest.raises(ValueError):
        S.Iteration.parse("1,2")
    (tmp_path / "log").write_text("a b |c d| 4\na b c 9\n")
    got = stats.log_summary(text.read_timing_log(spark, str(tmp_path / "log")), "file", "value").collect()[0]
    assert (got.high, got.low, got.mean) == (9, 4, 6.5)
    text.write_rows(spark.createDataFrame([(1, [3.0]), (0, [1.0])], "i long, x array<double>"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["1.0", "3.0"]


def test_config_and_report():
    c = ScalingConfig.read("# x\nAlpha = .5\nNumberDataPoints=100\nIsBigEndian=false\nUnknown=1\n", dimension=2, points=None)
    assert (c.alpha, c.points, c.big_endian_weights, c.dimension) == (0.5, 100, False, 2)
    assert "final stress: 1.5" in text.report(c, [S.Iteration(0.0, stress=1.5)], 1.0)


def test_generators(spark):
    points, centres = generators.gaussian_mixture(spark, 200, 4, 2)
    assert points.count() == 200 and centres.count() == 4
    assert generators.two_decimals(0.125) == "0.12" and generators.two_decimals(0.375) == "0.38"
    m = generators.symmetric_shorts(5)
    assert (m == m.T).all()
    assert generators.constant_blocks(spark, 10, 3, 4).select("data").distinct().count() <= 4
    assert all(-1 <= v <= 1 for r in generators.random_points(spark, 20, 3).collect() for v in r.x)


def test_collectives(spark):
    sent = spark.createDataFrame([(w, [w, 2 * w]) for w in (2, 0, 1)], "worker long, list array<long>")
    assert collectives.gather(sent, "worker", "list").collect()[0][0] == [[0, 0], [1, 2], [2, 4]]
    assert {r.pos: r.total for r in collectives.reduce(sent, "list").collect()} == {0: 3, 1: 6}
    assert {(r.worker, *r.total) for r in collectives.allreduce(sent, "worker", "list").collect()} == {(w, 3, 6) for w in range(3)}
    assert len(collectives.benchmark(spark, 10, 2, 2)) == 2


def test_stream(spark, tmp_path):
    from gridloom.streaming.stats import assign_stream, windowed_stats

    spark.createDataFrame([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", 3.0), ("2024-01-01 01:00:00", 5.0)], "t string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("t timestamp, v double").parquet(str(tmp_path / "s"))
    q = windowed_stats(stream, "t", "v").writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.total) for r in spark.table("stats").collect()) == [(1, 5.0), (2, 4.0)]
    spark.createDataFrame([(1, [0.0])], "id long, x array<double>").write.parquet(str(tmp_path / "p"))
    centres = spark.createDataFrame([(1, [1.0]), (2, [5.0])], "cid int, x array<double>")
    q = assign_stream(spark.readStream.schema("id long, x array<double>").parquet(str(tmp_path / "p")), centres).writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    assert [r.cid for r in spark.table("near").collect()] == [1]
