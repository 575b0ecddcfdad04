"""Operators against hand-computed values and their own invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.functions.algebra import conjugate, mul
from pointloom.operators import descent, inference, manifold, points, raster, tables, topology, wavelet
from pointloom.operators.neighbors import k_nearest, neighbour_join
from pointloom.plans.graph import Graph, Op, list_ops, register
from pointloom.streaming.stateful import read_events, run_to_memory, smoothed, windowed

BOX = (0.0, 0.0, 400.0, 400.0)


def cells(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y), t) for k, (x, y, t) in enumerate(rows)], "cell_id long, x double, y double, type_id int")


def cloud(spark, n=300, types=3, seed=0):
    rng = np.random.default_rng(seed)
    return cells(spark, [(*rng.uniform(0, 400, 2), int(rng.integers(types))) for _ in range(n)])


def test_neighbour_join_equals_all_pairs(spark):
    c = cloud(spark)
    rows = c.collect()
    want = {(a.cell_id, b.cell_id) for a in rows for b in rows if a.cell_id != b.cell_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 900}
    got = neighbour_join(c, c, 30.0).select("a_cell_id", "c_cell_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_neighbour_join_plan_is_an_equi_join(spark, capsys):
    c = cloud(spark)
    neighbour_join(c, c, 30.0).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_k_nearest_with_far_points_and_too_few(spark):
    c = cells(spark, [(0, 0, 0), (1, 0, 0), (5000, 0, 0)])
    got = {(r.i, r["rank"]): (r.j, r.dist) for r in k_nearest(c, c, 5, 1.0).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 5000.0), (1, 1): (0, 1.0), (1, 2): (2, 4999.0), (2, 1): (1, 4999.0), (2, 2): (0, 5000.0)}


def test_quadrats_of_literal_cells(spark):
    c = cells(spark, [(5, 5, 0), (15, 5, 0), (105, 5, 1), (395, 395, 1)])
    got = {(r.type_id, r.quadrat): r.n for r in points.quadrat_counts(c, BOX, 100.0).collect()}
    assert len(got) == 32 and got[0, 0] == 2 and got[1, 1] == 1 and got[1, 15] == 1 and sum(got.values()) == 4
    out = cells(spark, [(-0.001, 0, 0), (400.001, 0, 0)])
    assert sum(r.n for r in points.quadrat_counts(out, BOX, 100.0).collect()) == 2


def test_constant_type_has_no_correlation(spark):
    rows = [(x * 100 + 50, y * 100 + 50, 0) for x in range(4) for y in range(4)] + [(50, 50, 1)]
    got = {(r.ta, r.tb): r.r for r in points.row_correlation(points.quadrat_counts(cells(spark, rows), BOX, 100.0), 16).collect()}
    assert got[0, 1] is None and got[1, 1] == pytest.approx(1.0)


def test_random_cells_have_pair_correlation_near_one(spark):
    c = cloud(spark, 3000, 1, 4)
    got = [r.g for r in points.pcf_binned(c, 40.0, 4, BOX).collect()]
    assert all(abs(g - 1) < 0.12 for g in got)


def test_disk_area_far_inside_and_at_a_corner(spark):
    df = spark.createDataFrame([(200.0, 200.0, 10.0), (0.0, 0.0, 10.0), (0.0, 200.0, 10.0), (200.0, 200.0, 1000.0)], "x double, y double, r double")
    got = [r[0] for r in df.select(points.disk_box_area(F.col("r"), F.col("x"), F.col("y"), BOX)).collect()]
    assert np.allclose(got, [np.pi * 100, np.pi * 25, np.pi * 50, 160000])


def test_mark_transform_is_antisymmetric(spark):
    df = spark.createDataFrame([(m,) for m in (0.1, 0.4, 0.9, 1.0, 1.7, 2.9, 7.0)], "m double")
    for r in df.select(points.mark_transform(F.col("m"), 3.0).alias("t"), points.mark_transform(1 / F.col("m"), 3.0).alias("u")).collect():
        assert r.t == pytest.approx(-r.u)
    with pytest.raises(ValueError):
        points.mark_transform(F.col("m"), 1.0)


def test_envelope_holds_a_typical_curve_and_finds_an_odd_one(spark):
    rng = np.random.default_rng(2)
    rows = [(c, r, float(rng.normal() + (9 if c == 0 else 0))) for c in range(100) for r in range(6)]
    got = {x.r: x for x in inference.rank_envelope(spark.createDataFrame(rows, "curve int, r int, v double"), curves=100).collect()}
    assert got[3].p == pytest.approx(0.01) and got[3].observed > got[3].hi
    with pytest.raises(ValueError):
        inference.rank_envelope(spark.createDataFrame(rows, "curve int, r int, v double"), curves=10)


def test_swaps_keep_margins():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 5, (4, 9))
    start = m.copy()
    inference._swap(m, rng, 200)
    assert (m.sum(0) == start.sum(0)).all() and (m.sum(1) == start.sum(1)).all() and (m >= 0).all() and (m != start).any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=0, max_size=40), st.sampled_from(["5/3", "9/7"]))
def test_wavelet_line_round_trip(values, kind):
    x = np.array(values, float)
    assert np.allclose(wavelet.inverse(wavelet.forward(x, kind), kind), x, atol=1e-6)


def test_wavelet_of_a_constant_has_no_detail():
    low_high = wavelet.forward(np.full(11, 7.0), "5/3")
    assert (low_high[:6] == 7).all() and (low_high[6:] == 0).all()


def test_gradient_of_a_ramp(spark):
    g = spark.range(30).select((F.col("id") / 6).cast("int").alias("y"), (F.col("id") % 6).cast("int").alias("x"))
    rows = raster.gradient(g.withColumn("v", 2.0 * F.col("x") - F.col("y"))).collect()
    assert {(r.gx, r.gy) for r in rows if 0 < r.x < 5 and 0 < r.y < 4} == {(2.0, -1.0)}
    assert {r.gx for r in rows if r.x == 0} == {1.0}


def test_flat_field_has_no_hotspot(spark):
    g = spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.lit(3.0).alias("v"))
    assert {r.v for r in raster.getis_ord(g).collect()} == {0.0}


def test_quaternion_times_conjugate_is_its_squared_length(spark):
    q = F.array(*[F.lit(v) for v in (1.0, -2.0, 3.0, 0.5)])
    got = spark.range(1).select(mul(q, conjugate(q, "quaternion"), "quaternion").alias("v")).first().v
    assert np.allclose(got, [14.25, 0, 0, 0])
    with pytest.raises(ValueError):
        mul(q, q, "vec3")


def test_pca_scores_have_the_eigenvalues_as_variances(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "row long, features array<double>")
    scores, values, _ = manifold.pca(df, 3)
    s = np.array([r.scores for r in scores.collect()])
    assert np.allclose(s.var(axis=0, ddof=1), values[:3]) and np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])


def test_knn_of_a_line(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(20)], "row long, features array<double>")
    got = {(r.i, r["rank"]): r.j for r in manifold.knn(df, 2).collect()}
    assert (got[5, 1], got[5, 2], got[0, 1], got[0, 2], got[19, 1]) == (4, 6, 1, 2, 18)


def test_approximate_knn_recall(spark):
    f = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("features"))
    assert manifold.recall(descent.descent(f, 10)[0], manifold.knn(f, 10)).first().recall >= 0.9


def test_square_has_one_hole():
    x = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = topology.rips_pairs(d, 2.0)
    assert sorted(p for p in pairs if p[0] == 0) == [(0, 0, 1.0)] * 3 + [(0, 0.0, float("inf"))]
    assert [p for p in pairs if p[0] == 1] == [(1, 1.0, pytest.approx(2**0.5))]


def test_ring_in_a_grid():
    field = np.ones((3, 3))
    field[1, 1] = 5
    assert [p for p in topology.cubical_pairs(field) if p[0] == 1] == [(1, 1.0, 5.0)]


def test_csv_quotes_and_groups(spark, tmp_path):
    (tmp_path / "c.csv").write_text('x,y,kind\r\n1,2,"a ""b"", c"\r\n3,bad,t\r\n4,5,\r\n6,7,"two lines"\r\n')
    rows = tables.read_csv(spark, f"file://{tmp_path}/c.csv")
    assert rows.count() == 4
    got = {r.type_id: r for r in tables.group_cells(rows.withColumn("n", F.monotonically_increasing_id()), "x", "y", "kind", "n").collect()}
    assert set(got) == {'a "b", c', "two lines"} and all(r.skipped == 2 for r in got.values())
    assert {r.column: r.numeric for r in tables.inspect_csv(rows.withColumn("n", F.monotonically_increasing_id()), "n").collect()}["y"] == 0.75


def test_matrix_sink_refuses(spark, tmp_path):
    df, path = spark.range(3), f"file://{tmp_path}/m"
    with pytest.raises(ValueError):
        tables.write_matrix(df, path, rows=4)
    tables.write_matrix(df, path, rows=3)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_matrix(df, path)
    tables.write_matrix(df, path, force=True)


def test_square_sink_and_neighbour_parameters(spark, tmp_path):
    near = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "i long, j long, dist double")
    weights = near.selectExpr("i AS head", "j AS tail", "1.0D AS weight")
    with pytest.raises(ValueError, match="1 by 1"):
        tables.write_pairs(near, f"file://{tmp_path}/s", 1)
    tables.write_neighbors(near, weights, f"file://{tmp_path}/n", 2, {"k": 1})
    assert '"k": 1' in spark.read.parquet(f"file://{tmp_path}/n/params").first().params
    assert spark.read.parquet(f"file://{tmp_path}/n/distances").count() == 2


def test_places_and_sums_in_a_global_order(spark):
    from pointloom.operators.order import numbered, running

    rows = [(k % 3, (k * 7919) % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g int, v int, k int").repartition(5)
    got = {r.k: r.at for r in numbered(df, ["v", "k"]).collect()}
    want = {k: n for n, (_, _, k) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert got == want
    sums = {r.k: r.before for r in running(df, ["v", "k"], F.col("v"), keys=["g"]).collect()}
    assert all(sums[k] == sum(v2 for g2, v2, k2 in rows if g2 == g and (v2, k2) < (v, k)) for g, v, k in rows[:60])


def test_smoothing_over_many_runs_equals_the_recursion(spark):
    from math import exp

    from pointloom.operators.simulate import one_pole

    rows = [(u, t, float((t * 37 + u) % 101)) for u in range(2) for t in range(2500)]
    got = {(r.user_id, r.tick): r.smooth for r in one_pole(spark.createDataFrame(rows, "user_id int, tick int, v double"), 2.0).collect()}
    for u in range(2):
        y = None
        for t in range(2500):
            x = float((t * 37 + u) % 101)
            y = x if y is None else y + (1 - exp(-0.5)) * (x - y)
            assert got[u, t] == pytest.approx(y)


def test_too_many_labels(spark):
    with pytest.raises(ValueError):
        tables.observation_labels(spark.range(100).withColumn("l", F.col("id")), "l")


def test_ancestry(spark):
    p = spark.createDataFrame([(1, []), (2, [1]), (3, [1, 2]), (4, [3])], "id long, parents array<bigint>")
    assert {(r.id, r.depth) for r in tables.ancestry(p, 4).collect()} == {(4, 0), (3, 1), (1, 2), (2, 2)}


def test_expression_tree_refuses_unknown_operators():
    with pytest.raises(ValueError):
        X.lower(["frobnicate", 1], {})


def test_colour_round_trip(spark):
    df = spark.createDataFrame([(k / 20,) for k in range(21)], "c double")
    for r in df.select("c", X.linear_to_srgb(X.srgb_to_linear(F.col("c"))).alias("d")).collect():
        assert r.c == pytest.approx(r.d, abs=1e-6)


def test_graph_groups_cycles_and_checks(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "y int, x int, v double")
    g = Graph()
    g.source("a", grid)
    with pytest.raises(ValueError):
        g.op("addGrids", "a")
    with pytest.raises(KeyError):
        g.op("threshold", "nothing")
    with pytest.raises(ValueError):
        register(Op("threshold", lambda x: x))
    assert "getisOrd" in list_ops()
    group = {"double": {"inputs": ["p"], "output": "o", "nodes": [{"name": "o", "op": "addGrids", "inputs": ["p", "p"], "params": {}}]}}
    nodes = [{"name": "four", "op": "double", "inputs": ["two"], "params": {}}, {"name": "two", "op": "double", "inputs": ["a"], "params": {}}]
    import json

    built = Graph.from_json(json.dumps({"nodes": nodes, "delays": [], "groups": group}), {"a": grid})
    assert sorted(r.v for r in built.pull("four").collect()) == [4.0, 12.0]
    loop = [{"name": "p", "op": "threshold", "inputs": ["q"], "params": {}}, {"name": "q", "op": "threshold", "inputs": ["p"], "params": {}}]
    with pytest.raises(ValueError, match="cycle"):
        Graph.from_json(json.dumps({"nodes": loop, "delays": []}), {"a": grid})
    own = {"g": {"inputs": ["p"], "output": "o", "nodes": [{"name": "o", "op": "g", "inputs": ["p"], "params": {}}]}}
    with pytest.raises(ValueError, match="itself"):
        Graph.from_json(json.dumps({"nodes": [{"name": "z", "op": "g", "inputs": ["a"], "params": {}}], "delays": [], "groups": own}), {"a": grid})


def test_streams_equal_batch(spark, tmp_path):
    src = f"file://{tmp_path}/events"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(src)
    got = run_to_memory(windowed(read_events(spark, src)), "w1", "complete", f"{tmp_path}/c1").collect()
    want = events.groupBy(F.window("ts", "1 day"), "event_type").count().collect()
    assert sorted(r.n for r in got) == sorted(r["count"] for r in want)
    state = {r.user_id: r for r in run_to_memory(smoothed(read_events(spark, src), 4.0), "w2", "update", f"{tmp_path}/c2").collect()}
    from pointloom.operators.simulate import one_pole
    from pointloom.sources.tables import series

    batch = one_pole(series(spark, "/root/testdata/sf0.001"), 4.0)
    last = {r.user_id: r for r in batch.groupBy("user_id").agg(F.max(F.struct("tick", "smooth")).alias("m")).collect()}
    assert all(state[u].smooth == pytest.approx(r.m.smooth) and state[u].ticks == r.m.tick + 1 for u, r in last.items())
