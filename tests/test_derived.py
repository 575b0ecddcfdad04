"""Whitened channels, excursions, kernel scores, gamut mapping and the way from a stored matrix, against plain versions."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.operators import inference, manifold, points, raster, tables


def runs(values):
    """(side, begin, end, n, largest) of (lo, hi, observed) triples, one place after the other."""
    out = []
    for r, (lo, hi, v) in enumerate(values):
        side = "above" if v > hi else "below" if v < lo else None
        far = max(v - hi, lo - v)
        if side and out and out[-1][0] == side and out[-1][2] == r - 1:
            out[-1][2:] = [r, out[-1][3] + 1, max(far, out[-1][4])]
        elif side:
            out.append([side, r, r, 1, far])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", range(3))
def test_excursions_are_the_runs(spark, seed):
    rng = np.random.default_rng(seed)
    v = [[(-1.0, 1.0, float(x)) for x in np.round(rng.normal(scale=1.5, size=25), 3)] for _ in range(2)]
    rows = [(k, r, *t) for k, curve in enumerate(v) for r, t in enumerate(curve)]
    got = inference.excursions(spark.createDataFrame(rows, "k int, r int, lo double, hi double, observed double"), keys=("k",)).collect()
    for k in (0, 1):
        assert sorted((x.side, x.begin, x.end, x.n, x.largest) for x in got if x.k == k) == runs(v[k])


def test_no_excursion_of_a_curve_inside(spark):
    assert inference.excursions(spark.createDataFrame([(0, 0.0, 1.0, 1.0)], "r int, lo double, hi double, observed double")).count() == 0


def rasters(spark, seed=1, channels=4, size=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(channels, size, size)) + rng.normal(size=(1, size, size))
    x[1] = 7.0 if channels > 4 else x[1]  # a constant channel
    rows = [(c, i, j, float(x[c, i, j])) for c in range(channels) for i in range(size) for j in range(size)]
    return x, spark.createDataFrame(rows, "channel int, y int, x int, v double")


def test_whitened_channels_have_the_identity_as_covariance(spark):
    x, r = rasters(spark)
    modes = manifold.eigen_of(raster.gram(r, 1.0).select("a", "b", F.col("corr").alias("v")))
    u = raster.whitened(r, raster.whitening(modes, 4)).toPandas().pivot(index=["y", "x"], columns="mode", values="u").to_numpy()
    assert np.allclose(np.cov(u.T, bias=True), np.eye(4), atol=1e-6)
    flat = x.reshape(4, -1).T
    z = (flat - flat.mean(0)) / flat.std(0)
    inverse = np.linalg.inv(np.corrcoef(flat.T))
    got = raster.channel_probe(r, raster.whitening(modes, 4), 3, 5, 2.5).toPandas().sort_values(["y", "x"])
    d = z - z[3 * 12 + 5]
    want = np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", d, inverse, d), 0))
    assert np.allclose(got.distance, want, atol=1e-5)
    own = got[(got.y == 3) & (got.x == 5)]
    assert own.similarity.tolist() == pytest.approx([1.0]) and got.similarity.between(0, 1).all() and (got.similarity == 0).any()


def test_probe_outside_goes_to_the_edge_and_fewer_modes_are_nearer(spark):
    _, r = rasters(spark, 2)
    modes = manifold.eigen_of(raster.gram(r, 1.0).select("a", "b", F.col("corr").alias("v")))
    far = raster.channel_probe(r, raster.whitening(modes, 4), 99, -3, 2.0).toPandas().set_index(["y", "x"]).distance.sort_index()
    assert far[11, 0] == pytest.approx(0, abs=1e-9)
    near = raster.channel_probe(r, raster.whitening(modes, 2), 99, -3, 2.0).toPandas().set_index(["y", "x"]).distance.sort_index()
    assert (near <= far + 1e-9).all()


def test_collinear_channels_do_not_blow_up(spark):
    _, r = rasters(spark, 3, 2)
    twin = r.unionByName(r.where("channel = 0").withColumn("channel", F.lit(2)))
    modes = manifold.eigen_of(raster.gram(twin, 1.0).select("a", "b", F.col("corr").alias("v")))
    w = raster.whitening(modes, 3).toPandas().w.abs()
    assert np.isfinite(w).all() and w.max() <= 1.01e3


def test_self_term_of_channels_that_share_cells(spark):
    rng = np.random.default_rng(5)
    n, box, r = 40, (0.0, 0.0, 100.0, 100.0), 9.0
    xy, w = rng.uniform(5, 95, (n, 2)), rng.uniform(0, 2, (n, 3))
    rows = [(k, c, float(xy[k, 0]), float(xy[k, 1]), float(w[k, c])) for k in range(n) for c in range(3) if (k + c) % 3]
    df = spark.createDataFrame(rows, "cell long, channel int, x double, y double, w double")
    grams = spark.createDataFrame([(a, b, 1.0) for a in range(3) for b in range(3)], "a int, b int, c double")
    got = {(x.a, x.b): x.self_term for x in raster.association(grams, df, box, r, 1, weight="w", cell="cell").collect()}
    for a in range(3):
        for b in range(3):
            both = sum(w[k, a] * w[k, b] for k in range(n) if (k + a) % 3 and (k + b) % 3)
            assert got[a, b] == pytest.approx(both * 4 / (3 * np.pi * r * r))
    alone = {(x.a, x.b): x.self_term for x in raster.association(grams, df, box, r, 1, weight="w").collect()}
    assert alone[0, 0] == pytest.approx(got[0, 0]) and alone[0, 1] == 0 and raster.effective_radius(r) == 18


@pytest.mark.parametrize("name", [*points.KERNELS, "gaussian"])
def test_kernel_moments_by_quadrature(spark, name):
    r = 3.0
    t = (np.arange(40_000) + 0.5) / 40_000 * r
    df = spark.createDataFrame([(float(x * x),) for x in t[::40]], "d2 double")
    k = np.interp(t, t[::40], [v[0] for v in df.select(points.kernel_at(name, F.col("d2"), r)).collect()])
    ring = 2 * np.pi * t * r / 40_000
    mu, rough = points.kernel_moments(name, r)
    assert (k * ring).sum() == pytest.approx(1, rel=2e-3)
    assert (k * t * t / 2 * ring).sum() == pytest.approx(mu, rel=3e-3) and (k * k * ring).sum() == pytest.approx(rough, rel=3e-3)
    assert points.kernel_moments(name, points.matched_radius(name, 5.0))[0] == pytest.approx(25 / 4)


def test_kernel_scores_find_what_is_associated(spark):
    """Half of the a-cells stand in patches of b; the top hat has ties and a step, smooth kernels have neither."""
    rng = np.random.default_rng(6)
    centres = rng.uniform(100, 900, (6, 2))
    patch = lambda n: centres[rng.integers(6, size=n)] + rng.normal(size=(n, 2)) * 25
    a = [(k, *map(float, p), k < 100) for k, p in enumerate([*patch(100), *rng.uniform(0, 1000, (100, 2))])]
    b = [(1000 + k, *map(float, p)) for k, p in enumerate([*patch(300), *rng.uniform(0, 1000, (300, 2))])]
    a, b = spark.createDataFrame(a, "cell_id long, x double, y double, positive boolean"), spark.createDataFrame(b, "cell_id long, x double, y double")
    got = points.kernel_scores(a, b, (0.0, 0.0, 1000.0, 1000.0), 60.0).toPandas().set_index("kernel")
    assert set(got.index) == {*points.KERNELS, "gaussian"}
    assert (got.auc > 0.8).all() and (got.auc <= 1).all()
    assert got.tied["tophat"] > 2 * got.tied["quartic"]
    assert (got.radius_sensitivity > 0).all() and (got.jitter_sensitivity > 0).all()
    assert got.jitter_sensitivity["tophat"] > got.jitter_sensitivity["quartic"]
    assert np.allclose(got.moment2, 900)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 0.5), st.floats(-3, 6)), min_size=1, max_size=8))
def test_mapped_colours_can_be_shown_and_keep_their_hue(spark, colours):
    li, c, h = (F.col(x) for x in "lch")
    df = spark.createDataFrame([tuple(map(float, x)) for x in colours], "l double, c double, h double")
    chroma = X.gamut_chroma(li, c, h)
    rgb = X.oklch_to_srgb(li, F.col("m"), h)
    back = X.oklab_to_oklch(X.srgb_to_oklab(*[F.col(k) for k in ("r", "g", "b")]))
    mapped = df.withColumn("m", chroma)
    rows = mapped.select("*", *[v.alias(n) for n, v in zip("rgb", rgb, strict=True)]).select("*", X.in_gamut(li, F.col("m"), h).alias("ok"), *[v.alias(n) for n, v in zip(("l2", "c2", "h2"), back, strict=True)])
    for row in rows.collect():
        assert row.ok or row.m == 0
        assert row.m <= row.c + 1e-12 and all(0 <= v <= 1 for v in (row.r, row.g, row.b))
        if row.m > 0.02 and 0.15 < row.l < 0.95:  # nearly black and white have no hue to keep
            assert abs(np.angle(np.exp(1j * (row.h2 - row.h)))) < 0.02 and abs(row.l2 - row.l) < 0.01


def test_ramps_are_even_handed(spark):
    t = spark.createDataFrame([(k / 10,) for k in range(-10, 11)], "t double")
    rows = t.select("t", *[v.alias(n) for n, v in zip(("li", "c", "h"), X.diverging(F.col("t")), strict=True)]).collect()
    for a, b in zip(rows, rows[::-1], strict=True):
        assert (a.li, a.c) == pytest.approx((b.li, b.c)) and (a.t == 0 or a.h != b.h)
    light = [r[0] for r in t.where("t >= 0").select(X.sequential(F.col("t"), F.lit(1.0))[0]).collect()]
    assert (np.diff(light) > 0).all()
    half = spark.range(1).select(*X.mixed([F.lit(0.0), F.lit(2.0)], [F.lit(1.0), F.lit(4.0)], F.lit(0.5))).first()
    assert tuple(half) == (0.5, 3.0)


@pytest.mark.parametrize("k", [0, 1, 37, 499, 500, 900])
def test_bottom_k_is_exact(spark, k):
    rows = spark.range(500).select(F.col("id").alias("row"))
    got = sorted(r.row for r in tables.bottom_k(rows, F.md5(F.col("row").cast("string").cast("binary")), k).collect())
    assert got == sorted(sorted(range(500), key=lambda r: hashlib.md5(str(r).encode()).hexdigest())[:k])


def test_bottom_k_within_one_group(spark):
    rows = spark.range(50).select(F.col("id").alias("row"))
    got = tables.bottom_k(rows, F.concat(F.lit("abcd"), F.lpad(F.col("row").cast("string"), 4, "0")), 7)
    assert sorted(r.row for r in got.collect()) == list(range(7)) and got.columns == ["row"]


def test_store_dataset_is_the_plain_chain(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 9)) * np.arange(1, 10) + 1
    x[:, 4] = 3.0
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row long, features array<double>")
    scores, cols = tables.store_dataset(df, genes=5, rows=60, components=3, seed=4)
    logs = np.log1p(np.maximum(x, 0))
    want = sorted(np.argsort(-logs.var(0, ddof=1), kind="stable")[:5].tolist())
    keep = sorted(sorted(range(120), key=lambda r: hashlib.md5(f"4-{r}".encode()).hexdigest())[:60])
    assert cols == want
    got = scores.toPandas().sort_values("row")
    assert got.row.tolist() == keep
    y = logs[keep][:, cols]
    values, vectors = np.linalg.eigh(np.cov(y.T))
    plain = (y - y.mean(0)) @ vectors[:, ::-1][:, :3]
    s = np.stack(got.scores)
    assert np.allclose(np.abs(s), np.abs(plain), atol=1e-8)
    with pytest.raises(ValueError):
        tables.store_dataset(df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))), genes=5, rows=60, components=3)
