"""Every query of the library against its SQL on the smallest tables."""

import glob
import math

import duckdb
import numpy as np
import pytest

from pointloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def clean(rows):
    none = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(([none(v) for v in r] for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.sql(SQL[name])
    assert sorted(found.columns) == cols
    got = clean(df.select(*[f"`{c}`" for c in cols]).collect())
    want = clean(found.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b)


def ordered(low, high):
    return lambda f: (f[low] <= f[high]).all()


def symmetric(a, b, v, tolerance=1e-6):
    def check(f):
        both = f.merge(f, left_on=[a, b], right_on=[b, a], suffixes=("", "_t"))
        return len(both) == len(f) and np.allclose(both[v], both[v + "_t"], atol=tolerance, equal_nan=True)

    return check


def per(key, n):
    return lambda f: (f.groupby(key).size() == n).all()


#: What holds for the rows of queries that SQL does not express; every such query is here.
HOLDS = {
    "b2_feedback": [lambda f: len(f) == 480 and (f["v"] >= 0).all() and f["v"].sum() > 0],
    "c4_surface_normals": [lambda f: np.allclose(f.nx**2 + f.ny**2 + f.nz**2, 1, atol=1e-3)],
    "g23_wavelet_53": [lambda f: len(f) == 480 and f.v.nunique() > 1],
    "g24_wavelet_round_trip_97": [lambda f: len(f) == 480],
    "m10_fit_ab": [lambda f: abs(f.a[0] - 1.577) < 0.01 and abs(f.b[0] - 0.895) < 0.01],
    "m11_layout": [lambda f: f.row.is_unique and np.isfinite(f[["x", "y"]].to_numpy()).all() and f.x.std() > 1],
    "m3_eigenvalues": [lambda f: (np.diff(f.sort_values("k").value) <= 1e-9).all() and (f.value >= -1e-9).all()],
    "m4_pca_scores": [lambda f: np.allclose(f[[f"s{k}" for k in range(5)]].mean(), 0, atol=1e-3), lambda f: (np.diff(f[[f"s{k}" for k in range(5)]].var()) <= 1e-6).all()],
    "m6_knn_approximate": [per("i", 10), lambda f: (f.i != f.j).all(), lambda f: all((np.diff(g.sort_values("rank").dist) >= 0).all() for _, g in f.groupby("i"))],
    "m7_recall": [lambda f: 0.95 <= f.recall[0] <= 1],
    "m12_umap": [lambda f: f.row.is_unique and len(f) == 500 and np.isfinite(f[["x", "y"]].to_numpy()).all(), lambda f: f.trust.nunique() == 1 and f.trust[0] > 0.58],
    "m9_fuzzy_graph": [symmetric("head", "tail", "weight"), lambda f: f.weight.between(0, 1).all()],
    "p14_partial_correlation": [symmetric("ta", "tb", "r"), lambda f: (f[f.ta == f.tb].r.dropna() == 1).all(), lambda f: f.r.dropna().abs().le(1 + 1e-6).all()],
    "p16_swap_null": [lambda f: f.p.between(0, 1).all() and f.obs.dropna().abs().le(1).all(), lambda f: (f.ta < f.tb).all()],
    "p24_kernel_spectrum": [lambda f: np.allclose(f[f.q == 0].drop(columns="q"), 1, atol=0.02), lambda f: (f.drop(columns="q").abs() <= 1.02).all(axis=None)],
    "p29_point_hotspots": [lambda f: len(f) == 1024],
    "p33_colocation_modes": [lambda f: np.allclose(f.groupby("mode").loading.apply(lambda x: (x**2).sum()), 1, atol=1e-3), lambda f: abs(f.groupby("mode").value.first().sum() - 3) < 1e-3],
    "p34_mode_projection": [per("mode", 1024)],
    "p38_spectrum_envelope": [ordered("lo", "hi"), lambda f: f.p.between(0, 1).all()],
    "p41_block_bootstrap": [ordered("lo", "hi"), lambda f: (f.g >= 0).all()],
    "s20_store_dataset": [lambda f: len(f) == 300 and f.row.is_unique, lambda f: np.allclose(f[[f"s{k}" for k in range(5)]].mean(), 0, atol=1e-4), lambda f: (np.diff(f[[f"s{k}" for k in range(5)]].var()) <= 1e-6).all()],
    "s24_escape_time": [lambda f: f.n.between(0, 32).all() and len(f) == 48 * 32 and f.n.nunique() > 5],
    "s28_clustered_pattern": [lambda f: f.drop_duplicates().shape[0] == len(f) > 0],
    "s28_random_pattern": [lambda f: f.drop_duplicates().shape[0] == len(f) > 0],
    "s29_swiss_roll": [lambda f: np.sqrt(f.c0**2 + f.c2**2).between(4.71, 14.14).all() and f.c1.between(0, 21).all()],
    "s30_association_scene": [lambda f: (f.groupby("type_id").size() == 400).all() and f.cell_id.is_unique],
    "t5_rips_persistence": [lambda f: (f.death >= f.birth).all(), lambda f: (f[f.dim == 0].birth == 0).all(), lambda f: len(f[f.dim == 0]) == 500],
    "t6_betti_numbers": [lambda f: (f.betti >= 0).all() and (f[f.dim == 0].betti >= 1).all()],
    "t7_cubical_persistence": [lambda f: (f.death <= f.birth).all(), lambda f: (f[f.dim == 0].groupby("field").death.min() == -np.inf).all()],
    "t8_field_betti": [lambda f: (f.betti >= 0).all()],
    "x1_gray_scott": [lambda f: f[[c for c in f.columns if c in "uv"]].apply(lambda c: c.between(-1e-9, 1 + 1e-9)).all(axis=None)],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_properties_of_others(spark, name):
    frame = QUERIES[name](spark, SF).toPandas()
    for k, holds in enumerate(HOLDS[name]):
        assert holds(frame), k


def test_components_at_scale_are_the_betti_numbers(spark):
    betti = QUERIES["t6_betti_numbers"](spark, SF).where("dim = 0").select("type_id", "betti").collect()
    pieces = QUERIES["t6_components_at_scale"](spark, SF).select("type_id", "n").collect()
    assert sorted(map(tuple, betti)) == sorted(map(tuple, pieces))


def test_scores_spread_as_the_eigenvalues_say(spark):
    scores = QUERIES["m4_pca_scores"](spark, SF).toPandas()
    values = QUERIES["m3_eigenvalues"](spark, SF).toPandas().sort_values("k").value.to_numpy()
    assert np.allclose(scores[[f"s{k}" for k in range(5)]].var(), values[:5], rtol=1e-3)
