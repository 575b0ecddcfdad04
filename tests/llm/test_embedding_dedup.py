import numpy as np
import pytest

from pointloom.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, kept int"


def brute(rows, least=0.95):
    n = len(rows)
    vecs = []
    for _, v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v, np.float64) if ok else None
        vecs.append(u / np.abs(u).max() / np.linalg.norm(u / np.abs(u).max()) if ok else None)
    linked = [[j for j in range(n) if j != i and vecs[i] is not None and vecs[j] is not None and len(vecs[i]) == len(vecs[j]) and vecs[i] @ vecs[j] >= least] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *[label[j] for j in linked[i]]])
            changed |= low != label[i]
            label[i] = low
    ids = {}
    for (vec_id, _), x in zip(rows, label):
        ids[x] = min((v for v in (ids.get(x), vec_id) if v is not None), default=None)
    return sorted([(v, len(linked[k]), ids[label[k]], v is not None and v == ids[label[k]]) for k, (v, _) in enumerate(rows)], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 0) for i, v in rows], SCHEMA)


def collected(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def planted(n=150, d=16):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((n, d))
    near = base[:40] + rng.standard_normal((40, d)) * 0.15
    chain = np.stack([np.cos(np.arange(30) * 0.2), np.sin(np.arange(30) * 0.2), *np.zeros((d - 2, 30))], 1)
    rows = [[float(np.float32(x)) for x in v] for v in np.concatenate([base, near, chain, base[:20], base[:1].repeat(60, 0)])]
    return [(1000 - k, v) for k, v in enumerate(rows)]


ODD = [
    (5, None),
    (6, []),
    (7, [0.0] * 16),
    (8, [1.0, None] + [0.0] * 14),
    (9, [float("nan")] + [1.0] * 15),
    (10, [float("inf")] + [1.0] * 15),
    (11, [1.0, 2.0]),
    (12, [2.0, 4.0]),
    (12, [2.0, 4.0]),
    (None, [1.0, 2.0]),
    (None, [0.0, -3.0]),
    (13, [3e38, 3e38]),
    (14, [1e-42, 1e-42]),
    (15, [-0.0, 5.0]),
    (16, [0.0, 5.0]),
]


@pytest.mark.parametrize("block", [16, 2048])
def test_brute_force(spark, monkeypatch, block):
    """Copies, near copies, a chain, odd and repeated rows, null ids, two lengths, other columns; one block and many."""
    monkeypatch.setattr(e, "BLOCK_ROWS", block)
    rows = planted() + ODD
    assert collected(e.embedding_classes(frame(spark, rows))) == brute(rows)


def test_odd_rows_alone_and_none(spark):
    assert collected(e.embedding_classes(frame(spark, ODD[:4]))) == brute(ODD[:4])
    assert e.embedding_classes(frame(spark, [])).count() == 0


def test_recall_at_the_limit():
    """Pairs just within the limit share a key as often as the tables promise."""
    rng = np.random.default_rng(5)
    tables = e.Tables.of(50_000)
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((400, 64))
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.951 * u + np.sqrt(1 - 0.951**2) * w
    assert (tables.keys(u) == tables.keys(v)).any(axis=1).mean() >= 0.97
    assert (tables.keys(u) == tables.keys(w)).mean() < 1e-3


def test_chance_is_the_measured_one():
    rng = np.random.default_rng(6)
    for distance in (0.3, 1.4):
        a, b = rng.standard_normal(200_000) * distance, rng.uniform(0, 1, 200_000)
        assert abs((np.floor(a / e.WIDTH + b) == np.floor(b)).mean() - e.chance(distance)) < 0.01


def test_no_pairs_are_stored(spark):
    """A group of like vectors gives a forest and counts, no row a pair."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.ones((300, 8)) + rng.standard_normal((300, 8)) * 0.01)]
    nodes = e.distinct_vectors(frame(spark, rows).select("vec_id", "embedding"), "vec_id", "embedding")
    tables = e.Tables.of(300)
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    found = e.links(e.with_keys(nodes, tables))
    assert found.count() <= 2 * 300 * tables.tables
    assert collected(e.embedding_classes(frame(spark, rows))) == [(k, 299, 0, k == 0) for k in sorted(range(300), key=lambda k: str((k, 299, 0, k == 0)))]
