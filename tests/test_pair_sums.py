"""Sums over pairs from blocks of points against all pairs."""

import numpy as np
import pandas as pd

from pointloom.operators import pair_sums as S


def test_ends_are_those_of_the_floor():
    for width in (12.5, 25.0, 0.1, 1 / 3):
        ends = S.edges_of(width, 6, 7 * width)
        for k, e in enumerate(ends[:-1], 1):
            assert np.floor(np.sqrt(e) / width) >= k > np.floor(np.sqrt(np.nextafter(e, 0)) / width)


def test_crowded_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    x = np.random.default_rng(2).normal(size=(150, 2)) * 20
    x[:20] = x[20]  # copies
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(999, float("nan"), 0.0)], "cell_id long, x double, y double")
    ends = S.edges_of(10.0, 3, 30.0)

    def add(p, q, squares):
        n = np.concatenate([S.counts_of(d2, ends) for _, d2 in squares])
        n[S.itself(p, q), 0] -= 1
        return pd.DataFrame({"cell_id": np.repeat(p["cell_id"].to_numpy(), 3), "bin": np.tile([0, 1, 2], len(p)), "n": n.ravel()})

    rows = S.pair_sums(points, points, 30.0, add, "cell_id long, bin int, n long").groupBy("cell_id", "bin").sum("n").collect()
    got = np.zeros((150, 3), int)
    for i, k, n in rows:
        got[i, k] = n
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert (got == np.stack([((d >= 10 * k) & (d < 10 * k + 10)).sum(1) for k in range(3)], 1)).all()
