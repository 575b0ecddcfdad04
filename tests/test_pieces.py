"""Pieces of points linked within a radius, counted over buckets, against all pairs."""

import numpy as np

from pointloom.operators import forest as O


def test_pieces_are_those_of_all_pairs(spark):
    x = np.concatenate([np.random.default_rng(3).normal(size=(120, 2)) * 60, [[300, 0], [310, 0], [320, 0], [0, 310], [0, 310]]])
    rows = [(k, float(a), float(b), k % 2) for k, (a, b) in enumerate(x)] + [(900, None, 0.0, 0), (901, float("nan"), 0.0, 1)]
    got = {r.t: r.n for r in O.pieces_at(spark.createDataFrame(rows, "cell_id long, x double, y double, t int"), 20.0, "t").collect()}
    for t in (0, 1):
        own = x[t::2]
        near = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) <= 20
        for _ in own:
            near = near | ((near.astype(int) @ near) > 0)
        assert got[t] == len({tuple(r) for r in near}) + 1
