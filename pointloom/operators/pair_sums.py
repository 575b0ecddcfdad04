"""Sums over pairs of near points without a row a pair: blocks of points meet, and a task adds up what its pairs give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.neighbors import bucketed

#: Points of a block at most, about; and anchors of it that are compared at once.
BLOCK, ROWS = 4096, 32
#: Pairs tried in a task, about, and tasks at most.
TRIED, MOST_TASKS = 20_000_000, 4096


def _blocks(points: DataFrame, side: float) -> DataFrame:
    """Points with their bucket (b_x, b_y) and, in buckets of more than ``BLOCK``, their part of it (by hash)."""
    finite = bucketed(points.where(F.abs("x") < float("inf")).where(F.abs("y") < float("inf")), side)
    sizes = finite.groupBy(F.col("b_x").alias("k_x"), F.col("b_y").alias("k_y")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    on = (F.col("b_x") == F.col("k_x")) & (F.col("b_y") == F.col("k_y"))
    return finite.join(sizes, on).withColumn("part", F.pmod(F.xxhash64("cell_id"), "parts")).drop("k_x", "k_y", "parts")


def pair_sums(
    anchors: DataFrame,
    others: DataFrame,
    radius: float,
    add: Callable[[pd.DataFrame, pd.DataFrame, Iterator[tuple[slice, np.ndarray]]], pd.DataFrame | None],
    schema: str,
) -> DataFrame:
    """What ``add`` gives for pairs of points nearer than ``radius``, in rows of ``schema`` that are to be added up.

    ``add`` takes two blocks and, part of the first block by part, the squared distances of its points to all of the
    second (in order of type_id, if there is one), of which it leaves out those not nearer than the radius, and a point
    itself; it may give nothing. Blocks are buckets as wide as the radius, crowded ones in parts; a block of anchors meets each block around it
    by an equi-join on both blocks' names, so that a task holds two blocks and what is shuffled is points, not pairs.
    """
    a, c = _blocks(anchors, radius), _blocks(others, radius)
    name = ["b_x", "b_y", "part"]
    steps = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])).alias("s")
    left = a.groupBy(*name).agg(F.count("*").alias("n")).select(*[F.col(n).alias(f"a_{n}") for n in [*name, "n"]], steps)
    left = left.withColumns({"k_x": F.col("a_b_x") + F.col("s.u"), "k_y": F.col("a_b_y") + F.col("s.v")}).drop("s")
    right = c.groupBy(*name).agg(F.count("*").alias("n")).select(*[F.col(n).alias(f"c_{n}") for n in [*name, "n"]])
    meet = left.join(right, (F.col("k_x") == F.col("c_b_x")) & (F.col("k_y") == F.col("c_b_y"))).drop("k_x", "k_y")
    pair = [f"{s}_{n}" for s in "ac" for n in name]
    # bytes say little about the work of a task, so the number of tasks goes by the pairs that are tried
    tried = meet.agg(F.sum(F.col("a_n") * F.col("c_n"))).first()[0] or 0
    tasks = min(MOST_TASKS, 8 + tried // TRIED)
    meet = meet.select(*pair)

    def side(points: DataFrame, s: str) -> DataFrame:
        own = points.join(meet, [F.col(n) == F.col(f"{s}_{n}") for n in name])
        return own.select(*[F.col(p).alias(p) for p in pair], *[F.col(k).alias(k) for k in points.columns if k not in name]).repartition(tasks, *pair)

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if "type_id" in q:
            q = q.sort_values("type_id")
        px, py, qx, qy = (v.to_numpy(float) for v in (p["x"], p["y"], q["x"], q["y"]))

        def squares() -> Iterator[tuple[slice, np.ndarray]]:
            for lo in range(0, len(px), ROWS):
                part = slice(lo, lo + ROWS)
                d2, dy = qx - px[part, None], qy - py[part, None]
                d2 *= d2
                dy *= dy
                d2 += dy
                yield part, d2

        out = add(p, q, squares()) if len(p) and len(q) else None
        return pd.DataFrame(columns=names) if out is None else out[names]

    names = [part.split()[0] for part in schema.split(",")]
    return side(a, "a").groupBy(*pair).cogroup(side(c, "c").groupBy(*pair)).applyInPandas(run, schema)


def edges_of(width: float, bins: int, radius: float) -> list[float]:
    """The squared distances at which bins end: the least double that falls in the next one by floor(sqrt(d2) / width); the
    last bin ends at the radius."""
    ends = []
    for k in range(1, bins):
        t = (k * width) ** 2
        while np.floor(np.sqrt(t) / width) >= k:
            t = float(np.nextafter(t, 0))
        while np.floor(np.sqrt(t) / width) < k:
            t = float(np.nextafter(t, np.inf))
        ends.append(t)
    return [*ends, radius * radius]


def counts_of(squares: np.ndarray, ends: list[float]) -> np.ndarray:
    """Points a row in each bin."""
    upto = np.stack([np.count_nonzero(squares < e, axis=1) for e in ends], 1)
    return np.diff(upto, axis=1, prepend=0)


def itself(p: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
    """Whether a point of a block is in the other as well: it is at distance 0 of itself there."""
    return np.isin(p["cell_id"].to_numpy(), q["cell_id"].to_numpy())
