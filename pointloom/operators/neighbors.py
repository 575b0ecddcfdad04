"""Neighbour joins on a bucket grid, and k nearest neighbours by growing rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.lineage import cut


def bucketed(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Points with the bucket number of each axis (``b_<axis>``)."""
    return points.withColumns({f"b_{a}": F.floor(F.col(a) / size).cast("long") for a in axes})


def squared(axes: Sequence[str] = ("x", "y"), left: str = "a_", right: str = "c_") -> Column:
    terms = [(F.col(f"{right}{a}") - F.col(f"{left}{a}")) * (F.col(f"{right}{a}") - F.col(f"{left}{a}")) for a in axes]
    return sum(terms[1:], terms[0])


def neighbour_join(
    anchors: DataFrame,
    others: DataFrame,
    radius: float,
    *,
    axes: Sequence[str] = ("x", "y"),
    keys: Sequence[str] = (),
    inclusive: bool = False,
    ids: tuple[str, str] | None = ("cell_id", "cell_id"),
) -> DataFrame:
    """Pairs nearer than ``radius`` (``a_*`` and ``c_*`` columns, ``d2``); with ``ids`` a point is not its own neighbour.

    Each anchor goes to the buckets around its own and meets the others in an equi-join on the bucket, so that no pair
    outside neighbouring buckets is made; Spark may split a crowded bucket. ``keys`` must be equal as well.
    """
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = bucketed(anchors, radius, axes).select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], *[f"b_{x}" for x in axes])
    for x in axes:
        a = a.withColumn("step", F.explode(near)).withColumn(f"b_{x}", F.col(f"b_{x}") + F.col("step")).drop("step")
    c = bucketed(others, radius, axes).select(*[F.col(k).alias(f"c_{k}") for k in others.columns], *[f"b_{x}" for x in axes])
    a = a.withColumns({f"k_{k}": F.col(f"a_{k}") for k in keys})
    c = c.withColumns({f"k_{k}": F.col(f"c_{k}") for k in keys})
    on = [*[f"b_{x}" for x in axes], *[f"k_{k}" for k in keys]]
    pairs = a.join(c, on).withColumn("d2", squared(axes))
    pairs = pairs.where(F.col("d2") <= radius * radius if inclusive else F.col("d2") < radius * radius)
    if ids:
        pairs = pairs.where(F.col(f"a_{ids[0]}") != F.col(f"c_{ids[1]}"))
    return pairs.drop(*on)


def k_nearest(
    anchors: DataFrame,
    points: DataFrame,
    k: int,
    start: float | None = None,
    *,
    axes: Sequence[str] = ("x", "y"),
    same: bool = True,
    id_col: str = "cell_id",
) -> DataFrame:
    """i, rank, j, dist: the k nearest points of each anchor (ties by id; fewer if there are no more).

    Rings grow twofold from a radius at which k points are expected (or ``start``). An anchor is done when its k-th
    neighbour lies inside the ring, so that each round joins only anchors in sparse surroundings; the driver sees one
    count a round.
    """
    n_points = F.count("*").alias("n")
    bounds = points.agg(*[F.min(a).alias(f"lo{n}") for n, a in enumerate(axes)], *[F.max(a).alias(f"hi{n}") for n, a in enumerate(axes)], n_points).first()
    outer = anchors.agg(*[F.min(a).alias(f"lo{n}") for n, a in enumerate(axes)], *[F.max(a).alias(f"hi{n}") for n, a in enumerate(axes)]).first()
    if bounds is None or bounds[0] is None or outer[0] is None:
        return anchors.limit(0).select(F.col(id_col).alias("i"), F.lit(0).alias("rank"), F.col(id_col).alias("j"), F.lit(0.0).alias("dist"))
    n = len(axes)
    reach = sum((max(bounds[n + m], outer[n + m]) - min(bounds[m], outer[m])) ** 2 for m in range(n)) ** 0.5 + 1e-9
    order = Window.partitionBy("i").orderBy("d2", "j")
    sides = [max(bounds[n + m] - bounds[m], reach * 1e-3) for m in range(n)]
    volume = 1.0
    for side in sides:
        volume *= side
    left, found, radius = anchors, None, start or 0.8 * (volume * (k + 1) / bounds["n"]) ** (1 / n)
    while True:
        last = radius > reach
        pairs = neighbour_join(left, points, radius, axes=axes, ids=(id_col, id_col) if same else None)
        ranked = pairs.select(F.col(f"a_{id_col}").alias("i"), F.col(f"c_{id_col}").alias("j"), "d2")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not last:
            full = ranked.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") == k).select("i")
            ranked = cut(ranked.join(full, "i", "left_semi"))  # the next rounds leave these anchors out
            left = cut(left.join(ranked.select(F.col("i").alias(id_col)).distinct(), id_col, "left_anti"))
        found = ranked if found is None else found.unionByName(ranked)
        if last or left.isEmpty():
            return found.select("i", "rank", "j", F.sqrt("d2").alias("dist"))
        radius *= 2
