"""Minimum spanning forests by Borůvka's rounds, and what they say about components at every scale at once."""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.graphs import components
from pointloom.operators.lineage import stored
from pointloom.operators.neighbors import bucketed, neighbour_join
from pointloom.operators.order import numbered

#: Times that a radius is quartered to begin with.
MOST_STEPS = 8


def spanning_forest(edges: DataFrame) -> DataFrame:
    """i, j, d of the minimum spanning forest of (i, j, d), one edge a pair; ties go by i, then j, so it is the only one."""
    return _forest(edges.select(F.col("i").alias("a"), F.col("j").alias("b"), F.struct("d", "i", "j").alias("e")))[0]


def _forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest (i, j, d) of edges (d, i, j) between nodes a and b, and node, root: the smallest node it is connected to.

    Each round every component takes its least edge, components that meet become one, and of the edges between two
    components only the least stays. Components at least halve a round, and the driver sees one flag of it.
    """
    live = stored(edges.select("a", "b", "e"))
    forest = live.select("e")
    forest = forest.where("false")
    links = live.select("a", "b").where("false")
    while not live.isEmpty():
        sides = live.select(F.col("a").alias("c"), "e", "a", "b").unionByName(live.select(F.col("b").alias("c"), "e", "a", "b"))
        least = sides.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("m")).select("m.e", "m.a", "m.b").distinct()
        least = stored(least)
        forest = forest.unionByName(least.select("e"))
        links = links.unionByName(least.select("a", "b"))
        nodes = least.select(F.col("a").alias("node")).unionByName(least.select(F.col("b").alias("node"))).distinct()
        roots = components(nodes, least.select(F.col("a").alias("i"), F.col("b").alias("j")))
        ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        live = live.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
        live = stored(live.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return forest.select("e.i", "e.j", "e.d"), components(ends, links.select(F.col("a").alias("i"), F.col("b").alias("j")))


def _between(points: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """i, j, d, and a, b: pairs of points (cell_id, x, y, root) up to a radius in different components, and their roots.

    Only points of buckets beside (or with) another component are joined, so a crowd in one component costs nothing.
    """
    in_bucket = bucketed(points, radius).withColumns({f"k{n}": F.col(k) for n, k in enumerate(keys)})
    on = ["b_x", "b_y", *[f"k{n}" for n in range(len(keys))]]
    # a bucket and its neighbours, by their least and largest component: they differ if there are two around it
    held = in_bucket.groupBy(*on).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    steps = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])).alias("s")
    around = held.select(*on, "lo", "hi", steps)
    around = around.withColumns({"b_x": F.col("b_x") + F.col("s.u"), "b_y": F.col("b_y") + F.col("s.v")})
    mixed = around.groupBy(*on).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(*on)
    some = in_bucket.join(mixed, on, "left_semi").select("cell_id", "x", "y", "root", *keys)
    # of two components one is not the largest of its key: its points look for the others
    sizes = points.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(*keys).agg(F.max_by("root", F.struct("n", "root")).alias("root")).select("root")
    few = some.join(F.broadcast(largest), "root", "left_anti").select(*some.columns)
    near = neighbour_join(few, some.join(F.broadcast(largest.withColumn("large", F.lit(True))), "root", "left"), radius, keys=keys, inclusive=True)
    near = near.where("a_root <> c_root AND (c_large OR a_cell_id < c_cell_id)")
    i, j = F.least("a_cell_id", "c_cell_id").alias("i"), F.greatest("a_cell_id", "c_cell_id").alias("j")
    return near.select(i, j, F.sqrt("d2").alias("d"), F.col("a_root").alias("a"), F.col("c_root").alias("b"))


def component_deaths(points: DataFrame, radius: float, *, keys: Sequence[str] = ()) -> DataFrame:
    """(keys,) i, j, death: the distances at which components of the points (cell_id, x, y) of a key merge, up to a
    radius. All components are born at 0.

    The radius grows fourfold from one at which a point has some ten neighbours; each time only pairs of different components
    are made, so that pairs do not grow with the square of a crowd. Points at one place hang on the smallest id there,
    which alone meets the others: so the edges are those of the forest of all pairs in the order (d, i, j).
    """
    points = points.where(F.abs("x") < float("inf")).where(F.abs("y") < float("inf"))
    places = points.groupBy(*keys, "x", "y").agg(F.min("cell_id").alias("first"))
    own = stored(points.join(places, [*keys, "x", "y"]).select(*keys, "cell_id", "x", "y", "first"))
    copies = own.where("cell_id <> first").select(F.col("first").alias("i"), F.col("cell_id").alias("j"), F.lit(0.0).alias("d"))
    alone = own.where("cell_id = first").select(*keys, "cell_id", "x", "y")
    crowd = alone.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    first = crowd.where("n > 1").agg(F.min(F.sqrt(F.greatest("sx", F.lit(1e-6)) * F.greatest("sy", F.lit(1e-6)) * 2 / F.col("n")))).first()[0]
    if first is None:
        forest = copies
    else:
        steps = min(round(log2(radius / (3 * first)) / 2), MOST_STEPS) if radius > 3 * first else 0
        live, forest = alone.withColumn("root", F.col("cell_id")), copies
        for step in range(steps, -1, -1):
            edges = stored(_between(live, radius / 4**step, keys))
            if step == 0 or not edges.isEmpty():
                # the forest of the components: of the edges between two of them only the least can be in it
                least = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("d", "i", "j")).alias("e"))
                found, joined = _forest(least)
                forest = forest.unionByName(found)
                if step:
                    moved = live.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
                    live = stored(moved.select(*keys, "cell_id", "x", "y", F.coalesce("to", "root").alias("root")))
    named = own.select(*keys, F.col("cell_id").alias("i"))
    return forest.join(named, "i").select(*keys, "i", "j", F.col("d").alias("death"))


def pieces_at(points: DataFrame, radius: float, key: str) -> DataFrame:
    """key, n: components of each key's points (cell_id, x, y) linked up to a radius (inclusive).

    Points of one bucket whose diagonal is below the radius are linked, so buckets are the nodes. Two buckets are linked if
    any of their points are: tried first for the extreme points of each in eight directions, then for all points of those
    pairs of buckets that are in different components still. So links between crowded buckets are not made.
    """
    points = points.select(key, "cell_id", "x", "y")
    placed = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col(key).isNotNull()
    alone = points.where(~F.coalesce(placed, F.lit(False))).groupBy(key).agg(F.count("*").alias("n"))
    node = F.min("cell_id").over(Window.partitionBy(key, "b_x", "b_y"))
    own = stored(bucketed(points.where(placed), radius * (2**-0.5 - 1e-6)).withColumn("node", node))
    ways = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    ends = own.groupBy(key, "node", "b_x", "b_y").agg(F.array(*[f(F.struct("x", "y"), w) for w in ways for f in (F.max_by, F.min_by)]).alias("ends"))
    ends = ends.select(key, "node", "b_x", "b_y", F.inline(F.array_distinct("ends")))

    def linked(side: DataFrame) -> DataFrame:
        steps = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in range(-2, 3) for v in range(-2, 3)])).alias("s")
        a = side.select(F.col(key).alias("k"), F.col("node").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in side.columns if c == "root"], "b_x", "b_y", steps)
        a = a.withColumns({"k_x": F.col("b_x") + F.col("s.u"), "k_y": F.col("b_y") + F.col("s.v")}).drop("b_x", "b_y", "s")
        on = (F.col("k") == F.col(key)) & (F.col("k_x") == F.col("b_x")) & (F.col("k_y") == F.col("b_y")) & (F.col("i") < F.col("node"))
        if "root" in side.columns:
            on = on & (F.col("a_root") != F.col("root"))
        d2 = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
        return a.join(side, on).where(d2 <= radius * radius).select("i", F.col("node").alias("j")).distinct()

    first = stored(components(own.select("node"), linked(ends)))
    split = own.join(first, "node").select(key, "node", "x", "y", "b_x", "b_y", "root")
    # buckets around which there is one component only need no second look
    around = split.select(key, "b_x", "b_y", "root").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in range(-2, 3) for v in range(-2, 3)])).alias("s")
    around = around.select(key, "root", "b_x", "b_y", steps).withColumns({"b_x": F.col("b_x") + F.col("s.u"), "b_y": F.col("b_y") + F.col("s.v")})
    mixed = around.groupBy(key, "b_x", "b_y").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(key, "b_x", "b_y")
    more = linked(split.join(mixed, [key, "b_x", "b_y"], "left_semi")).select(F.col("i").alias("node"), "j")
    name = first.select(F.col("node").alias("j"), F.col("root").alias("to"))
    more = more.join(first, "node").join(name, "j").select(F.col("root").alias("i"), F.col("to").alias("j"))
    roots = components(first.select(F.col("root").alias("node")), more).where("node = root").select("node")
    pieces = own.select(key, F.col("cell_id").alias("node")).join(roots, "node").groupBy(key).agg(F.count("*").alias("n"))
    return pieces.unionByName(alone).groupBy(key).agg(F.sum("n").alias("n"))


def component_counts(points: DataFrame, deaths: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """(keys,) scale, n: how many components there are from each scale on, beginning with all points at 0."""
    all_points = points.groupBy(*keys).agg(F.count("*").alias("points"))
    merged = numbered(deaths, ["death", "i", "j"], keys=keys, name="at")
    merged = merged.groupBy(*keys, F.col("death").alias("scale")).agg((F.max("at") + 1).alias("merged"))
    first = all_points.select(*keys, F.lit(0.0).alias("scale"), F.col("points").alias("n"))
    joined = merged.join(all_points, list(keys)) if keys else merged.withColumn("one", F.lit(1)).join(all_points.withColumn("one", F.lit(1)), "one")
    later = joined.select(*keys, "scale", (F.col("points") - F.col("merged")).alias("n"))
    return first.unionByName(later).groupBy(*keys, "scale").agg(F.min("n").alias("n"))
