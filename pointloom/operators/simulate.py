"""Iterated fields and bodies, smoothers, delays: one plan a step, cut by checkpoints where a loop is long."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.rng import uniform
from pointloom.operators.lineage import cut
from pointloom.operators.neighbors import neighbour_join
from pointloom.operators.raster import laplacian


def gray_scott_seed(grid: DataFrame, width: int, height: int) -> DataFrame:
    """u = 1 and v = 0, but for a square in the middle."""
    half = max(2, min(width, height) // 10)
    inside = (F.abs(F.col("x") - width // 2) <= half) & (F.abs(F.col("y") - height // 2) <= half)
    return grid.select("y", "x", F.when(inside, 0.5).otherwise(1.0).alias("u"), F.when(inside, 0.25).otherwise(0.0).alias("v"))


def gray_scott(state: DataFrame, steps: int, *, du=0.16, dv=0.08, feed=0.06, kill=0.062, dt=1.0, every: int = 4) -> DataFrame:
    for k in range(steps):
        s = laplacian(laplacian(state, "u", "lu"), "v", "lv")
        uvv = F.col("u") * F.col("v") * F.col("v")
        u = F.col("u") + dt * (du * F.col("lu") - uvv + feed * (1 - F.col("u")))
        v = F.col("v") + dt * (dv * F.col("lv") + uvv - (feed + kill) * F.col("v"))
        state = s.select("y", "x", u.alias("u"), v.alias("v"))
        if (k + 1) % every == 0 and k + 1 < steps:
            state = cut(state)
    return state


def feedback(start: DataFrame, step, ticks: int, *, every: int = 4) -> DataFrame:
    """A unit delay around a step: each tick sees the last one's result."""
    state = start
    for k in range(ticks):
        state = step(state)
        if (k + 1) % every == 0 and k + 1 < ticks:
            state = cut(state)
    return state


def delayed(series: DataFrame, k: int, initial: float, *, key: str = "user_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("tick")
    return series.withColumn("delayed", F.lag("v", k, initial).over(w))


def sample_back(series: DataFrame, age: float, *, key: str = "user_id", cubic: bool = False) -> DataFrame:
    """Adds ``sample``: the value a fractional number of ticks ago, linear or Catmull-Rom, clamped to the first."""
    w = Window.partitionBy(key).orderBy("tick")
    first = F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = lambda k: F.col("v") if k == 0 else F.lead("v", -k).over(w) if k < 0 else F.coalesce(F.lag("v", k).over(w), first)
    whole, t = int(age), age - int(age)
    p1, p2 = at(whole), at(whole + 1)
    if not cubic:
        return series.withColumn("sample", p1 + (p2 - p1) * t)
    p0 = at(whole - 1) if whole else p1
    p3 = at(whole + 2)
    value = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)
    return series.withColumn("sample", value)


def one_pole(series: DataFrame, tau: float, dt: float = 1.0, *, key: str = "user_id") -> DataFrame:
    """key, tick, smooth: exponential smoothing that begins at the first value.

    With b = 1 - a, smooth at place n is b**n times (v0 plus the sum of a v / b**k over the places k up to n). Powers of
    b run out of range, so a key's ticks are cut into runs; a run's value at its begin folds what the runs
    before it left, and both are window sums and a fold over as many elements as a key has runs.
    """
    a, length = 1 - exp(-dt / tau), max(1, min(4096, int(200 * tau / dt)))
    b, each = 1 - a, Window.partitionBy(key).orderBy("tick")
    rows = series.select(key, "tick", "v").withColumn("n", F.row_number().over(each) - 1)
    rows = rows.withColumns({"run": F.floor(F.col("n") / length), "k": F.col("n") % length})
    term = F.when(F.col("n") == 0, F.col("v")).otherwise(a * F.col("v")) * F.pow(F.lit(b), -F.col("k"))
    inside = Window.partitionBy(key, "run").orderBy("k")
    rows = rows.withColumn("own", F.sum(term).over(inside) * F.pow(F.lit(b), F.col("k")))
    last = rows.groupBy(key, "run").agg(F.max_by("own", "k").alias("left"), F.max("k").alias("size"))
    ends = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "left", "size"))).alias("runs"))
    zero = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("all"))
    step = lambda s, x: F.struct((s["y"] * F.pow(F.lit(b), x["size"] + 1) + x["left"]).alias("y"), F.concat(s["all"], F.array(s["y"])).alias("all"))
    begins = ends.select(key, F.posexplode(F.aggregate("runs", zero, step, lambda s: s["all"])).alias("run", "start"))
    rows = rows.join(begins, [key, "run"])
    return rows.select(key, "tick", (F.col("own") + F.col("start") * F.pow(F.lit(b), F.col("k") + 1)).alias("smooth"))


# --- bodies -----------------------------------------------------------------------------------------------------


def constrain(x: Column, y: Column, z: Column, radius: float, strength: float) -> list[Column]:
    """Pull back of what is outside a sphere."""
    r = F.sqrt(x * x + y * y + z * z)
    pull = F.when(r > radius, -strength * (r - radius) / r).otherwise(0.0)
    return [pull * c for c in (x, y, z)]


def vortex(x: Column, y: Column, strength: float) -> list[Column]:
    return [-strength * y, strength * x, F.lit(0.0)]


def orbit(x: Column, y: Column, z: Column, strength: float) -> list[Column]:
    """Attraction to the axis with a turn around it."""
    return [-strength * x - strength * y, -strength * y + strength * x, -strength * z]


def neighbour_forces(points: DataFrame, radius: float, *, cohere: float = 0.0, separate: float = 0.0, spring: float = 0.0, rest: float = 0.0) -> DataFrame:
    """id, n, fx, fy, fz: pull to the neighbours' mean, push from near ones, springs to a rest length."""
    pairs = neighbour_join(points, points, radius, axes=("x", "y", "z"), ids=("id", "id"))
    d = F.sqrt("d2")
    aggs = [F.count("*").alias("n")]
    for c in "xyz":
        gap = F.col(f"c_{c}") - F.col(f"a_{c}")
        push = F.when(d > 0, -gap / d * (1 - d / radius)).otherwise(0.0)
        pull = F.when(d > 0, gap / d * (d - rest)).otherwise(0.0)
        aggs.append((cohere * F.avg(gap) + separate * F.sum(push) + spring * F.sum(pull)).alias(f"f{c}"))
    sums = pairs.groupBy(F.col("a_id").alias("id")).agg(*aggs)
    return points.select("id").join(sums, "id", "left").fillna(0, ["n"]).fillna(0.0, ["fx", "fy", "fz"])


def partner_orbit(points: DataFrame, step: int, strength: float) -> DataFrame:
    """id, fx, fy, fz: attraction to the point ``step`` places further in order of id, around the end."""
    n = points.count()
    nxt = points.select(F.pmod(F.col("id") - step, F.lit(n)).alias("id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    return points.join(nxt, "id").select("id", *[(strength * (F.col(f"p{c}") - F.col(c))).alias(f"f{c}") for c in "xyz"])


def integrate(x: Column, v: Column, force: Column, last_force: Column, dt: float, jerk: float) -> tuple[Column, Column, Column]:
    """Position, velocity and force after a step; the force changes by ``jerk * dt`` at most."""
    f = last_force + F.greatest(F.lit(-jerk * dt), F.least(F.lit(jerk * dt), force - last_force))
    v2 = v + f * dt
    return x + v2 * dt, v2, f


def wright_fisher_step(field: DataFrame, offsets: list[tuple[int, int, float]], selection: float, recombination: float) -> DataFrame:
    """One generation of two-locus haplotypes (p00, p01, p10, p11) gathered from weighted neighbours, with selection
    on the derived allele of the first locus and recombination; adds ``ld``, the loci's correlation."""
    h = ("p00", "p01", "p10", "p11")
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for dx, dy, w in offsets])
    sent = field.select("y", "x", *h, F.inline(table)).select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "w", *h)
    mixed = field.select("y", "x").join(sent, ["y", "x"]).groupBy("y", "x").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in h])
    fit = {"p00": 1.0, "p01": 1.0, "p10": 1.0 + selection, "p11": 1.0 + selection}
    total = sum((F.col(c) * fit[c] for c in h[1:]), F.col("p00") * fit["p00"])
    mixed = mixed.select("y", "x", *[(F.col(c) * fit[c] / total).alias(c) for c in h])
    d = recombination * (F.col("p00") * F.col("p11") - F.col("p01") * F.col("p10"))
    new = mixed.select("y", "x", (F.col("p00") - d).alias("p00"), (F.col("p01") + d).alias("p01"), (F.col("p10") + d).alias("p10"), (F.col("p11") - d).alias("p11"))
    pa, pb = F.col("p10") + F.col("p11"), F.col("p01") + F.col("p11")
    spread = pa * (1 - pa) * pb * (1 - pb)
    ld = F.when(spread > 1e-15, (F.col("p11") - pa * pb) / F.sqrt(spread)).otherwise(0.0)
    return new.withColumn("ld", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ld)))


# --- point patterns ---------------------------------------------------------------------------------------------


def random_pattern(spark, n: int, box: tuple[float, float, float, float], seed: int, types: int = 1) -> DataFrame:
    """Completely random cells."""
    u = lambda tag: uniform(F.lit(f"{seed}-{tag}"), F.col("id"))
    return spark.range(n).select(
        F.col("id").alias("cell_id"), (box[0] + (box[2] - box[0]) * u("x")).alias("x"), (box[1] + (box[3] - box[1]) * u("y")).alias("y"), F.floor(u("t") * types).cast("int").alias("type_id")
    )


def clustered_pattern(spark, parents: int, each: int, sigma: float, box: tuple[float, float, float, float], seed: int) -> DataFrame:
    """Gaussian offspring of random parents; pair correlation 1 + exp(-r²/4σ²) / (4πσ²κ), κ the parents' density."""
    from pointloom.functions.expressions import gaussian

    u = lambda tag, *k: uniform(F.lit(f"{seed}-{tag}"), *k)
    p = spark.range(parents * each).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / each).alias("parent"))
    at = lambda c, lo, hi: lo + (hi - lo) * u(f"p{c}", F.col("parent")) + sigma * gaussian(u(f"g{c}", F.col("cell_id")), u(f"h{c}", F.col("cell_id")))
    return p.select("cell_id", at("x", box[0], box[2]).alias("x"), at("y", box[1], box[3]).alias("y"), F.lit(0).alias("type_id"))
