"""Operators on long grids (y, x, v): stencils by edge-padded windows, density splats, hotspots, vector calculus."""

from __future__ import annotations

from math import ceil, exp, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def line(along: str) -> Window:
    """One row (``along`` = x) or column of a grid as a window; a grid has as many tasks as lines."""
    return Window.partitionBy("y" if along == "x" else "x").orderBy(along)


def shifted(v: Column, step: int, along: str, size: int) -> Column:
    """The value ``step`` places further along an axis, clamped to the edge."""
    w = line(along)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if step >= 0:
        return F.coalesce(F.lead(v, step).over(w), F.last(v).over(full)) if step else v
    return F.coalesce(F.lag(v, -step).over(w), F.first(v).over(full))


def gaussian_weights(radius: int, sigma: float = 0.0) -> list[float]:
    s = sigma or radius / 3
    w = [exp(-k * k / (2 * s * s)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def convolve(grid: DataFrame, weights: list[float], *, value: str = "v") -> DataFrame:
    """Separable convolution, rows then columns, clamped at the edges."""
    radius = len(weights) // 2
    for along in ("x", "y"):
        terms = [F.lit(w) * shifted(F.col(value), k - radius, along, 0) for k, w in enumerate(weights)]
        grid = grid.withColumn(value, sum(terms[1:], terms[0]))
    return grid


def box_sum(grid: DataFrame, radius: int, *, value: str = "v") -> DataFrame:
    return convolve(grid, [1.0] * (2 * radius + 1), value=value)


def getis_ord(grid: DataFrame, radius: int = 2) -> DataFrame:
    """z of the Gi* statistic in each cell; 0 where the field does not vary or the window exceeds it."""
    s = grid.agg(F.avg("v").alias("mu"), F.avg(F.col("v") * F.col("v")).alias("m2"), F.count("*").alias("n"))
    w = float((2 * radius + 1) ** 2)
    spread = F.when(F.col("n") > w, F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("mu") * F.col("mu")) * w * (F.col("n") - w) / (F.col("n") - 1)))
    s = s.select("mu", F.coalesce(spread, F.lit(0.0)).alias("sd"), F.lit(1).alias("one"))
    both = box_sum(grid, radius).withColumn("one", F.lit(1)).join(F.broadcast(s), "one")
    return both.select("y", "x", F.when(F.col("sd") > 0, (F.col("v") - F.col("mu") * w) / F.col("sd")).otherwise(0.0).alias("v"))


def gradient(grid: DataFrame, value: str = "v") -> DataFrame:
    """gx, gy: central differences, halved; the edge counts as its own neighbour."""
    v = F.col(value)
    return grid.withColumns(
        {
            "gx": (shifted(v, 1, "x", 0) - shifted(v, -1, "x", 0)) * 0.5,
            "gy": (shifted(v, 1, "y", 0) - shifted(v, -1, "y", 0)) * 0.5,
        }
    )


def laplacian(grid: DataFrame, value: str = "v", out: str = "lap") -> DataFrame:
    v = F.col(value)
    around = [shifted(v, s, a, 0) for a in ("x", "y") for s in (-1, 1)]
    return grid.withColumn(out, sum(around[1:], around[0]) - 4 * v)


def divergence(field: DataFrame) -> DataFrame:
    """div of (gx, gy)."""
    gx, gy = F.col("gx"), F.col("gy")
    d = (shifted(gx, 1, "x", 0) - shifted(gx, -1, "x", 0)) * 0.5 + (shifted(gy, 1, "y", 0) - shifted(gy, -1, "y", 0)) * 0.5
    return field.withColumn("div", d)


def structure_orientation(grid: DataFrame, radius: int = 2) -> DataFrame:
    """ox, oy: principal direction of the box-mean structure tensor, as long as it is coherent."""
    g = gradient(grid)
    n = float((2 * radius + 1) ** 2)
    parts = {"jxx": F.col("gx") * F.col("gx"), "jxy": F.col("gx") * F.col("gy"), "jyy": F.col("gy") * F.col("gy")}
    g = g.withColumns(parts)
    for p in parts:
        g = box_sum(g, radius, value=p)
    a, b, c = (F.col(p) / n for p in parts)
    gap = F.sqrt((a - c) * (a - c) + 4 * b * b)
    angle = 0.5 * F.atan2(2 * b, a - c)
    coherence = F.when(a + c > 0, gap / (a + c)).otherwise(0.0)
    return g.select("y", "x", (F.cos(angle) * coherence).alias("ox"), (F.sin(angle) * coherence).alias("oy"))


def threshold(grid: DataFrame, at: float = 0.5, softness: float | None = None) -> DataFrame:
    v = F.col("v")
    out = F.when(v >= at, 1.0).otherwise(0.0) if softness is None else 1 / (1 + F.exp(-(v - at) * softness))
    return grid.withColumn("v", out)


def add_grids(a: DataFrame, b: DataFrame, wa: float = 1.0, wb: float = 1.0) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "v2"), ["y", "x"]).select("y", "x", (F.col("v") * wa + F.col("v2") * wb).alias("v"))


# --- points to grids --------------------------------------------------------------------------------------------


def _window(c: str, lo: float, size: float, n: int, reach: Column | float) -> Column:
    """Pixels along an axis whose centre may lie within ``reach`` of a point."""
    first = F.greatest(F.ceil((F.col(c) - reach - lo) / size - 0.5), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col(c) + reach - lo) / size - 0.5), F.lit(n - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def touched_pixels(points: DataFrame, box: Box, width: int, height: int, reach: float) -> DataFrame:
    """Points with each pixel (py, px; row 0 at the top) whose centre is within ``reach`` on both axes, and ``d2``."""
    sx, sy = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    p = points.withColumn("px", F.explode(_window("x", box[0], sx, width, reach)))
    p = p.withColumn("row", F.explode(_window("y", box[1], sy, height, reach)))
    dx = box[0] + (F.col("px") + 0.5) * sx - F.col("x")
    dy = box[1] + (F.col("row") + 0.5) * sy - F.col("y")
    return p.withColumn("d2", dx * dx + dy * dy).withColumn("py", (F.lit(height - 1) - F.col("row")).cast("int")).drop("row")


def splat(points: DataFrame, box: Box, width: int, height: int, reach: float, value: Column, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys,) y, x, v: what the points add to each pixel in reach, dense."""
    sums = touched_pixels(points, box, width, height, reach).groupBy(*keys, F.col("py").alias("y"), F.col("px").alias("x")).agg(F.sum(value).alias("s"))
    spark = points.sparkSession
    axis = spark.range(width * height).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.lit(1).alias("one"))
    if keys:
        axis = axis.join(points.select(*keys).distinct().withColumn("one", F.lit(1)), "one")
    return axis.drop("one").join(sums, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("s", F.lit(0.0)).alias("v"))


def kde(points: DataFrame, box: Box, width: int, height: int, sigma: float, radius_sigma: float = 4.0, *, keys: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Sum of unnormalised Gaussians, cut at a square of ``radius_sigma`` deviations."""
    w = F.exp(-F.col("d2") / (2 * sigma * sigma))
    return splat(points, box, width, height, sigma * radius_sigma, w if weight is None else w * weight, keys=keys)


def tcm_field(marks: DataFrame, box: Box, width: int, height: int, sigma: float) -> DataFrame:
    """Topographical correlation map: marks t of anchors, splatted with a Gaussian in a square window of whole pixels."""
    cell = min((box[2] - box[0]) / width, (box[3] - box[1]) / height)
    reach = ceil(3 * sigma / cell)
    sx, sy = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    own = lambda c, lo, s: F.floor((F.col(c) - lo) / s)
    p = marks.where("t <> 0").withColumn("ox", own("x", box[0], sx)).withColumn("oy", own("y", box[1], sy))
    near = (F.abs(F.col("px") - F.col("ox")) <= reach) & (F.abs(F.lit(height - 1) - F.col("py") - F.col("oy")) <= reach)
    value = F.when(near, F.col("t") * F.exp(-F.col("d2") / (2 * sigma * sigma)) / (sigma * sqrt(2 * pi))).otherwise(0.0)
    return splat(p, box, width, height, (reach + 1) * max(sx, sy), value)


# --- Gram -------------------------------------------------------------------------------------------------------


def gram(rasters: DataFrame, pixel_area: float, channel: str = "channel") -> DataFrame:
    """a, b, c, mean_a, mean_b, corr of channel rasters: sums over pixels in an equi-join on the pixel."""
    some = rasters.where("v <> 0")
    a = some.select("y", "x", F.col(channel).alias("a"), F.col("v").alias("va"))
    b = some.select("y", "x", F.col(channel).alias("b"), F.col("v").alias("vb"))
    cross = a.join(b, ["y", "x"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("sab"))
    s = rasters.groupBy(channel).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))
    sa = s.select(F.col(channel).alias("a"), F.col("m").alias("mean_a"), F.col("sd").alias("sd_a"), "n", F.lit(1).alias("one"))
    sb = s.select(F.col(channel).alias("b"), F.col("m").alias("mean_b"), F.col("sd").alias("sd_b"), F.lit(1).alias("one"))
    full = sa.join(sb, "one").join(cross, ["a", "b"], "left").withColumn("sab", F.coalesce("sab", F.lit(0.0)))
    corr = F.when((F.col("sd_a") > 0) & (F.col("sd_b") > 0), (F.col("sab") / F.col("n") - F.col("mean_a") * F.col("mean_b")) / F.col("sd_a") / F.col("sd_b"))
    return full.select("a", "b", (F.col("sab") * pixel_area).alias("c"), "mean_a", "mean_b", corr.alias("corr"))


def effective_radius(radius: float) -> float:
    """How far apart two points may be to add to a Gram matrix: splats of both reach this far together."""
    return 2 * radius


def association(
    grams: DataFrame, points: DataFrame, box: Box, radius: float, power: int, *, weight: str | None = None, cell: str | None = None
) -> DataFrame:
    """a, b, c, g, self_term, mass_a, mass_b, apron_a of a Gram matrix (a, b, c).

    ``points`` (channel, x, y) are those that were splatted with the kernel (1 - d²/r²)^``power``. mass: marks inside the
    window; apron: marks outside it within the radius, which fill the edge pixels but set no density. self_term: what
    points add by themselves, the integral of the kernel squared times the product of their marks in both channels. With
    ``cell``, the column that tells a point, channels may share points, as those of several features do; without, a point
    is of one channel only. g: the rest of c over what complete spatial randomness gives, mass_a mass_b / area.
    """
    x0, y0, x1, y1 = box
    w = F.lit(1.0) if weight is None else F.col(weight)
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    near = F.col("x").between(x0 - radius, x1 + radius) & F.col("y").between(y0 - radius, y1 + radius)
    of = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0.0))
    s = points.groupBy("channel").agg(of(inside, w).alias("mass"), of(near & ~inside, w).alias("apron"), of(inside, w * w).alias("squares"))
    roughness = (power + 1) ** 2 / (pi * radius * radius * (2 * power + 1))
    a = s.select(F.col("channel").alias("a"), F.col("mass").alias("mass_a"), F.col("apron").alias("apron_a"), F.col("squares").alias("own"))
    b = s.select(F.col("channel").alias("b"), F.col("mass").alias("mass_b"))
    full = grams.select("a", "b", "c").join(a, "a").join(b, "b")
    if cell is None:
        full = full.withColumn("self_term", F.when(F.col("a") == F.col("b"), roughness * F.col("own")).otherwise(0.0))
    else:
        own = points.where(inside).select(F.col(cell).alias("cell"), F.col("channel").alias("a"), w.alias("wa"))
        both = own.join(own.select("cell", F.col("a").alias("b"), F.col("wa").alias("wb")), "cell").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("shared"))
        full = full.join(both, ["a", "b"], "left").withColumn("self_term", roughness * F.coalesce("shared", F.lit(0.0)))
    expected = F.col("mass_a") * F.col("mass_b") / ((x1 - x0) * (y1 - y0))
    g = F.when(expected > 0, (F.col("c") - F.col("self_term")) / expected).otherwise(0.0)
    return full.select("a", "b", "c", g.alias("g"), "self_term", "mass_a", "mass_b", "apron_a")


# --- whitened channels ------------------------------------------------------------------------------------------


def standardised(rasters: DataFrame, channel: str = "channel") -> DataFrame:
    """channel, y, x, z: pixels less their channel's mean over its deviation (of all pixels); 0 where it is constant."""
    s = rasters.groupBy(channel).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return rasters.join(s, channel).select(F.col(channel).alias("channel"), "y", "x", F.when(F.col("sd") > 0, (F.col("v") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))


def whitening(modes: DataFrame, count: int) -> DataFrame:
    """mode, channel, w: the first ``count`` modes (mode, value, channel, loading), each over the root of its value. Values
    are taken to be a millionth of the first at least, as collinear channels have values of nearly nothing."""
    top = modes.where("mode = 0").agg(F.max("value").alias("top")).withColumn("one", F.lit(1))
    floor = 1e-6 * F.greatest("top", F.lit(1e-12))
    rows = modes.where(F.col("mode") < count).withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    return rows.select("mode", "channel", (F.col("loading") / F.sqrt(F.greatest("value", floor))).alias("w"))


def whitened(rasters: DataFrame, weights: DataFrame, channel: str = "channel") -> DataFrame:
    """y, x, mode, u: standardised channels through a whitening matrix (mode, channel, w); their covariance over the
    pixels is the identity if the modes are those of the rasters' correlation."""
    return standardised(rasters, channel).join(weights, "channel").groupBy("y", "x", "mode").agg(F.sum(F.col("w") * F.col("z")).alias("u"))


def channel_probe(rasters: DataFrame, weights: DataFrame, y: int, x: int, limit: float, channel: str = "channel") -> DataFrame:
    """y, x, distance, similarity of each pixel's whitened channels to those of one pixel: 1 at no distance, 0 from the
    limit on. The pixel is taken to the nearest one of the raster. What is broadcast is one number a mode."""
    u = whitened(rasters, weights, channel)
    ends = rasters.agg(F.max("y"), F.max("x")).first()
    y, x = (min(max(v, 0), int(end or 0)) for v, end in zip((y, x), ends, strict=True))
    probe = u.where((F.col("y") == y) & (F.col("x") == x)).select("mode", F.col("u").alias("own"))
    far = u.join(F.broadcast(probe), "mode").groupBy("y", "x").agg(F.sqrt(F.sum((F.col("u") - F.col("own")) * (F.col("u") - F.col("own")))).alias("distance"))
    return far.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance") / limit))
