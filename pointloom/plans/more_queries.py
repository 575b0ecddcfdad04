"""Further rows of the inventory: kernels' spectra, null means, layouts, NGFF transforms, tiles, splines, traits."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.functions.rng import uniform
from pointloom.operators import manifold as M
from pointloom.operators import points as P
from pointloom.operators import raster as R
from pointloom.operators.inference import permuted_labels, rank_envelope
from pointloom.plans.registry import CELLS, query, r6, rounded
from pointloom.sources.tables import WINDOW_EMB, cells_emb, coo, features, points3, table

W = WINDOW_EMB


@query("p24_kernel_spectrum")
def p24(spark, d):
    """Hankel transforms of the kernels (radius 1) on a frequency axis; the least value tells whether they are positive
    definite. Bessel's J0 as its integral over an angle."""
    angle = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: (k + 0.5) * (pi / 200))
    j0 = lambda z: F.aggregate(F.transform(angle, lambda a: F.cos(z * F.sin(a))), F.lit(0.0), lambda s, v: s + v) / 200
    axis = spark.range(60).select((F.col("id") * 0.5).alias("q")).withColumn("r", F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: (k + 0.5) / 200)))
    terms = {k: F.sum(P.kernel_at(k, F.col("r") * F.col("r"), 1.0) * 2 * pi * F.col("r") * j0(F.col("q") * F.col("r")) / 200).alias(k) for k in (*P.KERNELS, "gaussian")}
    return rounded(axis.groupBy("q").agg(*terms.values()), *terms)


@query("p32_apron_coverage", f"WITH {CELLS} SELECT cell_id, {r6('least(1, (least(x+120, 450)-greatest(x-120, -450))*(least(y+120, 450)-greatest(y-120, -450))/57600.0)')} AS share FROM cells")
def p32(spark, d):
    side = lambda c: F.least(F.col(c) + 120, F.lit(450.0)) - F.greatest(F.col(c) - 120, F.lit(-450.0))
    return rounded(cells_emb(spark, d).select("cell_id", F.least(F.lit(1.0), side("x") * side("y") / 57600.0).alias("share")), "share")


@query("p34_mode_projection")
def p34(spark, d):
    c = cells_emb(spark, d).withColumn("channel", F.col("type_id") % 3)
    rasters = R.splat(c, W, 32, 32, 60.0, P.kernel_at("epanechnikov", F.col("d2"), 60.0), keys=("channel",))
    modes = M.eigen_of(R.gram(rasters, (900 / 32) ** 2).select("a", "b", F.col("corr").alias("v")))
    got = rasters.join(modes.select("mode", "channel", "loading"), "channel").groupBy("mode", "y", "x").agg(F.sum(1e6 * F.col("v") * F.col("loading")).alias("v"))
    return rounded(got, "v", digits=3)


@query(
    "p37_null_mean_pairs",
    f"""WITH {CELLS}, n AS (SELECT type_id, count(*) AS n FROM cells GROUP BY 1), p AS (SELECT count(*) AS pairs FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) < 900.0)
    SELECT a.type_id AS ta, b.type_id AS tb, {r6('pairs*(a.n*b.n - CASE WHEN a.type_id = b.type_id THEN a.n ELSE 0 END)/(t*(t-1.0))')} AS expected FROM n a, n b, p, (SELECT count(*) AS t FROM cells)""",
)
def p37(spark, d):
    """Pairs that each type pair has on average under shuffled labels: in closed form from the sums alone."""
    from pointloom.operators.neighbors import neighbour_join

    cells = cells_emb(spark, d)
    total = F.broadcast(neighbour_join(cells, cells, 30.0).agg(F.count("*").alias("pairs")).withColumn("one", F.lit(1)))
    t = F.broadcast(cells.agg(F.count("*").alias("t")).withColumn("one", F.lit(1)))
    full = P.type_pairs(cells).withColumn("one", F.lit(1)).join(total, "one").join(t, "one")
    own = F.when(F.col("ta") == F.col("tb"), F.col("na")).otherwise(0)
    e = F.col("pairs") * (F.col("na") * F.col("nb") - own) / (F.col("t") * (F.col("t") - 1))
    return rounded(full.select("ta", "tb", e.alias("expected")), "expected")


@query("p38_spectrum_envelope")
def p38(spark, d):
    """Eigenvalues of the type correlation, observed (curve 0) and under shuffled labels, in a global envelope."""
    cells = cells_emb(spark, d).withColumn("type_id", F.col("type_id") % 4)
    sims = permuted_labels(cells, 39, 21).unionByName(cells.select(F.lit(0).alias("sim"), "x", "y", "type_id"))
    r = P.row_correlation(P.quadrat_counts(sims, W, 100.0, keys=("sim",)), 81, keys=("sim",))

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="ta", columns="tb", values="r").fillna(0).to_numpy()
        values, _ = M.eigen(m)
        return pd.DataFrame({"curve": int(pdf["sim"].iloc[0]), "r": np.arange(len(values)), "v": np.round(values, 9)})

    curves = r.groupBy("sim").applyInPandas(spectrum, "curve int, r int, v double")
    return rounded(rank_envelope(curves, curves=40, alpha=0.05), "lo", "hi", "observed", "p", digits=5)


@query(
    "p42_standardised_features",
    f"""WITH f AS (SELECT vec_id AS row, k::INT AS col, embedding[k+1]::DOUBLE AS v FROM embeddings, range(64) r(k)), s AS (SELECT col, avg(v) AS m, stddev_samp(v) AS sd FROM f GROUP BY 1)
    SELECT row, col, {r6('(v-m)/sd', 5)} AS z FROM f JOIN s USING (col)""",
)
def p42(spark, d):
    f = features(spark, d)
    s = M.column_stats(f)
    z = f.select("row", F.posexplode("features").alias("col", "v")).join(F.broadcast(s), "col")
    return rounded(z.select("row", "col", ((F.col("v") - F.col("mean")) * F.col("scale")).alias("z")), "z", digits=5)


@query("s17_column_cost", "SELECT w::INT AS wanted, least(1.0, w/64.0)::DOUBLE AS csc, 1.0::DOUBLE AS csr FROM (VALUES (1), (16), (64), (100)) t(w)")
def s17(spark, d):
    from pointloom.operators.tables import sparse_column_cost as cost

    return spark.createDataFrame([(w, cost(w, 64, "csc"), cost(w, 64, "csr")) for w in (1, 16, 64, 100)], "wanted int, csc double, csr double")


@query("s19_list_variables", "SELECT DISTINCT event_type AS var FROM events")
def s19(spark, d):
    return coo(spark, d).select("var").distinct()


@query("s23_centroids", f"WITH {CELLS} SELECT type_id, {r6('avg(x)')} AS x, {r6('avg(y)')} AS y, count(*) AS n FROM cells GROUP BY 1")
def s23(spark, d):
    return rounded(cells_emb(spark, d).groupBy("type_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")), "x", "y")


@query("s24_escape_time")
def s24(spark, d):
    """Rounds until z² + c leaves the disk of radius 2, at most 32, on a plane of pixels: a fold over a sequence."""
    g = spark.range(48 * 32).select((F.col("id") / 48).cast("int").alias("y"), (F.col("id") % 48).cast("int").alias("x"))
    cx, cy = -2.2 + F.col("x") * (3.2 / 48), -1.2 + F.col("y") * (2.4 / 32)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

    def step(s, _):
        out = s["a"] * s["a"] + s["b"] * s["b"] > 4
        keep = lambda new, old: F.when(out, old).otherwise(new)
        return F.struct(keep(s["a"] * s["a"] - s["b"] * s["b"] + cx, s["a"]).alias("a"), keep(2 * s["a"] * s["b"] + cy, s["b"]).alias("b"), keep(s["n"] + 1, s["n"]).alias("n"))

    return g.select("y", "x", F.aggregate(F.sequence(F.lit(1), F.lit(32)), zero, step, lambda s: s["n"]).alias("n"))


@query("s29_swiss_roll")
def s29(spark, d):
    u, v = uniform(F.lit("sr-u"), F.col("id")), uniform(F.lit("sr-v"), F.col("id"))
    t = 1.5 * pi * (1 + 2 * u)
    return rounded(spark.range(500).select("id", F.array(t * F.cos(t), 21 * v, t * F.sin(t)).alias("f")).select("id", *[F.col("f")[k].alias(f"c{k}") for k in range(3)]), "c0", "c1", "c2")


@query("s30_association_scene")
def s30(spark, d):
    """Cells of type 0 at random; of type 1 around every second of them within 20, of type 2 at random."""
    u = lambda tag: uniform(F.lit(f"as-{tag}"), F.col("id"))
    kind, anchor = F.col("id") % 3, F.floor(F.col("id") / 6) * 6
    ux, uy = (1000 * uniform(F.lit(f"as-{c}"), anchor) for c in "xy")
    near = (kind == 1) & True
    r, t = 20 * F.sqrt(u("r")), 2 * pi * u("t")
    x = F.when(near, ux + r * F.cos(t)).otherwise(1000 * u("x"))
    y = F.when(near, uy + r * F.sin(t)).otherwise(1000 * u("y"))
    return rounded(spark.range(1200).select(F.col("id").alias("cell_id"), x.alias("x"), y.alias("y"), kind.cast("int").alias("type_id")), "x", "y")


@query("d3_ngff_transform", "SELECT p_partkey AS k, 0.5::DOUBLE*p_size+10 AS x, 0.25::DOUBLE*p_size-4 AS y FROM part")
def d3(spark, d):
    """Scales and translations of a JSON list of coordinate transformations, folded into one affine."""
    schema = "array<struct<type:string,scale:array<double>,translation:array<double>>>"
    text = F.lit('[{"type":"scale","scale":[1,0.25,0.5]},{"type":"translation","translation":[0,-4,10]}]')
    zero = F.struct(F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))

    def step(m, t):
        s = lambda k: F.coalesce(F.element_at(t["scale"], k), F.lit(1.0))
        o = lambda k: F.coalesce(F.element_at(t["translation"], k), F.lit(0.0))
        return F.struct((m["sx"] * s(-1)).alias("sx"), (m["sy"] * s(-2)).alias("sy"), (m["tx"] * s(-1) + o(-1)).alias("tx"), (m["ty"] * s(-2) + o(-2)).alias("ty"))

    m = F.aggregate(F.from_json(text, schema), zero, step)
    part = table(spark, d, "part").withColumn("m", m)
    return part.select(F.col("p_partkey").alias("k"), (F.col("m.sx") * F.col("p_size") + F.col("m.tx")).alias("x"), (F.col("m.sy") * F.col("p_size") + F.col("m.ty")).alias("y"))


@query("d9_resolve_tiles", "SELECT o_orderpriority AS chunk, count(DISTINCT o_custkey % 8) AS tiles FROM orders GROUP BY 1")
def d9(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderpriority").alias("chunk"), (F.col("o_custkey") % 8).alias("tile")).dropDuplicates()
    return wanted.groupBy("chunk").agg(F.count("*").alias("tiles"))


@query(
    "x7_catmull_rom",
    f"""WITH s AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS p1, lag(embedding[1]::DOUBLE, 1, embedding[1]::DOUBLE) OVER w AS p0, lead(embedding[1]::DOUBLE, 1, embedding[1]::DOUBLE) OVER w AS p2,
    lead(embedding[1]::DOUBLE, 2, lead(embedding[1]::DOUBLE, 1, embedding[1]::DOUBLE) OVER w) OVER w AS p3 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT id, {r6('0.5*(2*p1+(p2-p0)*0.3+(2*p0-5*p1+4*p2-p3)*0.09+(3*p1-p0-3*p2+p3)*0.027)')} AS v FROM s""".replace(
        "lead(embedding[1]::DOUBLE, 2, lead(embedding[1]::DOUBLE, 1, embedding[1]::DOUBLE) OVER w) OVER w AS p3",
        "coalesce(lead(embedding[1]::DOUBLE, 2) OVER w, lead(embedding[1]::DOUBLE, 1) OVER w, embedding[1]::DOUBLE) AS p3",
    ),
)
def x7(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    p1 = F.col("embedding")[0].cast("double")
    p0, p2 = F.coalesce(F.lag(p1).over(w), p1), F.coalesce(F.lead(p1).over(w), p1)
    p3 = F.coalesce(F.lead(p1, 2).over(w), F.lead(p1).over(w), p1)
    t = 0.3
    v = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t**3)
    return rounded(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v")), "v")


@query("x10_tagged_parameters", "SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0 AND NOT (p_size % 3 = 0)")
def x10(spark, d):
    tags = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, F.lit("even")), F.when(F.col("p_size") % 3 == 0, F.lit("third"))), lambda t: t.isNotNull())
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), tags.alias("tags"))
    return p.where(F.array_contains("tags", "even") & ~F.array_contains("tags", "third")).select("k")


@query("e2_trait_decode", f"SELECT p_partkey AS k, {r6('-1+2*(p_size/50.0)')}::DOUBLE AS a, {r6('10+5*(p_partkey % 4)/4.0')}::DOUBLE AS b FROM part")
def e2(spark, d):
    got = X.decode(F.array(F.col("p_size") / 50.0, (F.col("p_partkey") % 4) / 4.0), [-1.0, 10.0], [1.0, 15.0])
    return rounded(table(spark, d, "part").select(F.col("p_partkey").alias("k"), got[0].alias("a"), got[1].alias("b")), "a", "b")


@query("c4_surface_normals")
def c4n(spark, d):
    """Central differences of a solid's distance at each point, normalised."""
    h = 1e-3
    solid = lambda x, y, z: X.smooth_union(X.sphere(x, y, z, 12.0), X.box(x, y, z, (8.0, 9.0, 7.0)), 3.0)
    p = [F.col(c) for c in "xyz"]
    diff = [solid(*[v + h * (k == m) for k, v in enumerate(p)]) - solid(*[v - h * (k == m) for k, v in enumerate(p)]) for m in range(3)]
    size = F.sqrt(sum((v * v for v in diff[1:]), diff[0] * diff[0]))
    got = points3(spark, d).select("id", *[F.when(size > 0, v / size).otherwise(0.0).alias(f"n{c}") for c, v in zip("xyz", diff, strict=True)])
    return rounded(got, "nx", "ny", "nz", digits=4)
