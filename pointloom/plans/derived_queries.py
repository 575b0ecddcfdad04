"""Queries over what other operators give: whitened channels, excursions, kernel scores, ramps, stored matrices."""

from __future__ import annotations

from math import exp, pi

from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.operators import manifold as M
from pointloom.operators import points as P
from pointloom.operators import raster as R
from pointloom.operators import tables as B
from pointloom.operators.inference import excursions
from pointloom.plans.grid_queries import _RAST, _rasters
from pointloom.plans.other_queries import _SERIES
from pointloom.plans.point_queries import A, W, _kernel_sql
from pointloom.plans.registry import CELLS, ORDERS, query, r6, rounded
from pointloom.sources.packed import Store, pack_tiles, tile_field, write_store
from pointloom.sources.tables import WINDOW_ORD, cells_emb, cells_ord, features, table
from pointloom.streaming.series import run_to_table, series_stream, table_path
from pointloom.streaming.stateful import read_events


def _weights(spark, d, count=3):
    rasters = _rasters(spark, d)
    g = R.gram(rasters, 1.0)
    return rasters, R.whitening(M.eigen_of(g.select("a", "b", F.col("corr").alias("v"))), count)


#: With all modes the whitened distance is that of Mahalanobis; the correlation of three channels inverted by cofactors.
_WHITE = f"""{_RAST}, st AS (SELECT channel, avg(v) AS m, stddev_pop(v) AS sd FROM ras GROUP BY 1),
    z AS (SELECT y, x, max(CASE WHEN channel = 0 THEN (v-m)/sd END) AS p, max(CASE WHEN channel = 1 THEN (v-m)/sd END) AS q, max(CASE WHEN channel = 2 THEN (v-m)/sd END) AS r
      FROM ras JOIN st USING (channel) GROUP BY 1, 2),
    cr AS (SELECT avg(p*q) AS a, avg(p*r) AS b, avg(q*r) AS c FROM z),
    inv AS (SELECT (1-c*c)/t AS i00, (1-b*b)/t AS i11, (1-a*a)/t AS i22, (b*c-a)/t AS i01, (a*c-b)/t AS i02, (a*b-c)/t AS i12 FROM (SELECT *, 1+2*a*b*c-a*a-b*b-c*c AS t FROM cr)),
    dz AS (SELECT z.y, z.x, z.p-o.p AS p, z.q-o.q AS q, z.r-o.r AS r FROM z, z o WHERE o.y = 16 AND o.x = 16),
    far AS (SELECT y, x, sqrt(greatest(0, i00*p*p+i11*q*q+i22*r*r+2*(i01*p*q+i02*p*r+i12*q*r))) AS distance FROM dz, inv)"""


@query("p42_channel_probe", f"WITH {_WHITE} SELECT y, x, {r6('distance', 4)} AS distance, {r6('greatest(0, 1-distance/2.0)', 4)} AS similarity FROM far")
def p42p(spark, d):
    """How like the channels of each pixel are to those of the middle one, by distance between whitened channels."""
    rasters, weights = _weights(spark, d)
    return rounded(R.channel_probe(rasters, weights, 16, 16, 2.0), "distance", "similarity", digits=4)


@query("p42_whitened_covariance", "SELECT a::INT AS a, b::INT AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(3) p(a), range(3) q(b)")
def p42w(spark, d):
    """Covariance of the whitened channels over the pixels: the identity."""
    rasters, weights = _weights(spark, d)
    u = R.whitened(rasters, weights)
    both = u.select("y", "x", F.col("mode").alias("a"), F.col("u").alias("p")).join(u.select("y", "x", F.col("mode").alias("b"), F.col("u").alias("q")), ["y", "x"])
    return rounded(both.groupBy("a", "b").agg(F.covar_pop("p", "q").alias("v")), "v", digits=5)


@query(
    "p38_excursions",
    f"""WITH {CELLS}, t AS (SELECT DISTINCT type_id FROM cells), n AS (SELECT type_id, least(greatest(floor((x+450)/45), 0), 19)::INT AS r, count(*) AS n FROM cells GROUP BY 1, 2),
    c AS (SELECT t.type_id, k::INT AS r, coalesce(n, 0) AS v FROM t CROSS JOIN range(20) a(k) LEFT JOIN n ON n.type_id = t.type_id AND n.r = k),
    e AS (SELECT a.type_id, a.r, max(a.v) AS observed, min(b.v) AS lo, max(b.v) AS hi FROM c a JOIN c b ON a.r = b.r AND a.type_id <> b.type_id GROUP BY 1, 2),
    o AS (SELECT type_id, r, CASE WHEN observed > hi THEN 'above' WHEN observed < lo THEN 'below' END AS side, greatest(observed - hi, lo - observed) AS excess FROM e),
    k AS (SELECT *, r - row_number() OVER (PARTITION BY type_id, side ORDER BY r) AS island FROM o WHERE side IS NOT NULL)
    SELECT type_id, side, min(r) AS "begin", max(r) AS "end", count(*) AS n, max(excess) AS largest FROM k GROUP BY type_id, side, island""",
)
def p38e(spark, d):
    """Runs of strips of the window in which a type has more, or fewer, cells than every other type."""
    cells = cells_emb(spark, d)
    strip = F.least(F.greatest(F.floor((F.col("x") + 450) / 45), F.lit(0)), F.lit(19)).cast("int")
    axis = cells.select("type_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19))))
    v = axis.join(cells.groupBy("type_id", strip.alias("r")).agg(F.count("*").alias("v")), ["type_id", "r"], "left").fillna(0, ["v"])
    others = v.select("r", F.col("type_id").alias("other"), F.col("v").alias("w"))
    e = v.join(others, "r").where("type_id <> other").groupBy("type_id", "r").agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.max("v").alias("observed"))
    return excursions(e, keys=("type_id",))


def _scores_sql() -> str:
    u = lambda tag, c: f"(('0x' || substr(md5('17-{tag}-' || {c}), 1, 8))::BIGINT / 4294967296.0)"
    size, turn = f"3.0*sqrt(-2*ln(greatest({u('r', 'cell_id')}, 1e-12)))", f"{2 * pi!r}*{u('t', 'cell_id')}"
    radii = {k: P.matched_radius(k, 60.0) for k in (*P.KERNELS, "gaussian")}
    at = lambda k, r, d2: f"CASE WHEN {d2} < {r * r!r} THEN {_kernel_sql(k, r).replace('d2', d2)} ELSE 0 END"
    sums = ", ".join(f"sum({at(k, r, 'd2')}) AS {k}_m, sum({at(k, r * 1.02, 'd2')}) AS {k}_w, sum({at(k, r, 'jd')}) AS {k}_j" for k, r in radii.items())
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS kernel, positive, " + ", ".join(f"round(coalesce({k}_{s}, 0)/(SELECT count(*) FROM j WHERE type_id % 2 = 1)*{A}, 9)+0.0 AS {s}" for s in "mwj") + " FROM f"
        for k in radii
    )
    fixed = ", ".join(f"('{k}', {r!r}::DOUBLE, {P.kernel_moments(k, r)[0]!r}::DOUBLE, {P.kernel_moments(k, r)[1]!r}::DOUBLE)" for k, r in radii.items())
    return f"""WITH {CELLS}, j AS (SELECT *, x*x+y*y < 22500 AS positive, x + {size}*cos({turn}) AS jx, y + {size}*sin({turn}) AS jy FROM cells),
    p AS (SELECT a.cell_id, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d2, (b.jx-a.jx)*(b.jx-a.jx)+(b.jy-a.jy)*(b.jy-a.jy) AS jd FROM j a JOIN j b ON a.type_id % 2 = 0 AND b.type_id % 2 = 1),
    n AS (SELECT cell_id, {sums} FROM p GROUP BY 1),
    f AS (SELECT j.cell_id, j.positive, n.* EXCLUDE cell_id FROM j LEFT JOIN n USING (cell_id) WHERE type_id % 2 = 0),
    w AS ({rows}),
    k AS (SELECT *, rank() OVER (PARTITION BY kernel ORDER BY m) + (count(*) OVER (PARTITION BY kernel, m) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY kernel, m) AS same FROM w),
    s AS (SELECT kernel, (sum(mid) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) AS auc,
      count(*) FILTER (same > 1) / count(*) AS tied, sqrt(sum((w-m)*(w-m))/sum(m*m)) AS dr, sqrt(sum((j-m)*(j-m))/sum(m*m)) AS dj FROM k GROUP BY 1)
    SELECT kernel, {r6('radius', 5)} AS radius, {r6('auc')} AS auc, {r6('tied')} AS tied, {r6('dr', 5)} AS radius_sensitivity, {r6('dj', 5)} AS jitter_sensitivity, {r6('moment2', 3)} AS moment2, {r6('roughness', 9)} AS roughness
    FROM s JOIN (VALUES {fixed}) v(kernel, radius, moment2, roughness) USING (kernel)"""


@query("p25_kernel_scores", _scores_sql())
def p25k(spark, d):
    """How well the marks of each kernel tell the cells of even type near the middle, where those of odd type are dense."""
    c = cells_emb(spark, d)
    a = c.where("type_id % 2 = 0").select("cell_id", "x", "y", (F.col("x") * F.col("x") + F.col("y") * F.col("y") < 22500).alias("positive"))
    got = P.kernel_scores(a, c.where("type_id % 2 = 1").select("cell_id", "x", "y"), W, 60.0)
    got = rounded(rounded(got, "auc", "tied"), "radius", "radius_sensitivity", "jitter_sensitivity", digits=5)
    return rounded(rounded(got, "moment2", digits=3), "roughness", digits=9)


_CHANNELS = f"ch AS (SELECT vec_id AS cell_id, 1000*embedding[1]::DOUBLE AS x, 1000*embedding[2]::DOUBLE AS y, k::INT AS channel, embedding[k+3]::DOUBLE AS w FROM embeddings, range(4) r(k) WHERE embedding[k+3] > 0)"
_IN = (-250.0, -250.0, 250.0, 250.0)


@query(
    "p31_weighted_association",
    f"""WITH {_CHANNELS}, axis2 AS (SELECT y::INT AS y, x::INT AS x, -250+(x+0.5)*{500 / 32} AS cx, -250+(31-y+0.5)*{500 / 32} AS cy FROM range(32) a(y), range(32) b(x)),
    ras AS (SELECT c.channel, a.y, a.x, sum(w*{2 / (pi * 3600)!r}*(1-((cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y))/3600.0)) AS v FROM axis2 a JOIN ch c ON abs(cx-c.x) <= 60 AND abs(cy-c.y) <= 60 AND (cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y) < 3600.0 GROUP BY 1, 2, 3),
    s AS (SELECT a.channel AS a, b.channel AS b, sum(a.v*b.v)*{(500 / 32) ** 2} AS c FROM ras a JOIN ras b USING (y, x) GROUP BY 1, 2),
    i AS (SELECT * FROM ch WHERE x BETWEEN -250 AND 250 AND y BETWEEN -250 AND 250), m AS (SELECT channel, sum(w) AS mass FROM i GROUP BY 1),
    o AS (SELECT a.channel AS a, b.channel AS b, sum(a.w*b.w)*4/(pi()*3600*3) AS own FROM i a JOIN i b USING (cell_id) GROUP BY 1, 2)
    SELECT s.a, s.b, {r6('1e3*c', 5)} AS c, {r6('1e3*coalesce(own, 0)', 5)} AS self_term, {r6('(c-coalesce(own, 0))/(p.mass*q.mass/250000.0)', 5)} AS g
    FROM s JOIN m p ON p.channel = s.a JOIN m q ON q.channel = s.b LEFT JOIN o ON o.a = s.a AND o.b = s.b""",
)
def p31w(spark, d):
    """Association of four features as channels over the same cells: a cell adds by itself to each pair of its channels."""
    e = table(spark, d, "embeddings")
    at = [(1000 * F.col("embedding")[k].cast("double")).alias(c) for k, c in enumerate("xy")]
    c = e.select(F.col("vec_id").alias("cell_id"), *at, F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 3, 4)).alias("channel", "w")).where("w > 0")
    rasters = R.splat(c, _IN, 32, 32, 60.0, F.col("w") * P.kernel_at("epanechnikov", F.col("d2"), 60.0), keys=("channel",))
    got = R.association(R.gram(rasters, (500 / 32) ** 2), c, _IN, 60.0, 1, weight="w", cell="cell_id")
    got = got.select("a", "b", (1e3 * F.col("c")).alias("c"), (1e3 * F.col("self_term")).alias("self_term"), "g")
    return rounded(got, "c", "self_term", "g", digits=5)


def _linear_sql(li: str, c: str, h: str) -> list[str]:
    row = lambda w, v: "(" + "+".join(f"({a!r})*{b}" for a, b in zip(w, v, strict=True)) + ")"
    cones = [row(w, (li, f"({c}*cos({h}))", f"({c}*sin({h}))")) for w in X._FROM_LAB]
    return [row(w, [f"pow({k}, 3)" for k in cones]) for w in X._FROM_CONES]


def _ramps_sql() -> str:
    ok = lambda c: " AND ".join(f"{v} BETWEEN -1e-6 AND 1.000001" for v in _linear_sql("li", c, "h"))
    srgb = lambda v: f"least(1.0, greatest(0.0, CASE WHEN {v} <= 0.0031308 THEN {v}*12.92 ELSE 1.055*pow(greatest({v}, 0.0), {1 / 2.4!r})-0.055 END))"
    out = ", ".join(f"{r6(srgb(v), 5)} AS {n}" for n, v in zip("rgb", _linear_sql("li", "ch", "h"), strict=True))
    deg = pi / 180
    return f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, 'diverging' AS ramp, (p_size-25.5)/24.5 AS t, 0 AS hue FROM part UNION ALL SELECT p_partkey, 'sequential', p_size/50.0, p_partkey % 12 FROM part),
    c AS (SELECT k, ramp, CASE ramp WHEN 'diverging' THEN 0.97+(0.55-0.97)*least(abs(t), 1) ELSE 0.14+(0.86-0.14)*t END AS li, CASE ramp WHEN 'diverging' THEN 0.15*least(abs(t), 1) ELSE 0.15*pow(t, 0.4) END AS c,
      CASE ramp WHEN 'diverging' THEN CASE WHEN t < 0 THEN {250 * deg!r} ELSE {29 * deg!r} END ELSE ({200 * deg!r} + {2 * pi!r}*hue/12) % {2 * pi!r} END AS h FROM t),
    b AS (SELECT k, ramp, li, c, h, 0 AS n, 0.0::DOUBLE AS lo, c::DOUBLE AS hi FROM c UNION ALL
      SELECT k, ramp, li, c, h, n + 1, CASE WHEN ok THEN (lo+hi)/2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo+hi)/2 END FROM (SELECT *, {ok('((lo+hi)/2)')} AS ok FROM b WHERE n < {X.GAMUT_STEPS})),
    e AS (SELECT k, ramp, li, h, CASE WHEN {ok('c')} THEN c ELSE lo END AS ch FROM b WHERE n = {X.GAMUT_STEPS})
    SELECT k, ramp, {r6('ch', 5)} AS chroma, {out} FROM e"""


@query("v1_ramps", _ramps_sql())
def v1r(spark, d):
    """Signed and unsigned ramps of a part's size, its chroma drawn in until the colour can be shown."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), (F.col("p_partkey") % 12).alias("hue"))
    return rounded(ramp_colours(part), "chroma", "r", "g", "b", digits=5)


def ramp_colours(part):
    """k, ramp, chroma, r, g, b of parts (k, size, hue). Colours are found once for each size and hue, however many
    parts have them: the bisection of a chroma is some thousand operations."""
    seen = part.select(F.col("size").alias("of_size"), F.col("hue").alias("of_hue")).distinct()
    ramps = [("diverging", X.diverging((F.col("of_size") - 25.5) / 24.5)), ("sequential", X.sequential(F.col("of_size") / 50.0, X.categorical_hue(F.col("of_hue"), 12)))]
    rows = seen.select("of_size", "of_hue", F.inline(F.array(*[F.struct(F.lit(n).alias("ramp"), *[v.alias(c) for v, c in zip(lch, ("li", "c", "h"), strict=True)]) for n, lch in ramps])))
    rows = rows.withColumn("chroma", X.gamut_chroma(F.col("li"), F.col("c"), F.col("h")))
    rgb = X.oklch_to_srgb(F.col("li"), F.col("chroma"), F.col("h"))
    colours = rows.groupBy("of_size", "of_hue").agg(F.collect_list(F.struct("ramp", "chroma", *[v.alias(n) for n, v in zip("rgb", rgb, strict=True)])).alias("colours"))
    same = F.col("size").eqNullSafe(F.col("of_size")) & F.col("hue").eqNullSafe(F.col("of_hue"))
    return part.join(colours, same).select("k", F.inline("colours"))


@query("s20_subsample", "SELECT vec_id AS row FROM embeddings ORDER BY md5('1-' || vec_id) LIMIT 300")
def s20k(spark, d):
    """The rows that the way from a stored matrix to components keeps."""
    return B.bottom_k(features(spark, d), F.md5(F.concat(F.lit("1-"), F.col("row").cast("string")).cast("binary")), 300).select("row")


@query("s20_store_dataset")
def s20d(spark, d):
    """Components of the ten most variable features, log1p, of a subsample of 300 rows."""
    scores, _ = B.store_dataset(features(spark, d), genes=10, rows=300, components=5)
    return rounded(scores.select("row", *[F.col("scores")[k].alias(f"s{k}") for k in range(5)]), *[f"s{k}" for k in range(5)], digits=5)


_PX = f"""{ORDERS}, px AS (SELECT least(greatest(floor((y-1000)*48/2600), 0), 47)::INT AS y, least(greatest(floor(x*80/5000), 0), 79)::INT AS x, count(*) AS n, sum(round(x*100)) AS total FROM ord GROUP BY 1, 2)"""


@query(
    "s22_tile_to_field",
    f"WITH {_PX} SELECT a.y::INT AS y, b.x::INT AS x, coalesce(total, 0)::DOUBLE AS v FROM range(48) a(y) CROSS JOIN range(80) b(x) LEFT JOIN px ON px.y = a.y AND px.x = b.x WHERE EXISTS (SELECT 1 FROM px p WHERE p.y // 32 = a.y // 32 AND p.x // 32 = b.x // 32)",
)
def s22(spark, d):
    """Orders as a raster of two lanes, count and price, packed as tiles; the second lane as a field."""
    x0, y0, x1, y1 = WINDOW_ORD
    pixel = lambda c, lo, hi, n: F.least(F.greatest(F.floor((F.col(c) - lo) * n / (hi - lo)), F.lit(0)), F.lit(n - 1)).cast("int")
    p = cells_ord(spark, d).groupBy(pixel("y", y0, y1, 48).alias("y"), pixel("x", x0, x1, 80).alias("x")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("x") * 100)).alias("total"))
    return tile_field(pack_tiles(p, 80, 48, ["n", "total"], tile=32, kind="f8"), 1, tile=32)


@query("s10_store", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier")
def s10(spark, d):
    """Suppliers written as a store, and two of its columns read back as doubles."""
    path = table_path(spark, "store")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    write_store({"suppliers": (s, ["s_suppkey"])}, path, chunk_rows=4096)
    return Store.open(spark, path).read_f64("suppliers", ["nation", "balance"])


@query(
    "g29_series_stream",
    f"""WITH RECURSIVE {_SERIES}, y AS (SELECT user_id, tick, v AS smooth FROM s WHERE tick = 0 UNION ALL
      SELECT s.user_id, s.tick, y.smooth + {1 - exp(-1 / 4.0)!r} * (s.v - y.smooth) FROM y JOIN s ON s.user_id = y.user_id AND s.tick = y.tick + 1),
    l AS (SELECT *, lag(v, 3, 0.0) OVER w AS delayed, first_value(v) OVER w AS f, lag(v, 2) OVER w AS a, lag(v, 3) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tick))
    SELECT user_id, tick, delayed, {r6('coalesce(a, f)+(coalesce(b, f)-coalesce(a, f))*0.25')} AS sample, {r6('smooth', 5)} AS smooth FROM l JOIN y USING (user_id, tick)""",
)
def g29s(spark, d):
    """Each user's events as a stream: three ticks late, two and a quarter ticks back, and smoothed."""
    stream = series_stream(read_events(spark, f"{d}/events.parquet*"), delay=3, age=2.25, tau=4.0)
    got = run_to_table(stream, table_path(spark, "series")).drop("event_id")
    return rounded(rounded(got, "sample"), "smooth", digits=5)
