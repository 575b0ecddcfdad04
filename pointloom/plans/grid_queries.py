"""Queries over grids: element algebra, stencils, densities, wavelets and Gram matrices."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import functions as F

from pointloom.functions import algebra as A
from pointloom.operators import points as P
from pointloom.operators import raster as R
from pointloom.operators import wavelet as V
from pointloom.plans.registry import CELLS, GRID, query, r6, rounded
from pointloom.sources.tables import WINDOW_EMB, cells_emb, dense_grid, features, grid_q, table

W = WINDOW_EMB
WIDTH, HEIGHT = 24, 20
#: Two grids in SQL: cells of even and of odd types.
TWO = (
    GRID + ", ga AS (SELECT a.y, a.x, count(o.x)::DOUBLE AS v FROM axis a LEFT JOIN occ o ON a.y = o.y AND a.x = o.x AND o.type_id % 2 = 0 GROUP BY ALL)"
    ", gb AS (SELECT a.y, a.x, count(o.x)::DOUBLE AS v FROM axis a LEFT JOIN occ o ON a.y = o.y AND a.x = o.x AND o.type_id % 2 = 1 GROUP BY ALL)"
)


def _grid(spark, d):
    return grid_q(spark, d, WIDTH, HEIGHT)


@query("g1_add_grids", f"WITH {TWO} SELECT y, x, {r6('ga.v*0.25+gb.v*2')} AS v FROM ga JOIN gb USING (y, x)")
def g1(spark, d):
    return rounded(R.add_grids(grid_q(spark, d, WIDTH, HEIGHT, 0), grid_q(spark, d, WIDTH, HEIGHT, 1), 0.25, 2.0), "v")


# two elements of four lanes for each part: columns of the part table as doubles
_E = "e AS (SELECT p_partkey AS k, p_size::DOUBLE AS a0, p_retailprice/100 AS a1, (p_partkey % 7)::DOUBLE AS a2, (p_partkey % 11)::DOUBLE AS a3, (p_partkey % 5)::DOUBLE AS b0, p_size/10.0 AS b1, (p_partkey % 3)::DOUBLE - 1 AS b2, p_retailprice/1000 AS b3 FROM part)"


def _elements(spark, d):
    p = table(spark, d, "part")
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    m = lambda n: (k % n).cast("double")
    return p.select(k.alias("k"), F.array(size, price / 100, m(7), m(11)).alias("a"), F.array(m(5), size / 10, m(3) - 1, price / 1000).alias("b"))


def _out(df, value, n):
    return rounded(df.select("k", *[value[i].alias(f"v{i}") for i in range(n)]), *[f"v{i}" for i in range(n)], digits=5)


def _cols(*exprs):
    return ", ".join(f"{r6(e, 5)} AS v{i}" for i, e in enumerate(exprs))


def _algebra(name, exprs, value, n):
    query(name, f"WITH {_E} SELECT k, {_cols(*exprs)} FROM e")(lambda spark, d: _out(_elements(spark, d), value(F.col("a"), F.col("b")), n))


_two = lambda c: F.slice(c, 1, 2)
_three = lambda c: F.slice(c, 1, 3)
_algebra("g2_add_fields", [f"a{i}+b{i}" for i in range(4)], A.add, 4)
_algebra("g3_sub_fields", [f"a{i}-b{i}" for i in range(4)], A.sub, 4)
_algebra("g4_mul_complex", ["a0*b0-a1*b1", "a0*b1+a1*b0"], lambda a, b: A.mul(_two(a), _two(b), "complex"), 2)
_algebra(
    "g4_mul_quaternion",
    ["a0*b0-a1*b1-a2*b2-a3*b3", "a0*b1+a1*b0+a2*b3-a3*b2", "a0*b2-a1*b3+a2*b0+a3*b1", "a0*b3+a1*b2-a2*b1+a3*b0"],
    lambda a, b: A.mul(a, b, "quaternion"),
    4,
)
_algebra("g5_scale_field", [f"a{i}*2.5" for i in range(4)], lambda a, b: A.scale(a, 2.5), 4)
_algebra("g6_dot_fields", ["a0*b0+a1*b1+a2*b2"], lambda a, b: F.array(A.dot(_three(a), _three(b))), 1)
_algebra("g7_cross_fields", ["a1*b2-a2*b1", "a2*b0-a0*b2", "a0*b1-a1*b0"], lambda a, b: A.cross(_three(a), _three(b)), 3)
_algebra("g8_normalize_field", [f"b{i}/sqrt(b0*b0+b1*b1+b2*b2)" for i in range(3)], lambda a, b: A.normalize(_three(b)), 3)
_algebra("g9_complex_parts", ["a0", "b0", "a0", "-b0"], lambda a, b: F.array(A.real(A.lanes(a[0], b[0])), A.imaginary(A.lanes(a[0], b[0])), *[A.conjugate(A.lanes(a[0], b[0]), "complex")[i] for i in range(2)]), 4)
_algebra("g12_conjugate", ["a0", "-a1", "-a2", "-a3"], lambda a, b: A.conjugate(a, "quaternion"), 4)
_algebra("g13_magnitude", ["sqrt(a0*a0+a1*a1+a2*a2+a3*a3)"], lambda a, b: F.array(A.magnitude(a)), 1)


@query("g14_threshold", f"WITH {GRID} SELECT y, x, (CASE WHEN v >= 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS v FROM grid")
def g14(spark, d):
    return R.threshold(_grid(spark, d), 2.0)


@query("g14_threshold_soft", f"WITH {GRID} SELECT y, x, {r6('1/(1+exp(-(v-1)*3))')} AS v FROM grid")
def g14s(spark, d):
    return rounded(R.threshold(_grid(spark, d), 1.0, 3.0), "v")


def _stencil(src: str, weights: list[float], value: str = "v") -> str:
    """Two-dimensional clamped stencil in SQL: joins to clamped offsets."""
    r = len(weights) // 2
    w = "(VALUES " + ", ".join(f"({k - r}, {x!r}::DOUBLE)" for k, x in enumerate(weights)) + ")"
    return (
        f"(SELECT g.y, g.x, sum(s.{value}*p.w*q.w) AS {value} FROM {src} g CROSS JOIN {w} p(dx, w) CROSS JOIN {w} q(dy, w) "
        f"JOIN {src} s ON s.x = least(greatest(g.x+p.dx, 0), {WIDTH - 1}) AND s.y = least(greatest(g.y+q.dy, 0), {HEIGHT - 1}) GROUP BY 1, 2)"
    )


@query("g15_box_sum", f"WITH {GRID} SELECT y, x, v FROM {_stencil('grid', [1.0] * 5)}")
def g15(spark, d):
    return R.box_sum(_grid(spark, d), 2)


@query("g15_gaussian", f"WITH {GRID} SELECT y, x, {r6('v')} AS v FROM {_stencil('grid', R.gaussian_weights(2))}")
def g15g(spark, d):
    return rounded(R.convolve(_grid(spark, d), R.gaussian_weights(2)), "v")


@query(
    "g16_getis_ord",
    f"""WITH {GRID}, b AS {_stencil('grid', [1.0] * 5)}, s AS (SELECT avg(v) AS mu, avg(v*v) AS m2, count(*) AS n FROM grid)
    SELECT y, x, {r6('(v-mu*25)/(sqrt(m2-mu*mu)*sqrt(25*(n-25)/(n-1.0)))', 5)} AS v FROM b, s""",
)
def g16(spark, d):
    return rounded(R.getis_ord(_grid(spark, d)), "v", digits=5)


_CENTRES = f"axis2 AS (SELECT y::INT AS y, x::INT AS x, -450+(x+0.5)*{900 / 32} AS cx, -450+(31-y+0.5)*{900 / 32} AS cy FROM range(32) a(y), range(32) b(x))"


@query(
    "g17_splat_density",
    f"""WITH {CELLS}, {_CENTRES} SELECT a.y, a.x, {r6("coalesce(sum(exp(-((cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y))/1800.0)), 0)", 5)} AS v
    FROM axis2 a LEFT JOIN cells c ON abs(cx-c.x) <= 120 AND abs(cy-c.y) <= 120 GROUP BY 1, 2""",
)
def g17(spark, d):
    return rounded(R.kde(cells_emb(spark, d), W, 32, 32, 30.0), "v", digits=5)


@query(
    "p26_weighted_kde",
    f"""WITH {CELLS}, {_CENTRES} SELECT a.y, a.x, {r6("coalesce(sum((1+type_id)*exp(-((cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y))/1800.0)), 0)", 5)} AS v
    FROM axis2 a LEFT JOIN cells c ON abs(cx-c.x) <= 90 AND abs(cy-c.y) <= 90 GROUP BY 1, 2""",
)
def p26(spark, d):
    return rounded(R.kde(cells_emb(spark, d), W, 32, 32, 30.0, 3.0, weight=(1 + F.col("type_id")).cast("double")), "v", digits=5)


_AT = lambda c, dy, dx: f"(SELECT v FROM {c} s WHERE s.y = least(greatest(g.y+({dy}),0),{HEIGHT - 1}) AND s.x = least(greatest(g.x+({dx}),0),{WIDTH - 1}))"
_GRAD = f"gr AS (SELECT y, x, ({_AT('grid', 0, 1)}-{_AT('grid', 0, -1)})*0.5 AS gx, ({_AT('grid', 1, 0)}-{_AT('grid', -1, 0)})*0.5 AS gy FROM grid g)"


@query("g18_gradient", f"WITH {GRID}, {_GRAD} SELECT y, x, gx + 0.0 AS gx, gy + 0.0 AS gy FROM gr")
def g18(spark, d):
    return rounded(R.gradient(_grid(spark, d)).select("y", "x", "gx", "gy"), "gx", "gy")


@query("g19_gradient_magnitude", f"WITH {GRID}, {_GRAD} SELECT y, x, {r6('sqrt(gx*gx+gy*gy)')} AS v FROM gr")
def g19(spark, d):
    g = R.gradient(_grid(spark, d))
    return rounded(g.select("y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("v")), "v")


@query("g20_laplacian", f"WITH {GRID} SELECT y, x, {_AT('grid', 0, 1)}+{_AT('grid', 0, -1)}+{_AT('grid', 1, 0)}+{_AT('grid', -1, 0)}-4*v+0.0 AS lap FROM grid g")
def g20(spark, d):
    return rounded(R.laplacian(_grid(spark, d)).select("y", "x", "lap"), "lap")


@query(
    "g21_divergence",
    f"""WITH {GRID}, {_GRAD}, gxs AS (SELECT y, x, gx AS v FROM gr), gys AS (SELECT y, x, gy AS v FROM gr)
    SELECT y, x, {r6(f"({_AT('gxs', 0, 1)}-{_AT('gxs', 0, -1)})*0.5+({_AT('gys', 1, 0)}-{_AT('gys', -1, 0)})*0.5")} AS div FROM gr g""",
)
def g21(spark, d):
    return rounded(R.divergence(R.gradient(_grid(spark, d))).select("y", "x", "div"), "div")


@query(
    "g22_structure_orientation",
    f"""WITH {GRID}, {_GRAD}, j1 AS (SELECT y, x, gx*gx AS v FROM gr), j2 AS (SELECT y, x, gx*gy AS v FROM gr), j3 AS (SELECT y, x, gy*gy AS v FROM gr),
    m AS (SELECT y, x, p.v/25 AS a, q.v/25 AS b, r.v/25 AS c FROM {_stencil('j1', [1.0] * 5)} p JOIN {_stencil('j2', [1.0] * 5)} q USING (y, x) JOIN {_stencil('j3', [1.0] * 5)} r USING (y, x)),
    o AS (SELECT y, x, 0.5*atan2(2*b, a-c) AS t, CASE WHEN a+c > 0 THEN sqrt((a-c)*(a-c)+4*b*b)/(a+c) ELSE 0 END AS h FROM m)
    SELECT y, x, {r6('cos(t)*h', 5)} AS ox, {r6('sin(t)*h', 5)} AS oy FROM o""",
)
def g22(spark, d):
    return rounded(R.structure_orientation(_grid(spark, d)), "ox", "oy", digits=5)


@query("g23_wavelet_53")
def g23(spark, d):
    return V.fdwt(_grid(spark, d), WIDTH, HEIGHT, "5/3", 3)


def _haar_free_level(src: str, along: str, n: int) -> str:
    """One 5/3 level along an axis in SQL."""
    other, low = ("y", (n + 1) // 2) if along == "x" else ("x", (n + 1) // 2)
    at = lambda t, e: f"(SELECT v FROM {t} s WHERE s.{other} = g.{other} AND s.{along} = {e})"
    last_even, last_odd = (n - 1) // 2 * 2, (n // 2) * 2 - 1
    odd = f"(SELECT {other}, {along}, v - floor(({at(src, f'g.{along}-1')}+{at(src, f'least(g.{along}+1, {last_even})')})/2) AS v FROM {src} g WHERE {along} % 2 = 1)"
    return (
        f"od_{along} AS {odd}, ev_{along} AS (SELECT {other}, {along}, v + floor(({at(f'od_{along}', f'greatest(g.{along}-1, 1)')}+{at(f'od_{along}', f'least(g.{along}+1, {last_odd})')}+2)/4) AS v "
        f"FROM {src} g WHERE {along} % 2 = 0), lv_{along} AS (SELECT {other}, ({along}//2)::INT AS {along}, v FROM ev_{along} UNION ALL SELECT {other}, ({along}//2+{low})::INT AS {along}, v FROM od_{along})"
    )


@query("g23_wavelet_53_level", f"WITH {GRID}, {_haar_free_level('grid', 'x', WIDTH)}, {_haar_free_level('lv_x', 'y', HEIGHT)} SELECT y, x, v FROM lv_y")
def g23l(spark, d):
    return V.fdwt(_grid(spark, d), WIDTH, HEIGHT, "5/3", 1).select("y", "x", "v")


@query("g24_wavelet_round_trip_53", f"WITH {GRID} SELECT y, x, v FROM grid")
def g24(spark, d):
    return V.idwt(V.fdwt(_grid(spark, d), WIDTH, HEIGHT, "5/3", 3), WIDTH, HEIGHT, "5/3", 3)


@query("g24_wavelet_round_trip_97", f"WITH {GRID} SELECT y, x, v FROM grid")
def g24b(spark, d):
    return rounded(V.idwt(V.fdwt(_grid(spark, d), WIDTH, HEIGHT, "9/7", 3), WIDTH, HEIGHT, "9/7", 3), "v")


@query("g25_threshold_detail", f"WITH {GRID} SELECT y, x, CASE WHEN x < 12 AND y < 10 THEN v ELSE sign(v)*greatest(abs(v)-0.3, 0) END AS v FROM grid")
def g25(spark, d):
    return rounded(V.threshold_detail(_grid(spark, d), WIDTH, HEIGHT, 1), "v")


@query(
    "p21_tcm_field",
    f"""WITH {CELLS}, {_CENTRES}, n AS (SELECT a.cell_id, count(b.cell_id) AS c FROM cells a LEFT JOIN cells b ON b.type_id = 1 AND (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) < 3600.0 WHERE a.type_id = 0 GROUP BY 1),
    m AS (SELECT cell_id, x, y, c/((SELECT count(*) FROM cells WHERE type_id = 1)*{pi * 3600 / P.area(W)}) AS m FROM cells JOIN n USING (cell_id)),
    t AS (SELECT x, y, CASE WHEN m >= 3 THEN 1.0 WHEN m > 1 THEN (m-1)/2.0 WHEN m <= 1/3.0 THEN -1.0 ELSE (1-1/m)/2.0 END AS t,
      floor((x+450)/{900 / 32}) AS ox, floor((y+450)/{900 / 32}) AS oy FROM m)
    SELECT a.y, a.x, {r6(f"coalesce(sum(t*exp(-((cx-t.x)*(cx-t.x)+(cy-t.y)*(cy-t.y))/1800.0)/{30 * sqrt(2 * pi)}), 0)", 7)} AS v
    FROM axis2 a LEFT JOIN t ON abs(a.x-ox) <= 4 AND abs(31-a.y-oy) <= 4 GROUP BY 1, 2""",
)
def p21(spark, d):
    m = P.cross_marks(cells_emb(spark, d), 0, 1, 60.0, W).withColumn("t", P.mark_transform(F.col("m"), 3.0))
    return rounded(R.tcm_field(m, W, 32, 32, 30.0), "v", digits=7)


_PIXEL = f"{CELLS}, ax AS (SELECT y::INT AS y, x::INT AS x, -450+(x+0.5)*75 AS cx, -450+(11-y+0.5)*75 AS cy FROM range(12) a(y), range(12) b(x))"


def _pixels(spark):
    x0, y0, _, _ = W
    g = dense_grid(spark, 12, 12)
    return g.select((F.col("y") * 12 + F.col("x")).alias("cell_id"), (x0 + (F.col("x") + 0.5) * 75.0).alias("x"), (y0 + (F.lit(11) - F.col("y") + 0.5) * 75.0).alias("y"))


@query(
    "p27_dtm_field",
    f"""WITH {_PIXEL}, r AS (SELECT a.y, a.x, (cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y) AS d2, row_number() OVER (PARTITION BY a.y, a.x ORDER BY (cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y), cell_id) AS k FROM ax a, cells c)
    SELECT y*12+x AS pixel, {r6('sqrt(avg(d2))')} AS v FROM r WHERE k <= 5 GROUP BY 1""",
)
def p27(spark, d):
    from pointloom.operators.neighbors import k_nearest

    near = k_nearest(_pixels(spark), cells_emb(spark, d), 5, same=False)
    return rounded(near.groupBy(F.col("i").cast("int").alias("pixel")).agg(F.sqrt(F.avg(F.col("dist") * F.col("dist"))).alias("v")), "v")


@query("p28_distance_field", f"WITH {_PIXEL} SELECT a.y*12+a.x AS pixel, {r6('sqrt(min((cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y)))')} AS v FROM ax a, cells c GROUP BY 1")
def p28(spark, d):
    from pointloom.operators.neighbors import k_nearest

    near = k_nearest(_pixels(spark), cells_emb(spark, d), 1, same=False)
    return rounded(near.select(F.col("i").cast("int").alias("pixel"), F.col("dist").alias("v")), "v")


@query("p29_point_hotspots")
def p29(spark, d):
    return rounded(R.getis_ord(R.kde(cells_emb(spark, d), W, 32, 32, 30.0)), "v", digits=4)


_J = 64 * 64 / 16.0
_RAST = f"""{CELLS}, axis2 AS (SELECT y::INT AS y, x::INT AS x, -450+(x+0.5)*{900 / 32} AS cx, -450+(31-y+0.5)*{900 / 32} AS cy FROM range(32) a(y), range(32) b(x)),
    ch AS (SELECT *, type_id % 3 AS channel FROM cells),
    ras AS (SELECT k.channel, a.y, a.x, coalesce(sum(CASE WHEN (cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y) < 3600.0 THEN {2 / (pi * 3600)!r}*(1-((cx-c.x)*(cx-c.x)+(cy-c.y)*(cy-c.y))/3600.0) END), 0) AS v
      FROM (SELECT DISTINCT channel FROM ch) k CROSS JOIN axis2 a LEFT JOIN ch c ON c.channel = k.channel AND abs(cx-c.x) <= 60 AND abs(cy-c.y) <= 60 GROUP BY 1,2,3)"""


def _rasters(spark, d):
    c = cells_emb(spark, d).withColumn("channel", F.col("type_id") % 3)
    return R.splat(c, W, 32, 32, 60.0, P.kernel_at("epanechnikov", F.col("d2"), 60.0), keys=("channel",))


@query("p30_channel_rasters", f"WITH {_RAST} SELECT channel, y, x, {r6('1e6*v', 4)} AS v FROM ras")
def p30(spark, d):
    return rounded(_rasters(spark, d).withColumn("v", 1e6 * F.col("v")), "v", digits=4)


@query(
    "p31_gram_matrix",
    f"""WITH {_RAST}, s AS (SELECT a.channel AS a, b.channel AS b, sum(a.v*b.v) AS sab, avg(a.v) AS ma, avg(b.v) AS mb, stddev_pop(a.v) AS sa, stddev_pop(b.v) AS sb, count(*) AS n FROM ras a JOIN ras b USING (y, x) GROUP BY 1, 2)
    SELECT a, b, {r6(f'sab*{(900 / 32) ** 2}')} AS c, {r6('1e6*ma', 3)} AS mean_a, {r6('1e6*mb', 3)} AS mean_b, {r6('(sab/n-ma*mb)/sa/sb')} AS corr FROM s""",
)
def p31(spark, d):
    g = R.gram(_rasters(spark, d), (900 / 32) ** 2).withColumns({m: 1e6 * F.col(m) for m in ("mean_a", "mean_b")})
    return rounded(rounded(g, "mean_a", "mean_b", digits=3), "c", "corr")


_INNER = (-250.0, -250.0, 250.0, 250.0)
_RAST_IN = _RAST.replace("-450+", "-250+").replace(f"{900 / 32}", f"{500 / 32}")


@query(
    "p31_association",
    f"""WITH {_RAST_IN}, s AS (SELECT a.channel AS a, b.channel AS b, sum(a.v*b.v)*{(500 / 32) ** 2} AS c FROM ras a JOIN ras b USING (y, x) GROUP BY 1, 2),
    m AS (SELECT channel, count(*) FILTER (x BETWEEN -250 AND 250 AND y BETWEEN -250 AND 250)::DOUBLE AS mass,
      count(*) FILTER (x BETWEEN -310 AND 310 AND y BETWEEN -310 AND 310 AND NOT (x BETWEEN -250 AND 250 AND y BETWEEN -250 AND 250))::DOUBLE AS apron FROM ch GROUP BY 1),
    t AS (SELECT a, b, c, p.mass AS mass_a, q.mass AS mass_b, p.apron AS apron_a, CASE WHEN a = b THEN p.mass*4/(pi()*3600*3) ELSE 0 END AS self_term FROM s JOIN m p ON p.channel = a JOIN m q ON q.channel = b)
    SELECT a, b, {r6('c')} AS c, {r6('(c-self_term)/(mass_a*mass_b/250000.0)', 5)} AS g, {r6('self_term')} AS self_term, mass_a, mass_b, apron_a FROM t""",
)
def p31a(spark, d):
    c = cells_emb(spark, d).withColumn("channel", F.col("type_id") % 3)
    rasters = R.splat(c, _INNER, 32, 32, 60.0, P.kernel_at("epanechnikov", F.col("d2"), 60.0), keys=("channel",))
    got = R.association(R.gram(rasters, (500 / 32) ** 2), c, _INNER, 60.0, 1)
    return rounded(rounded(got, "c", "self_term"), "g", digits=5)


@query("p33_colocation_modes")
def p33(spark, d):
    from pointloom.operators.manifold import eigen_of

    g = R.gram(_rasters(spark, d), (900 / 32) ** 2)
    return rounded(eigen_of(g.select("a", "b", F.col("corr").alias("v"))), "value", "share", "loading", digits=5)


@query(
    "p35_channels_from_features",
    "SELECT vec_id AS cell_id, k::INT AS channel, round(embedding[k+1]::DOUBLE, 6) + 0.0 AS w FROM embeddings, range(64) r(k) WHERE embedding[k+1] > 0",
)
def p35(spark, d):
    f = features(spark, d).select(F.col("row").alias("cell_id"), F.posexplode("features").alias("channel", "w"))
    return rounded(f.where("w > 0"), "w")


@query(
    "p36_permuted_labels",
    f"""WITH {CELLS}, a AS (SELECT s AS sim, cell_id, x, y, row_number() OVER (PARTITION BY s ORDER BY cell_id) AS k FROM cells, range(1, 4) r(s)),
    b AS (SELECT s AS sim, type_id, row_number() OVER (PARTITION BY s ORDER BY md5('8-' || s || '-' || cell_id), cell_id) AS k FROM cells, range(1, 4) r(s))
    SELECT sim::INT AS sim, {r6('x')} AS x, {r6('y')} AS y, type_id FROM a JOIN b USING (sim, k)""",
)
def p36(spark, d):
    from pointloom.operators.inference import permuted_labels

    return rounded(permuted_labels(cells_emb(spark, d), 3, 8), "x", "y")
