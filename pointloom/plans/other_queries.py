"""Queries of sources and sinks, multiscale pyramids, simulations, genomes, colour and the operation graph."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.functions.rng import uniform
from pointloom.operators import simulate as S
from pointloom.operators import tables as B
from pointloom.plans.registry import GRID, query, r6, rounded
from pointloom.sources.tables import cells_emb, coo, dense_grid, features, grid_q, points3, series, table

_COO = "coo AS (SELECT user_id AS cell, event_type AS var, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"
_SERIES = "s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS tick, value AS v FROM events)"


@query("s3_dense_grid", "SELECT y::INT AS y, x::INT AS x FROM range(20) a(y), range(24) b(x)")
def s3(spark, d):
    return dense_grid(spark, 24, 20)


@query(
    "s5_inspect_columns",
    """SELECT 'c_name' AS "column", avg((try_cast(c_name AS DOUBLE) IS NOT NULL)::INT::DOUBLE) AS numeric, count(DISTINCT c_name) AS "distinct" FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 2000)
    UNION ALL SELECT 'c_acctbal', avg((try_cast(c_acctbal AS DOUBLE) IS NOT NULL)::INT::DOUBLE), count(DISTINCT c_acctbal) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 2000)
    UNION ALL SELECT 'c_mktsegment', avg((try_cast(c_mktsegment AS DOUBLE) IS NOT NULL)::INT::DOUBLE), count(DISTINCT c_mktsegment) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 2000)""",
)
def s5(spark, d):
    return B.inspect_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey")


@query("s6_group_cells", "SELECT c_mktsegment AS type_id, count(*) AS n, min(c_custkey) AS first, 0::BIGINT AS skipped FROM customer GROUP BY 1")
def s6(spark, d):
    return B.group_cells(table(spark, d, "customer"), "c_acctbal", "c_nationkey", "c_mktsegment", "c_custkey")


@query("s8_wide_matrix", f"WITH {_COO} SELECT cell, coalesce(max(v) FILTER (var = 'view'), 0)+0.0 AS view, coalesce(max(v) FILTER (var = 'click'), 0)+0.0 AS click FROM coo GROUP BY 1")
def s8(spark, d):
    wide = coo(spark, d).groupBy("cell").pivot("var", ["view", "click"]).agg(F.max("v"))
    return rounded(wide.fillna(0.0, ["view", "click"]), "view", "click", digits=2)


@query("s9_n_obs", "SELECT count(DISTINCT user_id) AS n FROM events")
def s9(spark, d):
    return coo(spark, d).select("cell").distinct().agg(F.count("*").alias("n"))


@query(
    "s11_region_cells",
    """SELECT o_orderkey AS cell_id, o_orderpriority AS region, CASE lower(o_orderstatus) WHEN 'o' THEN 0 ELSE 1 END AS type_id FROM orders WHERE lower(o_orderstatus) IN ('o', 'f')""",
)
def s11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("region"), F.col("o_orderstatus").alias("type_id"))
    return B.region_cells(o, ["o", "f"], fold_case=True).select("cell_id", "region", "type_id")


@query("s12_one_region", "SELECT o_orderkey AS cell_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus NOT IN ('P')")
def s12(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderpriority") == "1-URGENT") & ~F.col("o_orderstatus").isin("P")).select(F.col("o_orderkey").alias("cell_id"))


@query(
    "s15_sparse_columns",
    f"""WITH {_COO}, w(slot, var) AS (VALUES (0, 'purchase'), (1, 'view'), (2, 'none'), (3, 'purchase'))
    SELECT c.cell, slot, coalesce(v, 0)+0.0 AS v FROM (SELECT DISTINCT cell FROM coo) c CROSS JOIN w LEFT JOIN coo ON coo.cell = c.cell AND coo.var = w.var""",
)
def s15(spark, d):
    m = coo(spark, d)
    return B.sparse_columns(m, m.select("cell").distinct(), ["purchase", "view", "none", "purchase"])


@query("s16_dense_columns", "SELECT vec_id AS row, k::INT AS col, round(embedding[k+1]::DOUBLE, 6)+0.0 AS v FROM embeddings, (VALUES (0), (5)) t(k)")
def s16(spark, d):
    f = features(spark, d).select("row", F.posexplode("features").alias("col", "v")).where(F.col("col").isin(0, 5))
    return rounded(f, "v")


@query("s18_variable_stats", f"WITH {_COO} SELECT var, round(sum(v), 2)+0.0 AS total, greatest(max(v), 0)+0.0 AS max, count(*) FILTER (v <> 0) AS non_zero FROM coo GROUP BY 1")
def s18(spark, d):
    return rounded(B.variable_stats(coo(spark, d)), "total", "max", digits=2)


@query(
    "s20_variable_genes",
    f"""WITH f AS (SELECT vec_id, k::INT AS col, ln(1+greatest(embedding[k+1]::DOUBLE, 0)) AS v FROM embeddings, range(64) r(k)),
    s AS (SELECT col, var_samp(v) AS variance FROM f GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY variance DESC, col) AS k FROM s WHERE variance > 0)
    SELECT col, {r6('variance')} AS variance FROM r WHERE k <= 10""",
)
def s20(spark, d):
    return rounded(B.variable_genes(features(spark, d), 10), "variance")


@query("s21_observation_labels", "SELECT e.vec_id AS row, (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::INT AS code FROM embeddings e")
def s21(spark, d):
    return B.observation_labels(table(spark, d, "embeddings"), "label").select(F.col("vec_id").alias("row"), "code")


@query(
    "s27_wave_grid",
    f"SELECT y::INT AS y, x::INT AS x, {r6('sin(2*pi()*x/12)*cos(2*pi()*y/10)')} AS sine, ((x//4 + y//4) % 2)::DOUBLE AS checker FROM range(20) a(y), range(24) b(x)",
)
def s27(spark, d):
    from math import pi

    g = dense_grid(spark, 24, 20)
    sine = F.sin(2 * pi * F.col("x") / 12) * F.cos(2 * pi * F.col("y") / 10)
    return rounded(g.select("y", "x", sine.alias("sine"), (F.expr("(x div 4 + y div 4) % 2")).cast("double").alias("checker")), "sine")


@query("s28_random_pattern")
def s28(spark, d):
    return S.random_pattern(spark, 1000, (0.0, 0.0, 1000.0, 1000.0), 17, 3)


@query("s28_clustered_pattern")
def s28c(spark, d):
    return S.clustered_pattern(spark, 40, 25, 30.0, (0.0, 0.0, 1000.0, 1000.0), 18)


@query(
    "k7_compressed_rows",
    f"""WITH {_COO}, r AS (SELECT cell AS row, count(*) AS n, list(var ORDER BY var) AS i, list(v ORDER BY var) AS d FROM coo GROUP BY 1)
    SELECT row, coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, array_to_string(i, ',') AS indices, len(d) AS n FROM r""",
)
def k7(spark, d):
    c = B.compressed_rows(coo(spark, d), "cell", "var", "v")
    return c.select("row", F.col("start").cast("long").alias("start"), F.array_join("indices", ",").alias("indices"), F.size("data").cast("long").alias("n"))


@query(
    "k11_clean_keys",
    r"""WITH k AS (SELECT p_partkey, p_name, regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g') AS base FROM part),
    u AS (SELECT DISTINCT p_name, base FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_name) AS k FROM u)
    SELECT p_name, CASE WHEN k > 1 THEN base || '__' || k ELSE base END AS key FROM n""",
)
def k11(spark, d):
    return B.clean_keys(table(spark, d, "part").select("p_name").distinct(), "p_name")


@query("g27_delay", f"WITH {_SERIES} SELECT user_id, tick, lag(v, 3, 0.0) OVER (PARTITION BY user_id ORDER BY tick) AS delayed FROM s")
def g27(spark, d):
    return S.delayed(series(spark, d), 3, 0.0).select("user_id", "tick", "delayed")


@query(
    "g28_fractional_sample",
    f"""WITH {_SERIES}, l AS (SELECT *, first_value(v) OVER w AS f, lag(v, 2) OVER w AS a, lag(v, 3) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tick))
    SELECT user_id, tick, {r6('coalesce(a, f)+(coalesce(b, f)-coalesce(a, f))*0.25')} AS sample FROM l""",
)
def g28(spark, d):
    return rounded(S.sample_back(series(spark, d), 2.25).select("user_id", "tick", "sample"), "sample")


@query(
    "g29_one_pole",
    f"""WITH RECURSIVE {_SERIES}, y AS (SELECT user_id, tick, v AS smooth FROM s WHERE tick = 0 UNION ALL
      SELECT s.user_id, s.tick, y.smooth + {1 - exp(-1 / 4.0)!r} * (s.v - y.smooth) FROM y JOIN s ON s.user_id = y.user_id AND s.tick = y.tick + 1)
    SELECT user_id, tick, {r6('smooth', 5)} AS smooth FROM y""",
)
def g29(spark, d):
    return rounded(S.one_pole(series(spark, d), 4.0), "smooth", digits=5)


# --- multiscale -------------------------------------------------------------------------------------------------


@query("d1_compose_affine", f"SELECT p_partkey AS k, {r6('2*p_size+1', 4)}::DOUBLE AS x, {r6('3*(p_retailprice-5)', 4)} AS y FROM part")
def d1(spark, d):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    m = X.compose(lit(2, 0, 0, 3, 1, 0), lit(1, 0, 0, 1, 0, -5))
    x, y = X.apply_affine(m, F.col("p_size"), F.col("p_retailprice"))
    return rounded(table(spark, d, "part").select(F.col("p_partkey").alias("k"), x.alias("x"), y.alias("y")), "x", "y", digits=4)


@query("d2_micrometres", f"SELECT p_partkey AS k, (CASE p_partkey % 3 WHEN 0 THEN p_size*1000.0 WHEN 1 THEN {r6('p_size*0.001')} END)::DOUBLE AS um FROM part")
def d2(spark, d):
    unit = F.element_at(F.array(F.lit("Millimeter"), F.lit("nanometer"), F.lit("furlong")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return rounded(table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.to_micrometres(F.col("p_size").cast("double"), unit).alias("um")), "um")


_LEVELS = "lv AS (SELECT level::INT AS level, ceil(5000/pow(2.0, level))::BIGINT AS width, ceil(3000/pow(2.0, level))::BIGINT AS height FROM range(5) r(level))"
_BOXES = f"""{_LEVELS}, bx AS (SELECT level, cx, cy, least(cx*512, width)*pow(2.0, level) AS x0, least(cy*512, height)*pow(2.0, level) AS y0,
    least((cx+1)*512, width)*pow(2.0, level) AS x1, least((cy+1)*512, height)*pow(2.0, level) AS y1 FROM lv, range(10) a(cx), range(6) b(cy) WHERE cx < ceil(width/512.0) AND cy < ceil(height/512.0))"""


def _boxes(spark):
    return B.chunk_boxes(B.pyramid_levels(spark, (5000, 3000), (512, 512), 5), (512, 512))


@query("d6_pyramid_levels", f"WITH {_LEVELS} SELECT level, width, height, ceil(width/512.0)::BIGINT AS chunks_x, ceil(height/512.0)::BIGINT AS chunks_y, 1048576::BIGINT AS chunk_bytes FROM lv")
def d6(spark, d):
    return B.pyramid_levels(spark, (5000, 3000), (512, 512), 5)


@query("d6_chunk_boxes", f"WITH {_BOXES} SELECT * FROM bx")
def d6b(spark, d):
    return _boxes(spark)


@query("d7_select_chunks", f"WITH {_BOXES} SELECT cx, cy FROM bx WHERE level = 1 AND x0 < 3000 AND x1 > 900 AND y0 < 2500 AND y1 > 100")
def d7(spark, d):
    return B.select_chunks(_boxes(spark), (900.0, 100.0, 3000.0, 2500.0), 1).select("cx", "cy")


@query(
    "d8_level_within_budget",
    f"WITH {_BOXES} SELECT level, count(*) AS chunks, count(*)*1048576 AS bytes FROM bx WHERE x0 < 3000 AND x1 > 900 AND y0 < 2500 AND y1 > 100 GROUP BY 1 HAVING count(*)*1048576 <= 8000000 ORDER BY 1 LIMIT 1",
)
def d8(spark, d):
    return B.level_within_budget(_boxes(spark), (900.0, 100.0, 3000.0, 2500.0), 1048576, 8_000_000)


@query("d5_frustum", f"WITH {_BOXES} SELECT level, cx, cy FROM bx WHERE x1 + y1 - 2000 >= 0 AND 4000 - x0 >= 0")
def d5(spark, d):
    b = _boxes(spark)
    return b.where(B.frustum_visible(b, [(1.0, 1.0, -2000.0), (-1.0, 0.0, 4000.0)], ("x0", "y0"), ("x1", "y1"))).select("level", "cx", "cy")


# --- simulations ------------------------------------------------------------------------------------------------


@query("x1_gray_scott")
def x1(spark, d):
    return rounded(S.gray_scott(S.gray_scott_seed(dense_grid(spark, 24, 20), 24, 20), 6), "u", "v")


_CLAMP = lambda c, dy, dx: f"(SELECT {c} FROM seed s WHERE s.y = least(greatest(g.y+({dy}),0),19) AND s.x = least(greatest(g.x+({dx}),0),23))"
_LAP = lambda c: "(" + "+".join(_CLAMP(c, *s) for s in ((0, 1), (0, -1), (1, 0), (-1, 0))) + f"-4*{c})"


@query(
    "x1_gray_scott_step",
    f"""WITH seed AS (SELECT y::INT AS y, x::INT AS x, CASE WHEN abs(x-12) <= 2 AND abs(y-10) <= 2 THEN 0.5::DOUBLE ELSE 1 END AS u, CASE WHEN abs(x-12) <= 2 AND abs(y-10) <= 2 THEN 0.25::DOUBLE ELSE 0 END AS v FROM range(20) a(y), range(24) b(x))
    SELECT y, x, {r6(f"u+0.16*{_LAP('u')}-u*v*v+0.06*(1-u)")} AS u, {r6(f"v+0.08*{_LAP('v')}+u*v*v-0.122*v")} AS v FROM seed g""",
)
def x1s(spark, d):
    return rounded(S.gray_scott(S.gray_scott_seed(dense_grid(spark, 24, 20), 24, 20), 1), "u", "v")


_P3 = "p AS (SELECT vec_id AS id, 100*embedding[1]::DOUBLE AS x, 100*embedding[2]::DOUBLE AS y, 100*embedding[3]::DOUBLE AS z FROM embeddings)"


@query(
    "x3_forces",
    f"""WITH {_P3}, r AS (SELECT *, CASE WHEN sqrt(x*x+y*y+z*z) > 15 THEN -0.5*(sqrt(x*x+y*y+z*z)-15)/sqrt(x*x+y*y+z*z) ELSE 0 END AS c FROM p)
    SELECT id, {r6('c*x-0.2*y-0.1*x-0.1*y')} AS fx, {r6('c*y+0.2*x-0.1*y+0.1*x')} AS fy, {r6('c*z-0.1*z')} AS fz FROM r""",
)
def x3(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    parts = zip(S.constrain(x, y, z, 15.0, 0.5), S.vortex(x, y, 0.2), S.orbit(x, y, z, 0.1), strict=True)
    return rounded(points3(spark, d).select("id", *[sum(f[1:], f[0]).alias(f"f{c}") for c, f in zip("xyz", parts, strict=True)]), "fx", "fy", "fz")


_PULL = lambda c: f"0.3*avg(b.{c}-a.{c})+0.2*sum(-(b.{c}-a.{c})/d*(1-d/8.0))+0.1*sum((b.{c}-a.{c})/d*(d-2.0))"


@query(
    "x4_neighbour_forces",
    f"""WITH {_P3}, n AS (SELECT a.id, count(*) AS n, {', '.join(f'{_PULL(c)} AS f{c}' for c in 'xyz')} FROM p a JOIN LATERAL (SELECT *, sqrt((p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y)+(p.z-a.z)*(p.z-a.z)) AS d FROM p) b ON b.id <> a.id AND d < 8 GROUP BY 1)
    SELECT p.id, coalesce(n, 0) AS n, {', '.join(f"{r6(f'coalesce(f{c}, 0)')} AS f{c}" for c in 'xyz')} FROM p LEFT JOIN n USING (id)""",
)
def x4(spark, d):
    return rounded(S.neighbour_forces(points3(spark, d), 8.0, cohere=0.3, separate=0.2, spring=0.1, rest=2.0), "fx", "fy", "fz")


@query(
    "x5_partner_orbit",
    f"WITH {_P3} SELECT a.id, {', '.join(f'{r6(f"0.5*(b.{c}-a.{c})")} AS f{c}' for c in 'xyz')} FROM p a JOIN p b ON b.id = (a.id + 3) % (SELECT count(*) FROM p)",
)
def x5(spark, d):
    return rounded(S.partner_orbit(points3(spark, d), 3, 0.5), "fx", "fy", "fz")


@query(
    "x6_integrate",
    f"WITH {_P3}, f AS (SELECT id, x, y, z + greatest(-0.5, least(0.5, x - z)) AS f FROM p) SELECT id, {r6('x+(y+f*0.1)*0.1')} AS x, {r6('y+f*0.1')} AS v, {r6('f')} AS f FROM f",
)
def x6(spark, d):
    x, v, f = S.integrate(F.col("x"), F.col("y"), F.col("x"), F.col("z"), 0.1, 5.0)
    return rounded(points3(spark, d).select("id", x.alias("x"), v.alias("v"), f.alias("f")), "x", "v", "f")


_OFF = [(0, 0, 4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]
_HAP = ("p00", "p01", "p10", "p11")


@query(
    "x8_wright_fisher",
    f"""WITH {GRID}, h AS (SELECT y, x, (1+v)/(10+v) AS p00, 3/(10+v) AS p01, 2/(10+v) AS p10, 4/(10+v) AS p11 FROM grid), o(dx, dy, w) AS (VALUES {', '.join(str(o) for o in _OFF)}),
    m AS (SELECT g.y, g.x, {', '.join(f'sum(w*s.{c})/sum(w) AS {c}' for c in _HAP)} FROM h g CROSS JOIN o JOIN h s ON g.y = s.y+o.dy AND g.x = s.x+o.dx GROUP BY 1, 2),
    f AS (SELECT y, x, p00/t AS p00, p01/t AS p01, p10*1.1/t AS p10, p11*1.1/t AS p11 FROM (SELECT *, p00+p01+1.1*p10+1.1*p11 AS t FROM m)),
    r AS (SELECT y, x, p00-d AS p00, p01+d AS p01, p10+d AS p10, p11-d AS p11 FROM (SELECT *, 0.2*(p00*p11-p01*p10) AS d FROM f))
    SELECT y, x, {', '.join(f'{r6(c)} AS {c}' for c in _HAP)}, {r6('(p11-(p10+p11)*(p01+p11))/sqrt((p10+p11)*(1-p10-p11)*(p01+p11)*(1-p01-p11))')} AS ld FROM r""",
)
def x8(spark, d):
    v = F.col("v")
    h = grid_q(spark, d, 24, 20).select("y", "x", *[(n / (10 + v)).alias(c) for c, n in zip(_HAP, (1 + v, F.lit(3), F.lit(2), F.lit(4)), strict=True)])
    return rounded(S.wright_fisher_step(h, _OFF, 0.1, 0.2), *_HAP, "ld")


# --- geometry, evolution, colour, graph -------------------------------------------------------------------------


@query(
    "c4_solids",
    f"""WITH {_P3}, s AS (SELECT id, sqrt(x*x+y*y+z*z)-12 AS a, sqrt(greatest(abs(x)-8,0)**2+greatest(abs(y)-9,0)**2+greatest(abs(z)-7,0)**2)+least(greatest(abs(x)-8,abs(y)-9,abs(z)-7),0) AS b FROM p),
    h AS (SELECT *, greatest(0, least(1, 0.5+0.5*(b-a)/3.0)) AS h FROM s)
    SELECT id, {r6('least(a, b)')} AS u, {r6('greatest(a, b)')} AS i, {r6('greatest(a, -b)')} AS d, {r6('b+(a-b)*h-3.0*h*(1-h)')} AS s FROM h""",
)
def c4(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    a, b = X.sphere(x, y, z, 12.0), X.box(x, y, z, (8.0, 9.0, 7.0))
    parts = {"u": X.union(a, b), "i": X.intersect(a, b), "d": X.subtract(a, b), "s": X.smooth_union(a, b, 3.0)}
    return rounded(points3(spark, d).select("id", *[v.alias(k) for k, v in parts.items()]), *parts)


@query("c6_expression_tree", f"WITH {_P3} SELECT id, {r6('sqrt(abs(x*y))+least(z, 2)*sin(x)')} AS v FROM p")
def c6(spark, d):
    tree = ["add", ["sqrt", ["abs", ["mul", "x", "y"]]], ["mul", ["min", "z", 2], ["sin", "x"]]]
    return rounded(points3(spark, d).select("id", X.lower(tree, {c: F.col(c) for c in "xyz"}).alias("v")), "v")


_DRAW = lambda seed, n: f"('0x'||substr(md5('{seed}-'||p_partkey||'-{n}'),1,8))::BIGINT/4294967296.0"
_NORMAL = lambda seed, n: f"sqrt(-2*ln(greatest({_DRAW(seed, n)}, 1e-12)))*cos(2*pi()*{_DRAW(seed, n + 1)})"
_UNIT = lambda x: f"least(1, greatest(0, {x}))"


def _draw(seed, n):
    return uniform(F.lit(seed), F.col("p_partkey"), F.lit(n))


@query(
    "e1_mutate",
    f"""WITH t AS (SELECT p_partkey AS k, (p_size/50.0)::DOUBLE AS a, ((p_partkey % 10)/10.0)::DOUBLE AS b, {_NORMAL(2, 0)} AS u, {_NORMAL(2, 2)} AS w, {_DRAW(2, 6)} AS f FROM part)
    SELECT k, {r6('5+10*' + _UNIT('a+0.2*u'))} AS a, {r6(_UNIT('b+0.2*w'))} AS b, {r6('a')} AS locked, CASE WHEN f < 0.2 THEN NOT (k % 2 = 0) ELSE k % 2 = 0 END AS enabled FROM t""",
)
def e1(spark, d):
    k = F.col("p_partkey")
    pos = F.array(F.col("p_size") / 50.0, (k % 10) / 10.0, F.col("p_size") / 50.0)
    noise = F.array(*[X.gaussian(_draw(2, n), _draw(2, n + 1)) for n in (0, 2, 4)])
    new = X.decode(X.mutate(pos, 0.2, noise, [False, False, True]), [5.0, 0.0, 0.0], [15.0, 1.0, 1.0])
    on = X.flip(F.array(k % 2 == 0), 0.2, F.array(_draw(2, 6)))
    got = table(spark, d, "part").select(k.alias("k"), new[0].alias("a"), new[1].alias("b"), new[2].alias("locked"), on[0].alias("enabled"))
    return rounded(got, "a", "b", "locked")


@query(
    "e1_marry",
    f"""WITH t AS (SELECT p_partkey AS k, (p_size/50.0)::DOUBLE AS a, ((p_partkey % 10)/10.0)::DOUBLE AS b, {_DRAW(3, 0)} AS t, {_DRAW(3, 1)} AS u FROM part)
    SELECT k, {r6('a*(1-t)+b*t')} AS position, {r6('0.1*(1-t)-0.3*t')} AS velocity, CASE WHEN u < 0.5 THEN k % 2 = 0 ELSE k % 3 = 0 END AS enabled FROM t""",
)
def e1m(spark, d):
    k = F.col("p_partkey")
    weight = F.array(_draw(3, 0))
    position = X.marry(F.array(F.col("p_size") / 50.0), F.array((k % 10) / 10.0), weight)
    velocity = X.marry(F.array(F.lit(0.1)), F.array(F.lit(-0.3)), weight)
    on = X.inherit(F.array(k % 2 == 0), F.array(k % 3 == 0), F.array(_draw(3, 1)))
    got = table(spark, d, "part").select(k.alias("k"), position[0].alias("position"), velocity[0].alias("velocity"), on[0].alias("enabled"))
    return rounded(got, "position", "velocity")


@query(
    "e1_advance",
    f"""WITH t AS (SELECT p_partkey AS k, (p_size/50.0)::DOUBLE AS p, ((p_partkey % 21)/10.0 - 1 + 0.5*(0.25-p_size/50.0))::DOUBLE AS v FROM part)
    SELECT k, {r6('least(1, greatest(0, CASE WHEN p+0.5*v < 0 THEN -(p+0.5*v) WHEN p+0.5*v > 1 THEN 2-(p+0.5*v) ELSE p+0.5*v END))')} AS position,
      {r6('CASE WHEN p+0.5*v < 0 OR p+0.5*v > 1 THEN -0.9*v ELSE 0.9*v END')} AS velocity FROM t""",
)
def e1a(spark, d):
    """Steered toward a quarter, then a step with bouncing and damping."""
    k = F.col("p_partkey")
    pos, vel = F.array(F.col("p_size") / 50.0), F.array((k % 21) / 10.0 - 1)
    position, velocity = X.advance(pos, X.steer(vel, X.toward(pos, F.array(F.lit(0.25))), 0.5), 0.5, 0.9)
    return rounded(table(spark, d, "part").select(k.alias("k"), position[0].alias("position"), velocity[0].alias("velocity")), "position", "velocity")


@query(
    "e3_ancestry",
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 3 AS a, p_partkey // 5 AS b FROM part), e AS (SELECT id, a AS parent FROM p WHERE a > 0 UNION SELECT id, b FROM p WHERE b > 0),
    r AS (SELECT 199::BIGINT AS id, 0 AS depth UNION SELECT parent, depth + 1 FROM r JOIN e USING (id)) SELECT id, min(depth)::INT AS depth FROM r GROUP BY 1""",
)
def e3(spark, d):
    k = F.col("p_partkey")
    parents = F.array_distinct(F.filter(F.array(F.floor(k / 3), F.floor(k / 5)), lambda x: x > 0))
    return B.ancestry(table(spark, d, "part").select(k.alias("id"), parents.alias("parents")), 199)


@query(
    "e4_mulberry32",
    "WITH a AS (SELECT id, (id+1831565813)&4294967295 AS a FROM range(1000) r(id)), b AS (SELECT id, (((xor(a,a>>15))*((a|1)&65535)+((((xor(a,a>>15))*((a|1)>>16))&65535)<<16))&4294967295) AS t FROM a), c AS (SELECT id, xor(t,((t+(((xor(t,t>>7))*((t|61)&65535)+((((xor(t,t>>7))*((t|61)>>16))&65535)<<16))&4294967295))&4294967295)) AS t FROM b) SELECT id, round(xor(t, t>>14)/4294967296.0, 9)+0.0 AS u FROM c",
)
def e4(spark, d):
    return rounded(spark.range(1000).select("id", X.mulberry32(F.col("id")).alias("u")), "u", digits=9)


_LIN = lambda c: f"(CASE WHEN {c} <= 0.04045 THEN {c}/12.92 ELSE pow(({c}+0.055)/1.055, 2.4) END)"
_ROW = lambda m, v: "(" + "+".join(f"({w})*{c}" for w, c in zip(m, v, strict=True)) + ")"


@query(
    "v1_oklch",
    f"""WITH c AS (SELECT p_partkey AS k, (p_partkey % 17)/16.0 AS r, (p_partkey % 13)/12.0 AS g, (p_partkey % 11)/10.0 AS b FROM part),
    l AS (SELECT k, {', '.join(f'{_LIN(c)} AS {c}' for c in 'rgb')} FROM c),
    m AS (SELECT k, {', '.join(f"cbrt({_ROW(row, 'rgb')}) AS {n}" for n, row in zip(('lc', 'mc', 'sc'), X.TO_CONES, strict=True))} FROM l),
    o AS (SELECT k, {', '.join(f"{_ROW(row, ('lc', 'mc', 'sc'))} AS {n}" for n, row in zip(('li', 'a', 'bb'), X.TO_LAB, strict=True))} FROM m)
    SELECT k, {r6('li', 5)} AS lightness, {r6('sqrt(a*a+bb*bb)', 5)} AS chroma, CASE WHEN sqrt(a*a+bb*bb) > 0.001 THEN round(atan2(bb, a), 3)+0.0 END AS hue FROM o""",
)
def v1(spark, d):
    k = F.col("p_partkey")
    li, chroma, hue = X.oklab_to_oklch(X.srgb_to_oklab(*[(k % n) / float(n - 1) for n in (17, 13, 11)]))
    got = table(spark, d, "part").select(k.alias("k"), li.alias("lightness"), chroma.alias("chroma"), F.when(chroma > 0.001, hue).alias("hue"))
    return rounded(rounded(got, "lightness", "chroma", digits=5), "hue", digits=3)


@query("b2_graph", f"WITH {GRID}, t AS (SELECT y, x, CASE WHEN v >= 2 THEN 1.0 ELSE 0.0 END AS v FROM grid) SELECT y, x, grid.v+2*t.v+0.0 AS v FROM grid JOIN t USING (y, x)")
def b2(spark, d):
    from pointloom.plans.graph import Graph

    g = Graph()
    field = g.source("field", grid_q(spark, d, 24, 20))
    hot = g.op("threshold", field, at=2.0)
    g.op("addGrids", field, hot, name="sum", wb=2.0)
    return Graph.from_json(g.to_json(), {"field": g.sources["field"]}).pull("sum")


@query("b2_feedback")
def b2f(spark, d):
    from pointloom.plans.graph import Graph

    g = Graph()
    g.source("seed", grid_q(spark, d, 24, 20))
    g.delay("last", "seed")
    g.close("last", g.op("gaussian", "last"))
    g.advance(2)
    return rounded(g.pull("last"), "v")


@query("s13_cells_by_type", "SELECT label::INT AS type_id, count(*) AS n FROM embeddings GROUP BY 1")
def c1(spark, d):
    return cells_emb(spark, d).groupBy("type_id").agg(F.count("*").alias("n"))
