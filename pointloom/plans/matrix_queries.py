"""Queries over feature matrices, fuzzy graphs and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import descent as D
from pointloom.operators import forest as O
from pointloom.operators import layout as L
from pointloom.operators import manifold as M
from pointloom.operators import topology as T
from pointloom.operators.lineage import stored
from pointloom.plans.point_queries import PAIRS
from pointloom.plans.registry import CELLS, query, r6, rounded
from pointloom.sources.tables import cells_emb, features, grid_q

LONG = "f AS (SELECT vec_id AS row, k::INT AS col, embedding[k+1]::DOUBLE AS v FROM embeddings, range(64) r(k))"
NEAR = (
    "e AS (SELECT vec_id AS row, embedding::DOUBLE[] AS v FROM embeddings), "
    "dd AS (SELECT a.row AS i, b.row AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.row <> b.row), "
    "nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM dd)"
)


@query(
    "m1_column_stats",
    f"WITH {LONG} SELECT col, {r6('avg(v)')} AS mean, {r6('CASE WHEN stddev_samp(v) > 1e-12 THEN 1/stddev_samp(v) ELSE 1 END')} AS scale FROM f GROUP BY 1",
)
def m1(spark, d):
    return rounded(M.column_stats(features(spark, d)), "mean", "scale")


@query("m2_covariance", f"WITH {LONG} SELECT a.col AS p, b.col AS q, {r6('covar_samp(a.v, b.v)')} AS v FROM f a JOIN f b USING (row) GROUP BY 1, 2")
def m2(spark, d):
    cov, _, _ = M.covariance(features(spark, d))
    rows = [(p, q, float(cov[p, q])) for p in range(len(cov)) for q in range(len(cov))]
    return rounded(spark.createDataFrame(rows, "p int, q int, v double"), "v")


@query("m3_eigenvalues")
def m3(spark, d):
    values, _ = M.eigen(M.covariance(features(spark, d))[0])
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, value double"), "value")


@query("m4_pca_scores")
def m4(spark, d):
    scores, _, _ = M.pca(features(spark, d), 5)
    return rounded(scores.select("row", *[F.col("scores")[k].alias(f"s{k}") for k in range(5)]), *[f"s{k}" for k in range(5)], digits=5)


@query("m5_knn", f"WITH {NEAR} SELECT i, rank::INT AS rank, j, {r6('dist', 5)} AS dist FROM nn WHERE rank <= 10")
def m5(spark, d):
    return rounded(M.knn(features(spark, d), 10), "dist", digits=5)


@query("m6_knn_approximate")
def m6(spark, d):
    return rounded(D.descent(features(spark, d), 10)[0], "dist", digits=5)


@query("m7_recall")
def m7(spark, d):
    """Recall of the descent, and the distances that it and the exact search take."""
    f = features(spark, d)
    found, taken = D.descent(f, 10)
    n = F.count("*").alias("n")
    exact = f.agg(n).select((F.col("n") * (F.col("n") - 1)).alias("exact_distances"))
    return rounded(M.recall(found, M.knn(f, 10)).join(exact, F.lit(True)).withColumn("distances", F.lit(taken)), "recall")


@query(
    "m8_smooth_knn",
    f"""WITH RECURSIVE {NEAR}, k AS (SELECT i, list(dist ORDER BY rank) AS d FROM nn WHERE rank <= 14 GROUP BY 1),
    r AS (SELECT i, d, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0) AS rho FROM k),
    b AS (SELECT i, d, rho, 0 AS n, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS mid, false AS done FROM r UNION ALL
      SELECT i, d, rho, n + 1, CASE WHEN ok OR p > t THEN lo ELSE mid END, CASE WHEN NOT ok AND p > t THEN mid ELSE hi END,
        CASE WHEN ok THEN mid WHEN p > t THEN (lo + mid) / 2 WHEN hi = 'inf' THEN mid * 2 ELSE (mid + hi) / 2 END, ok
      FROM (SELECT *, log2(15) AS t, done OR abs(p - log2(15)) < 1e-5 AS ok FROM (SELECT *, list_sum(list_transform(d, lambda x: CASE WHEN x > rho THEN exp(-(x - rho) / mid) ELSE 1 END)) AS p FROM b WHERE n < 64)))
    SELECT i, {r6('rho', 5)} AS rho, {r6('mid', 4)} AS sigma FROM b WHERE n = 64""",
)
def m8(spark, d):
    return rounded(rounded(M.smooth_knn(M.knn(features(spark, d), 14), 14), "rho", digits=5), "sigma", digits=4)


@query("m9_fuzzy_graph")
def m9(spark, d):
    near = M.knn(features(spark, d), 14)
    return rounded(M.fuzzy_graph(near, M.smooth_knn(near, 14)), "weight", digits=4)


@query("m11_layout")
def m11(spark, d):
    """The plane layout of the features' fuzzy graph: 200 epochs from drawn places."""
    near = stored(M.knn(features(spark, d), 14))
    return rounded(L.layout(stored(M.fuzzy_graph(near, M.smooth_knn(near, 14)))), "x", "y", digits=3)


@query("m12_umap")
def m12(spark, d):
    """How trustworthy the whole way from the features to the plane is, and what it gives: one row a row of features."""
    f = features(spark, d)
    at = L.umap(f)
    trust = M.trustworthiness(f, at.select("row", F.array("x", "y").alias("features")), 10)
    return rounded(rounded(at.join(F.broadcast(trust), F.lit(True)), "x", "y", digits=3), "trust", digits=4)


@query("m10_fit_ab")
def m10(spark, d):
    return rounded(spark.createDataFrame([M.fit_ab()], "a double, b double"), "a", "b", digits=3)


@query("m13_column_subset", "SELECT vec_id AS row, round(embedding[8]::DOUBLE, 6)+0.0 AS c7, round(embedding[3]::DOUBLE, 6)+0.0 AS c2 FROM embeddings WHERE vec_id % 3 = 0")
def m13(spark, d):
    f = features(spark, d).where("row % 3 = 0")
    return rounded(f.select("row", *[F.col("features")[k].alias(f"c{k}") for k in (7, 2)]), "c7", "c2")


@query(
    "m14_trustworthiness",
    f"""WITH {NEAR}, lo AS (SELECT a.row AS i, b.row AS j, row_number() OVER (PARTITION BY a.row ORDER BY list_distance(a.v[1:8], b.v[1:8]), b.row) AS k FROM e a JOIN e b ON a.row <> b.row)
    SELECT round(1 - 2.0/(n*10*(2*n-30-1)) * s, 6) + 0.0 AS trust FROM (SELECT (SELECT count(*) FROM e) AS n, sum(greatest(nn.rank - 10, 0)) AS s FROM lo JOIN nn USING (i, j) WHERE k <= 10)""",
)
def m14(spark, d):
    f = features(spark, d)
    return rounded(M.trustworthiness(f, f.select("row", F.slice("features", 1, 8).alias("features")), 10), "trust")


@query("t1_fuzzy_adjacency", f"WITH {PAIRS} SELECT i, j, {r6('exp(-d2/200.0)')} AS mu FROM pairs WHERE d2 <= 900.0")
def t1(spark, d):
    return rounded(T.fuzzy_adjacency(cells_emb(spark, d), 10.0), "mu")


#: Pairs of neighbouring buckets of 100, and the distances of the fifth neighbours.
_CLOSE = (
    CELLS + ", c AS MATERIALIZED (SELECT cell_id, x, y, floor(x/100)::INT AS gx, floor(y/100)::INT AS gy FROM cells), "
    "close AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d2 FROM "
    "(SELECT c.*, gx + u AS kx, gy + v AS ky FROM c, range(-1, 2) s(u), range(-1, 2) t(v)) a JOIN c b ON a.kx = b.gx AND a.ky = b.gy WHERE a.cell_id <> b.cell_id), "
    "rho AS MATERIALIZED (SELECT i AS c, sqrt(d2) AS rho FROM (SELECT i, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM "
    "(SELECT a.cell_id AS i, b.cell_id AS j, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d2 FROM c a JOIN c b ON a.cell_id <> b.cell_id)) WHERE k = 5)"
)


@query(
    "t2_adaptive_adjacency",
    f"""WITH {_CLOSE}, w AS (SELECT i, j, exp(-d2/(2*1.5*1.5*a.rho*a.rho)) AS p, exp(-d2/(2*1.5*1.5*b.rho*b.rho)) AS q FROM close JOIN rho a ON a.c = i JOIN rho b ON b.c = j WHERE d2 < 900.0)
    SELECT i, j, {r6('p+q-p*q')} AS mu FROM w""",
)
def t2(spark, d):
    return rounded(T.adaptive_adjacency(cells_emb(spark, d), 5, 30.0, scale=1.5), "mu")


@query(
    "t3_cknn",
    f"""WITH {_CLOSE}, w AS (SELECT i, j, sqrt(d2)/sqrt(a.rho*b.rho) AS s FROM close JOIN rho a ON a.c = i JOIN rho b ON b.c = j WHERE d2 < 10000.0)
    SELECT i, j, {r6('s')} AS scaled, {r6('exp(-s*s)')} AS weight FROM w WHERE s < 0.8""",
)
def t3(spark, d):
    return rounded(T.cknn(cells_emb(spark, d), 5, 0.8, 100.0), "scaled", "weight")


@query("t4_membership_to_distance", f"WITH {PAIRS} SELECT i, j, {r6('1-exp(-d2/200.0)')} AS dist FROM pairs WHERE d2 <= 900.0")
def t4(spark, d):
    return rounded(T.membership_to_distance(T.fuzzy_adjacency(cells_emb(spark, d), 10.0)).select("i", "j", "dist"), "dist")


@query("t5_rips_persistence")
def t5(spark, d):
    """A row a pair, rounded before pairs of one birth and death are told apart."""
    return T.one_by_one(rounded(T.rips_counts(cells_emb(spark, d), "type_id", 120.0), "birth", "death"))


@query("t6_betti_numbers")
def t6(spark, d):
    return T.rips_betti(cells_emb(spark, d), "type_id", 120.0, 60.0)


#: The forest by definition: an edge is in it unless its ends are connected by edges before it.
_FOREST = (
    CELLS + ", e AS MATERIALIZED (SELECT a.type_id, a.cell_id AS i, b.cell_id AS j, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS d, "
    "row_number() OVER (ORDER BY sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)), a.cell_id, b.cell_id) AS k "
    "FROM cells a JOIN cells b ON a.type_id = b.type_id AND a.cell_id < b.cell_id WHERE (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) <= 14400.0), "
    "u AS MATERIALIZED (SELECT i AS p, j AS q, k FROM e UNION ALL SELECT j, i, k FROM e), "
    "reach AS (SELECT k, i AS node FROM e UNION SELECT r.k, u.q FROM reach r JOIN u ON u.p = r.node AND u.k < r.k), "
    "forest AS (SELECT e.* FROM e ANTI JOIN reach r ON r.k = e.k AND r.node = e.j)"
)


@query("t6_component_deaths", f"WITH RECURSIVE {_FOREST} SELECT type_id, i, j, {r6('d')} AS death FROM forest")
def t6d(spark, d):
    """Where the components of each type's points merge, up to 120: the finite bars of dimension 0."""
    return rounded(O.component_deaths(cells_emb(spark, d), 120.0, keys=("type_id",)), "death")


@query(
    "t6_component_counts",
    f"""WITH RECURSIVE {_FOREST}, n AS (SELECT type_id, count(*) AS points FROM cells GROUP BY 1),
    m AS (SELECT type_id, {r6('d')} AS scale, row_number() OVER (PARTITION BY type_id ORDER BY d, i, j) AS merged FROM forest)
    SELECT type_id, 0.0::DOUBLE AS scale, points AS n FROM n UNION ALL SELECT m.type_id, scale, min(points - merged) FROM m JOIN n USING (type_id) GROUP BY 1, 2""",
)
def t6n(spark, d):
    """How many components each type has at every scale up to 120, all from one forest."""
    cells = cells_emb(spark, d)
    deaths = rounded(O.component_deaths(cells, 120.0, keys=("type_id",)), "death")
    return O.component_counts(cells, deaths, keys=("type_id",))


@query(
    "t6_components_at_scale",
    f"""WITH RECURSIVE {PAIRS}, reach AS (SELECT cell_id AS a, cell_id AS b FROM cells UNION SELECT r.a, p.j FROM reach r JOIN pairs p ON p.i = r.b AND p.ta = p.tb AND p.d2 <= 3600.0)
    SELECT c.type_id, count(DISTINCT m) AS n FROM (SELECT a, min(b) AS m FROM reach GROUP BY 1) JOIN cells c ON c.cell_id = a GROUP BY 1""",
)
def t6c(spark, d):
    """Pieces of each type's points linked within 60: counted from links of buckets, without a complex."""
    return O.pieces_at(cells_emb(spark, d), 60.0, "type_id")


def _fields(spark, d):
    g = grid_q(spark, d, 12, 10, 0).withColumn("field", F.lit(0))
    return g.unionByName(grid_q(spark, d, 12, 10, 1).withColumn("field", F.lit(1)))


@query("t7_cubical_persistence")
def t7(spark, d):
    return T.cubical(_fields(spark, d), "field", superlevel=True)


@query("t8_field_betti")
def t8(spark, d):
    return T.betti(T.cubical(_fields(spark, d), "field"), 1.0, "field")
