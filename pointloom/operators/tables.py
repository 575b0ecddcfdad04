"""Cell tables and sparse matrices: schema guesses, grouping, columns, statistics, gene selection, compressed layouts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.lineage import cut
from pointloom.operators.manifold import pca
from pointloom.operators.order import running


def read_csv(spark, path: str) -> DataFrame:
    """Quoted CSV with a header, line breaks within quotes; all columns text."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def inspect_csv(rows: DataFrame, order: str, sample: int = 2000) -> DataFrame:
    """column, numeric (share of values that are numbers), distinct in the first rows by ``order``: the feature looks at
    so many rows only."""
    part = rows.orderBy(order).limit(sample).drop(order)
    rows = rows.drop(order)
    each = []
    for c in rows.columns:
        v = F.col(f"`{c}`").cast("string")
        each += [F.avg(v.try_cast("double").isNotNull().cast("double")).alias(f"n_{c}"), F.count_distinct(v).alias(f"d_{c}")]
    s = part.agg(*each)
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`n_{c}`").alias("numeric"), F.col(f"`d_{c}`").alias("distinct")) for c in rows.columns])))


def group_cells(rows: DataFrame, x: str, y: str, kind: str, order: str) -> DataFrame:
    """type_id, n, first, skipped: rows by type in order of first appearance; bad coordinates and blank types skip."""
    bad = F.col(x).cast("string").try_cast("double").isNull() | F.col(y).cast("string").try_cast("double").isNull() | (F.trim(F.coalesce(F.col(kind).cast("string"), F.lit(""))) == "")
    flagged = rows.withColumn("bad", bad)
    skipped = F.broadcast(flagged.agg(F.count_if("bad").alias("skipped")).withColumn("one", F.lit(1)))
    good = flagged.where(~F.col("bad")).groupBy(F.trim(F.col(kind).cast("string")).alias("type_id")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return good.withColumn("one", F.lit(1)).join(skipped, "one").drop("one")


def region_cells(cells: DataFrame, types: Sequence[str], *, fold_case: bool = False) -> DataFrame:
    """Cells of the wanted types with the types' numbers in the given order; other types and empty regions drop out."""
    key = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    wanted = cells.sparkSession.createDataFrame([(t, k) for k, t in enumerate(types)], "name string, number int")
    wanted = wanted.select(key(F.col("name")).alias("key"), "number")
    named = cells.withColumn("key", key(F.col("type_id").cast("string")))
    return named.join(F.broadcast(wanted), "key").drop("key", "type_id").withColumnRenamed("number", "type_id")


def sparse_columns(coo: DataFrame, cells: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """cell, slot, v: wanted variables for each cell, zeros included; a variable may be wanted twice or not exist."""
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(w).alias("var")) for k, w in enumerate(wanted)])
    axis = cells.select("cell", F.inline(slots))
    return axis.join(coo, ["cell", "var"], "left").select("cell", "slot", F.coalesce("v", F.lit(0.0)).alias("v"))


def sparse_column_cost(wanted: int, n_vars: int, layout: str) -> float:
    """Share of a matrix that reading some columns touches."""
    return min(1.0, wanted / n_vars) if layout == "csc" and n_vars else 1.0


def variable_stats(coo: DataFrame) -> DataFrame:
    """var, total, max, non_zero; the maximum begins at 0."""
    return coo.groupBy("var").agg(F.sum("v").alias("total"), F.greatest(F.max("v"), F.lit(0.0)).alias("max"), F.count_if(F.col("v") != 0).alias("non_zero"))


def variable_genes(features: DataFrame, top: int, *, log: bool = True) -> DataFrame:
    """col, variance of the most variable columns (variance above 0), in column order."""
    v = F.log1p(F.greatest(F.col("v"), F.lit(0.0))) if log else F.col("v")
    s = features.select(F.posexplode("features").alias("col", "v")).groupBy("col").agg(F.var_samp(v).alias("variance"))
    ranked = s.where("variance > 0").withColumn("k", F.row_number().over(Window.orderBy(F.desc("variance"), "col")))
    return ranked.where(F.col("k") <= top).select("col", "variance")


def bottom_k(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """The k rows with the smallest keys (hexadecimal digests), exactly and without a sort of all rows.

    Rows are counted by the first four digits of their keys, at most 65,536 counts; whole groups below the one in which
    the k-th row falls are taken as they are, and only that group is ordered.
    """
    named = rows.withColumns({"_key": key, "_head": F.substring(key, 1, 4)})
    left, edge = k, None
    for head, n in sorted(named.groupBy("_head").count().toLocalIterator()):
        if n > left:
            edge = head
            break
        left -= n
    if edge is None:
        return rows
    inside = named.where(F.col("_head") < edge)
    return inside.unionByName(named.where(F.col("_head") == edge).orderBy("_key").limit(left)).select(*rows.columns)


def store_dataset(features: DataFrame, *, genes: int, rows: int, components: int, seed: int = 1, log: bool = True) -> tuple[DataFrame, list[int]]:
    """(row, scores) and the columns used: the way of a stored matrix to principal components.

    Values are log1p of what is above 0, if ``log``; the ``genes`` most variable columns are chosen over all rows, then a
    keyed subsample of ``rows`` rows is taken exactly, and the scores are those of the subsample. Raises where fewer than
    two columns vary.
    """
    cols = sorted(r.col for r in variable_genes(features, genes, log=log).collect())
    if len(cols) < 2:
        raise ValueError("fewer than two columns vary")
    v = F.array(*[F.col("features")[c] for c in cols])
    v = F.transform(v, lambda x: F.log1p(F.greatest(x, F.lit(0.0)))) if log else v
    sample = bottom_k(features.select("row", v.alias("features")), F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("row").cast("string")).cast("binary")), rows)
    scores, _, _ = pca(sample, min(components, len(cols)))
    return scores, cols


def observation_labels(rows: DataFrame, label: str, most: int = 64) -> DataFrame:
    """Adds ``code``: the label's place among the distinct ones; missing ones are ``(unassigned)``. Raises beyond ``most``."""
    named = rows.withColumn("label", F.coalesce(F.col(label).cast("string"), F.lit("(unassigned)")))
    names = named.select("label").distinct()
    if names.count() > most:
        raise ValueError(f"more than {most} labels")
    codes = names.withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)
    return named.join(F.broadcast(codes), "label")


def compressed_rows(edges: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """row, start (entries of rows before it), indices and data, sorted by column."""
    g = edges.groupBy(F.col(row).alias("row")).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("j"), F.col(value).alias("v")))).alias("e"))
    start = running(g.select("row", F.size("e").cast("long").alias("n")), ["row"], F.col("n"), name="start").select("row", "start")
    return g.join(start, "row").select("row", "start", F.transform("e", lambda x: x["j"]).alias("indices"), F.transform("e", lambda x: x["v"]).alias("data"))


def clean_keys(names: DataFrame, column: str) -> DataFrame:
    """Adds ``key``: the name with other characters as ``_``; further names with the same key get ``__2``, ``__3``."""
    base = F.regexp_replace(F.col(column), r"[^A-Za-z0-9_.-]", "_")
    k = F.row_number().over(Window.partitionBy("base").orderBy(column))
    return names.withColumn("base", base).withColumn("k", k).select(*names.columns, F.when(F.col("k") > 1, F.concat("base", F.lit("__"), F.col("k").cast("string"))).otherwise(F.col("base")).alias("key"))


def write_matrix(df: DataFrame, path: str, *, rows: int | None = None, force: bool = False) -> None:
    """Writes Parquet; refuses another number of rows than expected, and an existing place unless forced."""
    if rows is not None and df.count() != rows:
        raise ValueError("the number of rows differs")
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_pairs(edges: DataFrame, path: str, rows: int, *, row: str = "i", col: str = "j", force: bool = False) -> None:
    """Writes a sparse square matrix of the observations; refuses indices outside 0 to ``rows`` - 1."""
    wrong = edges.where(~F.col(row).between(0, rows - 1) | ~F.col(col).between(0, rows - 1) | F.col(row).isNull() | F.col(col).isNull())
    if not wrong.isEmpty():
        raise ValueError(f"the matrix is not {rows} by {rows}")
    edges.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_neighbors(distances: DataFrame, weights: DataFrame, path: str, rows: int, params: dict, *, force: bool = False) -> None:
    """Writes distances, connectivities and one row of parameters (as JSON) under ``path``."""
    write_pairs(distances, f"{path}/distances", rows, force=force)
    write_pairs(weights, f"{path}/connectivities", rows, row="head", col="tail", force=force)
    text = json.dumps({"connectivities_key": "connectivities", "distances_key": "distances", "params": params}, sort_keys=True)
    one = distances.sparkSession.createDataFrame([(text,)], "params string")
    one.write.mode("overwrite" if force else "errorifexists").parquet(f"{path}/params")


# --- multiscale pyramids ----------------------------------------------------------------------------------------


def pyramid_levels(spark, size: tuple[int, int], chunk: tuple[int, int], levels: int, bytes_each: int = 4) -> DataFrame:
    """level, width, height, chunks_x, chunks_y, chunk_bytes of a pyramid that halves (rounding up)."""
    half = lambda n: F.greatest(F.ceil(F.lit(float(n)) / F.pow(F.lit(2.0), F.col("level"))), F.lit(1)).cast("long")
    df = spark.range(levels).select(F.col("id").cast("int").alias("level")).withColumns({"width": half(size[0]), "height": half(size[1])})
    return df.withColumns(
        {
            "chunks_x": F.ceil(F.col("width") / chunk[0]).cast("long"),
            "chunks_y": F.ceil(F.col("height") / chunk[1]).cast("long"),
            "chunk_bytes": F.lit(chunk[0] * chunk[1] * bytes_each).cast("long"),
        }
    )


def chunk_boxes(levels: DataFrame, chunk: tuple[int, int]) -> DataFrame:
    """level, cx, cy and the box of each chunk in pixels of level 0, clipped to the level."""
    c = levels.withColumn("cx", F.explode(F.expr("sequence(0L, chunks_x - 1)"))).withColumn("cy", F.explode(F.expr("sequence(0L, chunks_y - 1)")))
    scale = F.pow(F.lit(2.0), F.col("level"))
    edge = lambda k, n, s: F.least(k * s, F.col(n)) * scale
    return c.select(
        "level", "cx", "cy",
        edge(F.col("cx"), "width", chunk[0]).alias("x0"), edge(F.col("cy"), "height", chunk[1]).alias("y0"),
        edge(F.col("cx") + 1, "width", chunk[0]).alias("x1"), edge(F.col("cy") + 1, "height", chunk[1]).alias("y1"),
    )


def wanted_level(world_per_pixel: Column, quality: float, voxel: float, lowest: int, highest: int) -> Column:
    return F.greatest(F.lit(lowest), F.least(F.lit(highest), F.floor(F.log2(world_per_pixel / quality / voxel)))).cast("int")


def select_chunks(boxes: DataFrame, view: tuple[float, float, float, float], level: int) -> DataFrame:
    """Chunks of a level that meet the view."""
    x0, y0, x1, y1 = view
    return boxes.where((F.col("level") == level) & (F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0))


def level_within_budget(boxes: DataFrame, view: tuple[float, float, float, float], chunk_bytes: int, budget: int) -> DataFrame:
    """level, chunks, bytes of the finest level whose chunks in the view fit the budget; none if no level does."""
    x0, y0, x1, y1 = view
    seen = boxes.where((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0)).groupBy("level").agg(F.count("*").alias("chunks"))
    fit = seen.withColumn("bytes", F.col("chunks") * chunk_bytes).where(F.col("bytes") <= budget)
    return fit.orderBy("level").limit(1)


def frustum_visible(boxes: DataFrame, planes: Sequence[tuple[float, float, float, float]], low: Sequence[str], high: Sequence[str]) -> Column:
    """True unless a box lies wholly outside one plane (inside: n·p + d >= 0)."""
    keep = F.lit(True)
    for *n, d in planes:
        far = sum((F.lit(c) * (F.col(high[k]) if c >= 0 else F.col(low[k])) for k, c in enumerate(n)), F.lit(d))
        keep &= far >= 0
    return keep


EMPTY_PEDIGREE = T.StructType([T.StructField("id", T.LongType()), T.StructField("parents", T.ArrayType(T.LongType()))])


def ancestry(pedigree: DataFrame, of: int) -> DataFrame:
    """id, depth of all ancestors (fewest generations): one join a generation, as many as the pedigree is deep."""
    edges = pedigree.select("id", F.explode("parents").alias("parent"))
    front = pedigree.where(F.col("id") == of).select("id", F.lit(0).alias("depth"))
    seen, depth = front, 0
    while True:
        depth += 1
        front = front.join(edges, "id").select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        front = cut(front)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
