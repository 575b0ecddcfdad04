"""Views of the star-schema tables as the shapes the operators take: cells, grids, features, sparse matrices, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed analysis windows (min x, min y, max x, max y) of the two cell views.
WINDOW_EMB = (-450.0, -450.0, 450.0, 450.0)
WINDOW_ORD = (0.0, 1000.0, 5000.0, 3600.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, x, y, type_id: the first two coordinates of each embedding, its label as the type."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: 1000 * F.col("embedding")[k].cast("double")
    return e.select(F.col("vec_id").alias("cell_id"), at(0).alias("x"), at(1).alias("y"), F.col("label").cast("int").alias("type_id"))


def cells_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, x, y, type_id, region: price and day of each order, status as the type, priority as the region."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("cell_id"),
        (F.col("o_totalprice") / 100).alias("x"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("y"),
        F.col("o_orderstatus").alias("type_id"),
        F.col("o_orderpriority").alias("region"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, features (array of doubles)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("features"))


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, var, v: summed event values of each user and event type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("var")).agg(F.round(F.sum("value"), 2).alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, tick, v: events of each user in order of time, ticks from 0."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    tick = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", tick.alias("tick"), F.col("value").alias("v"))


def points3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z: the first three embedding coordinates."""
    e = table(spark, sf_dir, "embeddings")
    at = [(100 * F.col("embedding")[k].cast("double")).alias(n) for k, n in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("id"), *at)


def dense_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All (y, x) of a grid, row-major."""
    return spark.range(width * height).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def grid_q(spark: SparkSession, sf_dir: str, width: int = 24, height: int = 20, parity: int | None = None) -> DataFrame:
    """y, x, v: cells of the embedding view counted in a dense grid over the fixed window."""
    x0, y0, x1, y1 = WINDOW_EMB
    cells = cells_emb(spark, sf_dir)
    if parity is not None:
        cells = cells.where(F.col("type_id") % 2 == parity)
    clip = lambda c, lo, hi, n: F.least(F.greatest(F.floor((F.col(c) - lo) * n / (hi - lo)), F.lit(0)), F.lit(n - 1)).cast("int")
    counts = cells.groupBy(clip("y", y0, y1, height).alias("y"), clip("x", x0, x1, width).alias("x")).agg(F.count("*").alias("n"))
    return dense_grid(spark, width, height).join(counts, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
