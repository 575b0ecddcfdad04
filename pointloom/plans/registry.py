"""Where the registered queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The cell views in SQL.
CELLS = (
    "cells AS (SELECT vec_id AS cell_id, 1000 * embedding[1]::DOUBLE AS x, 1000 * embedding[2]::DOUBLE AS y, "
    "label::INT AS type_id FROM embeddings)"
)
ORDERS = (
    "ord AS (SELECT o_orderkey AS cell_id, o_totalprice / 100 AS x, "
    "datediff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS y, o_orderstatus AS type_id, "
    "o_orderpriority AS region FROM orders)"
)
#: The 24 x 20 grid of quadrat counts in SQL.
GRID = (
    CELLS + ", axis AS (SELECT y::INT AS y, x::INT AS x FROM range(20) a(y), range(24) b(x)), "
    "occ AS (SELECT least(greatest(floor((y + 450) * 20 / 900), 0), 19)::INT AS y, "
    "least(greatest(floor((x + 450) * 24 / 900), 0), 23)::INT AS x, type_id FROM cells), "
    "grid AS (SELECT a.y, a.x, count(o.x)::DOUBLE AS v FROM axis a LEFT JOIN occ o ON a.y = o.y AND a.x = o.x GROUP BY ALL)"
)


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero; NaN as null."""
    for c in columns:
        r = F.round(F.col(c), digits) + F.lit(0.0)
        df = df.withColumn(c, F.when(~F.isnan(F.col(c)), r))
    return df


def r6(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expr}, {digits}) + 0.0)"


def cast_long(*columns: Column) -> list[Column]:
    return [c.cast("long") for c in columns]
