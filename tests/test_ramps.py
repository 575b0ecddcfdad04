"""Ramps of parts: one colour a size and hue, whatever the number of parts."""

from pyspark.sql import functions as F

from pointloom.functions import expressions as X
from pointloom.plans.derived_queries import ramp_colours


def test_colours_are_those_of_each_part(spark):
    rows = [(k, None if k == 7 else k % 3 * 20 + 1, None if k == 8 else k % 12) for k in range(30)]
    part = spark.createDataFrame(rows, "k long, size int, hue long")
    got = {(r.k, r.ramp): r.chroma for r in ramp_colours(part).collect()}
    assert len(got) == 60
    li, c, h = X.sequential(F.col("size") / 50.0, X.categorical_hue(F.col("hue"), 12))
    assert all(got[r.k, "sequential"] == r.c for r in part.select("k", X.gamut_chroma(li, c, h).alias("c")).collect())
    plan = ramp_colours(part)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("aggregate(")  # the bisection lies below the join with the parts
