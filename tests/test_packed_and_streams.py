"""Packed tiles, stores and series as streams against what went in."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators.simulate import delayed, one_pole, sample_back
from pointloom.sources.packed import KINDS, Store, lane_of, pack_tiles, tile_field, write_store
from pointloom.sources.tables import series, table
from pointloom.streaming.series import run_to_table, series_stream
from pointloom.streaming.stateful import read_events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["u1", "i4", "f4", "f8"])
def test_packing_and_unpacking_are_inverse(spark, kind):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, (3, 21, 34))
    rows = [(y, x, *map(float, a[:, y, x])) for y in range(21) for x in range(34)]
    df = spark.createDataFrame(rows, "y int, x int, p double, q double, r double")
    tiles = pack_tiles(df, 34, 21, ["p", "q", "r"], tile=8, kind=kind)
    sizes = {(t.ty, t.tx): (t.height, t.width, len(t.data)) for t in tiles.collect()}
    item = np.dtype(KINDS[kind]).itemsize
    assert len(sizes) == 15 and sizes[0, 0] == (8, 8, 192 * item) and sizes[2, 4] == (5, 2, 30 * item)
    for lane in range(3):
        got = tile_field(tiles, lane, tile=8).toPandas().pivot(index="y", columns="x", values="v").to_numpy()
        assert np.array_equal(got, a[lane])


def test_missing_and_null_pixels_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (1, 1, None), (9, 9, 5.0)], "y int, x int, v double")
    got = {(r.y, r.x): r.v for r in tile_field(pack_tiles(df, 2, 2, ["v"], tile=4), 0, tile=4).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}


@pytest.mark.parametrize("change", [{"depth": 2}, {"channel": 3}, {"channel": -1}, {"width": 5}, {"data": b"\0" * 7}])
def test_wrong_tiles_raise(spark, change):
    whole = {"data": np.arange(24, dtype="<f4").tobytes(), "width": 4, "height": 2, "depth": 1, "lanes": 3, "kind": "f4", "channel": 1}
    assert lane_of(**whole).tolist() == [1.0, 4.0, 7.0, 10.0, 13.0, 16.0, 19.0, 22.0]
    with pytest.raises(ValueError):
        lane_of(**whole | change)


def test_a_wrong_tile_stops_the_job(spark):
    tiles = pack_tiles(spark.createDataFrame([(0, 0, 1.0)], "y int, x int, v double"), 1, 1, ["v"]).withColumn("depth", F.lit(2))
    with pytest.raises(Exception, match="no plane"):
        tile_field(tiles, 0).collect()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('store')}/s"
    df = spark.createDataFrame(
        [(k, k * 3, k % 5, float(k) / 7, None if k % 11 == 0 else f"label {k % 4}", f"name {k}") for k in range(1000)],
        "id long, i int, b tinyint, f double, kind string, name string",
    ).withColumn("g", F.col("f").cast("float"))
    write_store({"cells": (df.repartition(7), ["id"]), "few": (df.where("id < 3").select("id", "kind"), ["id"])}, path, chunk_rows=128)
    return path, df.toPandas()


def test_store_reads_back_equal(spark, store):
    path, df = store
    s = Store.open(spark, path)
    assert s.names() == ["cells", "few"] and s.datasource("cells")["rows"] == 1000
    got = s.read("cells", ["g", "id", "i", "b", "f"]).toPandas().sort_values("row").reset_index(drop=True)
    assert got.row.tolist() == list(range(1000))
    for c in ("id", "i", "b", "f", "g"):
        assert np.array_equal(got[c], df[c])
    assert dict(s.read("cells", ["g", "i"]).dtypes) == {"row": "bigint", "g": "float", "i": "int"}
    assert dict(s.read_f64("cells", ["b", "g"]).dtypes) == {"row": "bigint", "b": "double", "g": "double"}
    for c in ("kind", "name"):
        text = s.read_text("cells", c).toPandas().sort_values("row")[c]
        assert [v if isinstance(v, str) else None for v in text] == [v if isinstance(v, str) else None for v in df[c]]
    codes, labels = s.read_categorical("cells", "kind")
    assert labels == ["label 0", "label 1", "label 2", "label 3", None] and codes.agg(F.max("kind")).first()[0] == 4
    assert s.read("few", ["id"]).count() == 3


def test_store_reads_only_what_is_asked_for(spark, store):
    plan = Store.open(spark, store[0]).read("cells", ["f"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "field" in plan.split("PartitionFilters")[1][:80]
    rows = spark.read.parquet(f"{store[0]}/tables/cells").where("field = 'f'")
    names = [r[0] for r in rows.select(F.input_file_name()).collect()]
    assert len(names) == 8 and all("/field=f/" in n for n in names)


def test_store_refuses(spark, store, tmp_path):
    s = Store.open(spark, store[0])
    for bad in (lambda: s.read("none", ["f"]), lambda: s.read("cells", ["none"])):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError, match="no labels"):
        s.read_categorical("cells", "f")
    for k, about in enumerate(({"version": 99, "datasources": []}, {"hello": 1})):
        (tmp_path / str(k) / "about").mkdir(parents=True)
        (tmp_path / str(k) / "about" / "part.txt").write_text(json.dumps(about))
        with pytest.raises(ValueError):
            Store.open(spark, f"file://{tmp_path}/{k}")
    with pytest.raises(ValueError, match="neither"):
        write_store({"x": (spark.range(3).withColumn("a", F.array("id")), ["id"])}, f"file://{tmp_path}/w")


def batch(spark):
    s = series(spark, SF)
    both = delayed(s, 2, -1.0).join(sample_back(s, 1.5).select("user_id", "tick", "sample"), ["user_id", "tick"])
    got = both.join(one_pole(s, 3.0).select("user_id", "tick", "smooth"), ["user_id", "tick"])
    return got.select("user_id", "tick", "delayed", "sample", "smooth").toPandas().sort_values(["user_id", "tick"]).reset_index(drop=True)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch_and_goes_on_from_its_checkpoint(spark, tmp_path, files):
    """Events in several files, one more each run; a run begins where the one before ended."""
    events = table(spark, SF, "events").orderBy("ts", "event_id").toPandas()
    src, out = tmp_path / "events", f"file://{tmp_path}/out"
    src.mkdir()
    schema = table(spark, SF, "events").schema
    for k, part in enumerate(np.array_split(np.arange(len(events)), files)):
        spark.createDataFrame(events.iloc[part], schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        got = run_to_table(series_stream(read_events(spark, f"file://{src}"), delay=2, age=1.5, tau=3.0, initial=-1.0), out)
        assert got.count() == part[-1] + 1, k
    got = got.drop("event_id").toPandas().sort_values(["user_id", "tick"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, batch(spark), check_dtype=False, rtol=1e-9)


def test_idle_keys_are_forgotten(spark, tmp_path):
    """The second run's late events move the watermark, the third finds the first key's state gone and the other's kept."""
    src, out = tmp_path / "events", f"file://{tmp_path}/out"
    src.mkdir()
    runs = [[(1, "2024-01-01", 1, 10.0), (2, "2024-01-01", 2, 20.0)], [(3, "2024-03-01", 2, 30.0)], [(4, "2024-03-02", 2, 31.0)], [(5, "2024-03-03", 1, 40.0), (6, "2024-03-03", 2, 32.0)]]
    for rows in runs:
        df = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double")
        df = df.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", F.lit("x").alias("event_type"), "value", F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("append").parquet(f"file://{src}")
        events = read_events(spark, f"file://{src}").withWatermark("ts", "1 day")
        got = run_to_table(series_stream(events, delay=1, age=0.0, tau=1.0, idle="10 days"), out)
    ticks = {r.event_id: r.tick for r in got.collect()}
    assert ticks == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0, 6: 3}
    with pytest.raises(ValueError):
        series_stream(events, delay=1, age=0.0, tau=0.0)
