"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``. A session on one machine may go without and gets
    a temporary one; on a cluster its absence is an error, as executors would write to their own disks."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(sc.getConf().get("spark.checkpoint.dir"), sc.master))
    return df.checkpoint()


def checkpoint_dir(named: str | None, master: str) -> str:
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="pointloom-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the same folder, written once and read back. For loops within loops: a checkpoint keeps the
    constraints that the optimizer inferred, which double from round to round, and a table has none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(sc.getConf().get("spark.checkpoint.dir"), sc.master))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
