"""Structured Streaming forms: windowed event statistics with watermarks, and stateful smoothing for each key."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total by tumbling window; later events than the watermark allows are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def smoothed(events: DataFrame, tau: float) -> DataFrame:
    """user_id, ticks, smooth: each user's one-pole smoother after each batch; its state is two numbers a key."""
    a = 1 - exp(-1 / tau)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, y = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            for x in pdf.sort_values(["ts", "event_id"])["value"].tolist():
                y = x if n == 0 else y + a * (x - y)
                n += 1
        state.update((n, y))
        yield pd.DataFrame({"user_id": [key[0]], "ticks": [n], "smooth": [y]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, ticks long, smooth double", "ticks long, smooth double", "update", "NoTimeout"
    )


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs what is there and returns it as a table (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
