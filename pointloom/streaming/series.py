"""Series of a key as streams: delay, fractional look-back and one-pole smoothing of each event as it comes.

A key's state is a ring of its last values (a list) and its place, smoothed and first value. The rows are those that the
batch operators give for the whole table, whichever micro-batches the events come in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import exp

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pointloom.operators.lineage import checkpoint_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, event_id long, tick long, delayed double, sample double, smooth double"


class SeriesProcessor(StatefulProcessor):
    """One row an event: the value ``delay`` ticks ago (``initial`` before there is one), the value ``age`` ticks ago
    between two events (the first one before there is one), and the smoother's value."""

    def __init__(self, delay: int, age: float, tau: float, initial: float, idle_ms: int | None):
        self.delay, self.age, self.initial, self.idle = delay, age, initial, idle_ms
        self.weight = 1 - exp(-1 / tau)
        self.length = max(delay, int(age) + 1) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "v double")
        self.last = handle.getValueState("last", "tick long, smooth double, first double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["ts", "event_id"])
        ring = [r[0] for r in self.ring.get()]
        tick, smooth, first = self.last.get() if self.last.exists() else (-1, 0.0, 0.0)
        whole, part = int(self.age), self.age - int(self.age)
        out = []
        for event, v in zip(events["event_id"].tolist(), events["value"].tolist(), strict=True):
            tick += 1
            smooth, first = (v, v) if tick == 0 else (smooth + self.weight * (v - smooth), first)
            ring = [*ring, v][-self.length :]
            back = lambda k, none: ring[-1 - k] if k <= tick else none
            near = back(whole, first)
            sample = near + (back(whole + 1, first) - near) * part
            out.append((key[0], event, tick, back(self.delay, self.initial), sample, smooth))
        self.ring.put([(v,) for v in ring])
        self.last.update((tick, smooth, first))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(events["ts"].max().timestamp() * 1000) + self.idle)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "tick", "delayed", "sample", "smooth"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key that was idle for long is forgotten; its next event begins a new series."""
        self.ring.clear()
        self.last.clear()
        yield pd.DataFrame({"user_id": [], "event_id": [], "tick": [], "delayed": [], "sample": [], "smooth": []}).astype({"user_id": "int64", "event_id": "int64", "tick": "int64"})

    def close(self) -> None:
        pass


def series_stream(events: DataFrame, *, delay: int, age: float, tau: float, initial: float = 0.0, idle: str | None = None) -> DataFrame:
    """user_id, event_id, tick, delayed, sample, smooth of a stream of events (user_id, event_id, ts, value).

    With ``idle`` (such as ``30 days``) a key's state goes when the watermark has passed its last event by that long;
    events must have a watermark then. Events of a key come in order of time across micro-batches.
    """
    if tau <= 0 or delay < 0 or age < 0:
        raise ValueError("tau must be above 0, delay and age not below")
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    processor = SeriesProcessor(delay, age, tau, initial, wait)
    return events.groupBy("user_id").transformWithStateInPandas(processor, OUTPUT, "Append", "None" if idle is None else "EventTime")


@contextmanager
def rocks_state(spark: SparkSession):
    """State of several variables a key needs the RocksDB store; the session's setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs what has come so far to the end and returns the table at ``path``; called again, it goes on from there."""
    spark = stream.sparkSession
    with rocks_state(spark):
        writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def table_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    sc = spark.sparkContext
    return f"{sc.getCheckpointDir() or checkpoint_dir(sc.getConf().get('spark.checkpoint.dir'), sc.master)}/{tag}-{uuid.uuid4().hex}"


