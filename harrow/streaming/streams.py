"""Structured Streaming twins: windowed counts with late data, sessions, watch states and outcome folds in keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from harrow.session import passing, shared_dir, ship

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """New event files of a folder as a stream."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def without_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that begin within do not run batches without data; with timers by the clock those would never end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, run through the stream once into files of the shared folder; whole results take the place of earlier ones."""
    spark = stream.sparkSession
    root = passing(spark, f"{shared_dir(spark)}/s{uuid.uuid4().hex}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{root}/rows")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows"))
    with without_idle_batches(spark) if mode == "append" else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def window_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; rows later than ``late`` are left out in append mode."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): a session ends after ``gap`` without an event."""
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def watched(stream: DataFrame) -> DataFrame:
    """(user_id, event_id, changed, checks, changes): a URL's (user's) watch state carried from batch to batch."""
    ship(stream.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, checks, changes = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            changed = last is not None and kind != last
            checks, changes, last = checks + 1, changes + int(changed), kind
            out.append((key[0], event_id, changed, checks, changes))
        state.update((last, checks, changes))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "changed", "checks", "changes"])

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, changed boolean, checks long, changes long", "last string, checks long, changes long", "append", GroupStateTimeout.NoTimeout
    )


def folded(stream: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(user_id, n, avg): the decaying mean of a domain's (user's) response times, in keyed state; a row for every batch that touches it."""
    ship(stream.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, avg = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for value in rows["value"]:
            avg = value if n == 0 else avg * (1 - alpha) + value * alpha
            n += 1
        state.update((n, float(avg)))
        yield pd.DataFrame([(key[0], n, float(avg))], columns=["user_id", "n", "avg"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, avg double", "n long, avg double", "append", GroupStateTimeout.NoTimeout)


# Processors are made within functions, so that they travel whole: the driver's own worker for them has no shipped package.
def store_processor(ttl: float) -> StatefulProcessor:
    class StoreProcessor(StatefulProcessor):
        """A store of one key's last write, which is gone after ``ttl`` seconds: state that Spark drops, and an age for what is not dropped yet."""

        def __init__(self, ttl: float):
            self.ttl = ttl

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "t double", ttlDurationMs=int(self.ttl * 1000))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(rows)).sort_values(["t", "event_id"])
            last = self.last.get()[0] if self.last.exists() else None
            out = []
            for event_id, t, stored in zip(got["event_id"], got["t"], got["stored"], strict=True):
                out.append((key[0], event_id, last is not None and t - last <= self.ttl))
                last = t if stored else last
            if last is not None:
                self.last.update((last,))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "hit"])

        def close(self) -> None:
            pass

    return StoreProcessor(ttl)


def cap_processor(most: int, idle: float) -> StatefulProcessor:
    class CapProcessor(StatefulProcessor):
        """The first ``most`` messages of a capture, with its counts so far; a capture that is idle for ``idle`` seconds is closed by a timer."""

        def __init__(self, most: int, idle: float):
            self.most, self.idle = most, idle

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.counts = handle, handle.getValueState("counts", "sent long, received long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(rows)).sort_values(["t", "event_id"])
            sent, received = self.counts.get() if self.counts.exists() else (0, 0)
            out = []
            for event_id, direction in zip(got["event_id"], got["direction"], strict=True):
                if sent + received >= self.most:
                    break
                sent, received = sent + (direction == "sent"), received + (direction != "sent")
                out.append((key[0], event_id, sent, received))
            self.counts.update((sent, received))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "sent", "received"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.counts.clear()
            yield pd.DataFrame([], columns=["user_id", "event_id", "sent", "received"])

        def close(self) -> None:
            pass

    return CapProcessor(most, idle)


def keyed_state(spark: SparkSession) -> None:
    """Processors of keyed state need this store; it takes the place of the default one for queries that begin later."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stored(stream: DataFrame, ttl: float) -> DataFrame:
    """(user_id, event_id, hit) of a stream (user_id, event_id, t, stored): whether the user's entry was written at most ``ttl`` seconds before."""
    keyed_state(stream.sparkSession)
    return stream.groupBy("user_id").transformWithStateInPandas(store_processor(ttl), "user_id long, event_id long, hit boolean", "append", "ProcessingTime")


def capped(stream: DataFrame, most: int, idle: float = 3600.0) -> DataFrame:
    """(user_id, event_id, sent, received) of a stream (user_id, event_id, t, direction): each capture's (user's) first ``most`` messages."""
    keyed_state(stream.sparkSession)
    return stream.groupBy("user_id").transformWithStateInPandas(cap_processor(most, idle), "user_id long, event_id long, sent long, received long", "append", "ProcessingTime")
