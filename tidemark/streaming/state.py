"""Streams that remember: redeliveries within a watermark, marks of channels, re-observation that expires, timelines of event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators import store

REDELIVERY, LATE, REOBSERVE_MS = "1 hour", "25 hours", 60_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, as marks() and reobserved() need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# -- redelivery --------------------------------------------------------------------------------------------------------


def once_within(raw: DataFrame, arrived_ms: str = "arrived_ms", delay: str = REDELIVERY) -> DataFrame:
    """Raw events of a stream without those whose idempotency key arrived within `delay` before.

    The watermark follows the arrival at the engine, which only grows, and not the events' own times: so no event is late, and none is
    lost. Keys older than the watermark leave the state; what is redelivered after that is left to the table (store.append).
    """
    at = raw.withColumn("__arrived", F.timestamp_millis(F.col(arrived_ms))).withWatermark("__arrived", delay)
    return at.dropDuplicatesWithinWatermark(["idem_key"]).drop("__arrived")


def append_stream(raw: DataFrame, path: str, checkpoint: str, counted=None) -> StreamingQuery:
    """Appends raw events of a stream to the table at `path`; counted: called with each micro-batch's number and counts."""

    def batch(df: DataFrame, number: int) -> None:
        counts = store.append(df, path)
        if counted:
            counted(number, counts)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- marks -------------------------------------------------------------------------------------------------------------


class _Mark(StatefulProcessor):
    """A channel's highest record id; a poll's records are compared with the mark that it found."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = self.mark.get()[0] if self.mark.exists() else None
        newest = mark
        for part in rows:
            ids = part["record_id"]
            if len(part):
                newest = int(ids.max()) if newest is None else max(newest, int(ids.max()))
            yield part if mark is None else part[ids > mark]
        if newest is not None and newest != mark:
            self.mark.update((newest,))

    def close(self) -> None:
        pass


def marks(records: DataFrame) -> DataFrame:
    """Records of a stream (`channel`, `record_id`, ...) above their channel's high-water mark; a first poll has all. A number is kept for each channel. Start it within rocksdb()."""
    return records.groupBy("channel").transformWithStateInPandas(_Mark(), records.schema, "append", "None")


# -- re-observation ----------------------------------------------------------------------------------------------------


class _Reported(StatefulProcessor):
    """When a key was last reported; forgotten once the watermark has passed the time from which it is reported anew anyway."""

    def __init__(self, key_cols: list[str], names: list[str], timeout_ms: int) -> None:
        self.key_cols, self.names, self.timeout = key_cols, names, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # of a key's rows only their times are held
        times = np.sort(np.concatenate([np.asarray(part["at_ms"], np.int64) for part in rows]))
        last = self.last.get()[0] if self.last.exists() else None
        reported, i = [], 0 if last is None else int(np.searchsorted(times, last + self.timeout))
        while i < len(times):
            reported.append(int(times[i]))
            i = int(np.searchsorted(times, reported[-1] + self.timeout))
        if reported:
            self.last.update((reported[-1],))
            self.handle.registerTimer(reported[-1] + self.timeout)
            yield pd.DataFrame({c: [key[self.key_cols.index(c)]] * len(reported) if c in self.key_cols else reported for c in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # an older timer than the last report's is of no account
        if self.last.exists() and self.last.get()[0] + self.timeout <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def reobserved(sightings: DataFrame, key_cols: list[str], timeout_ms: int = REOBSERVE_MS, delay: str = "1 minute") -> DataFrame:
    """Sightings of a stream to report: a key's first, then each that is `timeout_ms` or more after the last reported.

    sightings: the keys and `at_ms`. Those that come more than `delay` after later ones are left out. A key that isn't seen
    again leaves the state when the watermark passes its timeout: later sightings are reported with and without it. Start it within rocksdb().
    """
    names = sightings.columns
    if set(names) != {*key_cols, "at_ms"}:
        raise ValueError("sightings have their keys and at_ms")
    at = sightings.withColumn("__at", F.timestamp_millis(F.col("at_ms"))).withWatermark("__at", delay)
    return at.groupBy(*key_cols).transformWithStateInPandas(_Reported(key_cols, names, timeout_ms), sightings.schema, "append", "EventTime")


# -- timelines ---------------------------------------------------------------------------------------------------------


def timeline(p: DataFrame, width: str = "1 hour", delay: str = LATE, time_ms: str = "observed_time") -> DataFrame:
    """Counts of a stream by event-time window and source: `start_ms`, `source_id`, `n`; events up to `delay` late are counted."""
    at = p.withColumn("__at", F.timestamp_millis(F.col(time_ms))).withWatermark("__at", delay)
    n = at.groupBy(F.window("__at", width).alias("w"), "source_id").agg(F.count("*").alias("n"))
    return n.select(F.unix_millis("w.start").alias("start_ms"), "source_id", "n")


def write_timeline(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what each micro-batch changed of a timeline(); read_timeline() has the state after the last one."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").parquet(path)

    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("start_ms", "source_id").agg(F.max_by("n", "batch").alias("n"))
