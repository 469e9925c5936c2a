"""Bursts of change events per directory: one job after a quiet time, but no later than a cap after the burst began."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema as S

BURST = T.StructType([T.StructField("key", T.StringType()), T.StructField("created_ms", T.LongType()), T.StructField("available_ms", T.LongType()), T.StructField("events", T.LongType())])
_STATE = "created long, available long, events long"


def bursts(events: DataFrame, quiet_ms: int = S.QUIET_MS, cap_ms: int = S.CAP_MS) -> DataFrame:
    """(key, created_ms, available_ms, events) of events(key, at_ms), in batch.

    An event later than the burst's time of availability begins a new one. Tasks hold whole keys in order and fold one
    event at a time: what they keep is the open burst, and a key's events in order are Spark's sort, which spills.
    """
    kind = dict(events.dtypes)["key"]

    def run(batches):
        key, now = None, None
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now and (k != key or t > now[1]):
                    done.append((key, *now))
                    now = None
                key, now = k, _grown(now, t, quiet_ms, cap_ms)
            if done:
                yield _sent(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if now:
            yield _sent([(key, *now)], last)

    whole = events.filter("at_ms is not null").select("key", F.col("at_ms").cast("long").alias("at_ms")).repartition("key").sortWithinPartitions("key", "at_ms")
    return whole.mapInArrow(run, f"key {kind}, created_ms long, available_ms long, events long")


def _grown(now, t: int, quiet_ms: int, cap_ms: int) -> tuple[int, int, int]:
    """(created, available, events) of a burst, or of none, with one event more."""
    return (now[0], min(t + quiet_ms, now[0] + cap_ms), now[2] + 1) if now else (t, min(t + quiet_ms, t + cap_ms), 1)


def _sent(done, kind: pa.DataType) -> pa.RecordBatch:
    key, *numbers = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, kind), *[pa.array(n, pa.int64()) for n in numbers]], names=BURST.names)


def _processor(quiet_ms: int, cap_ms: int):
    from pyspark.sql.streaming import StatefulProcessor

    class Debounce(StatefulProcessor):
        """State of a key: its open burst. A timer at the burst's time of availability sends it on."""

        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("burst", _STATE)

        def _send(self, key, s):
            return pd.DataFrame({"key": [key[0]], "created_ms": [s[0]], "available_ms": [s[1]], "events": [s[2]]})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = self.state.get() if self.state.exists() else None
            before = now[1] if now else None
            for t in np.sort(np.concatenate([frame["at_ms"].to_numpy(np.int64) for frame in rows])).tolist():  # eight bytes an event of one batch, which the source bounds
                if now and t > now[1]:
                    yield self._send(key, now)
                    now = None
                now = _grown(now, t, quiet_ms, cap_ms)
            if now:
                self.state.update(tuple(now))
                if before is not None:
                    self.handle.deleteTimer(before + 1)
                self.handle.registerTimer(int(now[1]) + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.state.exists():
                now = self.state.get()
                self.state.clear()
                yield self._send(key, now)

        def close(self):
            pass

    return Debounce()


def debounced(events: DataFrame, quiet_ms: int = S.QUIET_MS, cap_ms: int = S.CAP_MS, delay: str = "0 seconds") -> DataFrame:
    """The same bursts of a stream of events(key, at_ms), by event time. Events later than the delay allows are dropped by the watermark."""
    timed = events.withColumn("event_time", F.timestamp_millis("at_ms")).withWatermark("event_time", delay)
    return timed.groupBy("key").transformWithStateInPandas(_processor(quiet_ms, cap_ms), BURST, "Append", "EventTime")


def watch_actions(raw: DataFrame) -> DataFrame:
    """Change events from raw(library_id, directory, name, event, is_directory): a new file counts once it is closed after writing, a new directory at once; an overflow concerns the whole library."""
    kind = F.when(F.col("event").isin("overflow", "unmounted"), F.when(F.col("event") == "overflow", "overflow").otherwise("invalidated"))
    kind = kind.when((F.col("event") == "create") & ~F.col("is_directory"), None).otherwise("dirty")
    return raw.withColumn("kind", kind).filter("kind is not null").select("library_id", F.when(F.col("kind") == "dirty", F.col("directory")).otherwise("").alias("directory"), "kind")


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts of events(ts, event_type) per window, batch or stream; events without a time zone are taken as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", delay)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")
