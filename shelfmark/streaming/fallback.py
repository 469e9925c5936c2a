"""What a watch leads to: a reconcile of a directory, or a full scan where the watch has lost track.

A library is watched once it has a published generation. An overflow, or a root that became invalid, degrades it: one full
scan is asked for, and all that the watch says from then on is dropped, as the scan will find it. The fence is the generation
at that time; only a newer one, published by the scan, lifts it. Generations only go up, so what passes hangs on the
generation that an event meets alone: in each, all up to the first sign of lost track.

events(library_id, seq, kind, directory, generation): kind is dirty, overflow, invalidated or published; generation counts in
published ones. An overflow is of a whole watch: `of_all` gives every library its own. Events are in the order of seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a library is degraded for.
CODES = {"overflow": "watch_overflow", "invalidated": "source_unavailable"}
ACTION = T.StructType([T.StructField("library_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()), T.StructField("directory", T.StringType()), T.StructField("code", T.StringType())])


def of_all(events: DataFrame, libraries: DataFrame) -> DataFrame:
    """Events with those without a library, as an overflow is, given to every one of libraries(id)."""
    none = events.filter("library_id is null").drop("library_id").crossJoin(libraries.select(F.col("id").alias("library_id")))  # a row a library: that is what it means
    return events.filter("library_id is not null").unionByName(none)


def actions(events: DataFrame) -> DataFrame:
    """(library_id, seq, action, directory, code) in batch: reconcile of a directory, or full_scan with its code."""
    order = Window.partitionBy("library_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("met", F.coalesce(F.max(F.when(F.col("kind") == "published", F.col("generation"))).over(order), F.lit(0)))
    lost = F.col("kind").isin(*CODES)
    before = Window.partitionBy("library_id", "met").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    passed = met.withColumn("fenced", F.coalesce(F.bool_or(lost).over(before), F.lit(False))).filter("met >= 1 and not fenced and kind <> 'published'")
    code = F.when(F.col("kind") == "overflow", CODES["overflow"]).when(lost, CODES["invalidated"])
    return passed.select("library_id", "seq", F.when(lost, "full_scan").otherwise("reconcile").alias("action"), F.when(~lost, F.col("directory")).alias("directory"), code.alias("code"))


def _processor():
    from pyspark.sql.streaming import StatefulProcessor

    class Fallback(StatefulProcessor):
        """State of a library: its generation, and the one that it was degraded in."""

        def init(self, handle):
            self.state = handle.getValueState("watch", "generation long, fence long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now, fence = self.state.get() if self.state.exists() else (0, -1)
            out = []
            frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
            for seq, kind, directory, generation in zip(*(frame[c] for c in ("seq", "kind", "directory", "generation")), strict=True):
                if kind == "published":
                    now = now if pd.isna(generation) else max(now, int(generation))
                elif now >= 1 and now > fence:
                    if kind in CODES:
                        fence = now
                        out.append((key[0], seq, "full_scan", None, CODES[kind]))
                    else:
                        out.append((key[0], seq, "reconcile", directory, None))
            self.state.update((int(now), int(fence)))
            yield pd.DataFrame(out, columns=ACTION.names).astype({"library_id": "int64", "seq": "int64"})

        def close(self):
            pass

    return Fallback()


def followed(events: DataFrame) -> DataFrame:
    """The same actions of a stream of events. A library's events of one batch are held at once, so the source bounds the batch."""
    return events.groupBy("library_id").transformWithStateInPandas(_processor(), ACTION, "Append", "None")
