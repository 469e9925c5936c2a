"""The top rows of every key, kept as they change: bounded state for a stream of any length, and the batch that it equals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", T.LongType())])


def top(rows: DataFrame, most: int) -> DataFrame:
    """(key, rank, score, id) of rows(key, score, id) in batch: the largest scores of each key, ties to the smaller id; a row that comes again is one row. Spark limits each task's rows per key before it shuffles."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "id"))
    return rows.select("key", "score", "id").distinct().withColumn("rank", place.cast("long")).filter(F.col("rank") <= most).select(*OUT.names)


def _processor(most: int):
    from pyspark.sql.streaming import StatefulProcessor

    class Top(StatefulProcessor):
        """State of a key: its top rows in order."""

        def init(self, handle):
            self.state = handle.getListState("top", "score long, id long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = [(int(s), int(i)) for s, i in self.state.get()] if self.state.exists() else []
            now = before
            for frame in rows:  # no more than `most` rows and a frame are held at once
                best = frame.drop_duplicates(["score", "id"]).sort_values(["score", "id"], ascending=[False, True]).head(most)
                now = sorted({*now, *zip(best["score"].astype(int).tolist(), best["id"].astype(int).tolist(), strict=True)}, key=lambda r: (-r[0], r[1]))[:most]
            if now != before:
                self.state.put(now)
                yield pd.DataFrame([(key[0], k + 1, s, i) for k, (s, i) in enumerate(now)], columns=OUT.names)

        def close(self):
            pass

    return Top()


def topped(rows: DataFrame, most: int) -> DataFrame:
    """A stream of rows(key, score, id) to the whole top of every key that has changed, in update mode; a sink that keeps the last of each (key, rank) holds the top of all that came."""
    return rows.groupBy("key").transformWithStateInPandas(_processor(most), OUT, "Update", "None")
