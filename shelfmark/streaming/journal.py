"""Change events as a stream: a journal of numbered files in a folder, and a streaming source that reads it.

A writer appends whole files, `00000000000000000042.jsonl` after `...41.jsonl`, an event a line; a file appears under its
number only when it is complete, and never changes. An offset is the number of files before it, so a stopped query goes on
where its checkpoint says: what a batch held is read again if the batch has to be run again, and nothing is read twice by
two batches. Numbers are taken without a gap: what lies behind a gap waits. A batch takes at most `maxFiles` files, each of
which is a task. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("library_id", T.LongType()),
    T.StructField("directory", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("is_directory", T.BooleanType()),
    T.StructField("generation", T.LongType()),
    T.StructField("at_ms", T.LongType()),
])
#: Events of a file have the numbers from file * PER_FILE on.
PER_FILE = 1 << 20


def _name(number: int) -> str:
    return f"{number:020d}.jsonl"


def length(folder: str, known: int = 0) -> int:
    """Files from the first on without a gap; `known` of them are known to be there."""
    while os.path.exists(os.path.join(folder, _name(known))):
        known += 1
    return known


def append(folder: str, events: Iterable[dict]) -> int:
    """Adds a file of events (fields of EVENT but seq) and returns its number. Of two writers that take one number, one takes the next."""
    lines = [json.dumps(e) for e in events]
    if len(lines) > PER_FILE:
        raise ValueError(f"a file holds at most {PER_FILE} events")
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(part, "w") as f:
        f.write("".join(line + "\n" for line in lines))
    number = length(folder)
    try:
        while True:
            try:
                os.link(part, os.path.join(folder, _name(number)))  # fails where it is there: no file is written over
                return number
            except FileExistsError:
                number += 1
    finally:
        os.unlink(part)


class File(InputPartition):
    def __init__(self, number: int):
        self.number = number


class JournalReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.most = options["path"], int(options.get("maxFiles", 64))
        self.at = None

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        """What the next batch reads to. At most `maxFiles` files more than the last one; the first batch of a reader takes all that there is, as it isn't told where the query stands."""
        there = length(self.folder, self.at or 0)
        self.at = there if self.at is None else min(there, self.at + self.most)
        return {"files": self.at}

    def partitions(self, start: dict, end: dict):
        return [File(n) for n in range(start["files"], end["files"])]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(os.path.join(self.folder, _name(partition.number))) as f:
            for k, line in enumerate(f):
                event = json.loads(line)
                yield (partition.number * PER_FILE + k, *[event.get(c.name) for c in EVENT.fields[1:]])

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    @classmethod
    def name(cls):
        return "change_journal"

    def schema(self):
        return EVENT

    def streamReader(self, schema):
        return JournalReader(self.options)


def watch(spark: SparkSession, folder: str, most_files: int = 64) -> DataFrame:
    """The stream of a journal's events."""
    spark.dataSource.register(JournalSource)
    return spark.readStream.format("change_journal").option("maxFiles", str(most_files)).load(folder)


def events_between(old: DataFrame, new: DataFrame, library: int) -> DataFrame:
    """Events (fields of EVENT but seq and time) that lead from one listing of a library's tree to the next, for trees that send no events of their own: what came or changed is closed after writing, what went is deleted; a directory that is new is created."""
    one = lambda df: df.select("relative_path", "parent_path", "name", F.col("kind").alias("k"), F.struct("size_bytes", "mtime_ns").alias("mark"))
    a, b = one(old).withColumnRenamed("mark", "was"), one(new).withColumnRenamed("mark", "is")
    met = a.join(b, ["relative_path", "parent_path", "name", "k"], "full")
    folder = F.col("k") == "directory"
    event = F.when(F.col("is").isNull(), "delete").when(folder & F.col("was").isNull(), "create").when(~folder & ~F.col("is").eqNullSafe(F.col("was")), "close_write")
    found = met.filter("relative_path <> ''").withColumn("event", event).filter("event is not null")
    return found.select(F.lit(library).cast("long").alias("library_id"), F.col("parent_path").alias("directory"), "name", "event", folder.alias("is_directory"))
