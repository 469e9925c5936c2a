"""Tables stored in the order of a sort key, so that a page reads the files it lies in and no others.

The key's range is cut into parts of equally many rows; a part is one file in a folder by its number, and a small table
says where each part begins and ends and how many rows it has. A page is found in that table first: the part that the
position lies in, and as many behind it as hold a page; it then opens the folders of these.

A table has as many parts as it is long, so a part is no task of its own: a task sorts a range of many parts and cuts them
from the stream of its rows. What the driver learns of a key's range is a sample a range, not a sample a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.browse import after as behind
from shelfmark.sources.snapshots import Snapshots
from shelfmark.staging import staged

#: Rows that a task sorts, about.
RANGE = 250_000


def _cut(rows: int, stride: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the parts of a task's rows, which come in order: `rows` a part, and what is left over with the last. It holds two parts at most, and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() * stride, [], 0

        def numbered(chunks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.repeat(pa.scalar(part, pa.int64()), b.num_rows)], names=[*b.schema.names, "part"])

        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            while size >= 2 * rows:
                full, left = [], rows
                while left:
                    b = held.pop(0)
                    full.append(b.slice(0, left))
                    if b.num_rows > left:
                        held.insert(0, b.slice(left))
                    left -= full[-1].num_rows
                yield from numbered(full)
                part, size = part + 1, size - rows
        yield from numbered(held)

    return run


class Clustered:
    """keys: columns of the order, the last unique. rows: of a part, about; more than a page has."""

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...], rows: int = 100_000):
        self.spark, self.store, self.keys, self.rows = spark, Snapshots(spark, folder), tuple(keys), rows

    def write(self, table: DataFrame) -> int:
        """Publishes the table in order; returns its revision."""
        table = staged(table, "unordered")  # cuts are quantiles of a sample of what is written
        n = table.count()
        ranges = max(1, min(-(-n // self.rows), -(-n // RANGE)), min(n // (8 * self.rows), self.spark.sparkContext.defaultParallelism))
        laid = table.repartitionByRange(ranges, *self.keys).sortWithinPartitions(*self.keys)
        laid = laid.mapInArrow(_cut(self.rows, n // self.rows + 1), table.select("*", F.lit(0).cast("long").alias("part")).schema).sortWithinPartitions("part", *self.keys)
        revision = self.store.publish({"rows": laid}, self.store.revision(), by={"rows": ["part"]})
        ends = self.store.read("rows").groupBy("part").agg(F.min(F.struct(*self.keys)).alias("first"), F.max(F.struct(*self.keys)).alias("last"), F.count("*").alias("n"))
        return self.store.publish({"parts": ends.coalesce(1)}, revision, full=False)

    def _beyond(self, values: tuple, down: bool) -> Column:
        """Parts that hold rows behind the position."""
        end = "first" if down else "last"
        return behind(tuple(f"{end}.{k}" for k in self.keys[: len(values)]), values, down)

    def parts(self, limit: int, after: tuple | None = None, prefix: tuple = (), descending: bool = False) -> list[int]:
        """The parts that a page has to read: the first that may hold rows of it, and those behind it until there are enough for sure."""
        parts = self.store.read("parts")
        for k, v in list(zip(self.keys, prefix, strict=False))[:1]:  # by the first key alone, which is enough to leave out what lies elsewhere
            parts = parts.filter((F.col(f"first.{k}") <= F.lit(v)) & (F.col(f"last.{k}") >= F.lit(v)))
        if after is not None:
            parts = parts.filter(self._beyond(after, descending))
        held, take = 0, []
        for r in parts.orderBy(F.desc("part") if descending else F.asc("part")).select("part", "n", F.struct("first", "last").alias("ends")).limit(limit + 2).collect():  # a part has a row at least
            take.append(r["part"])
            whole = (len(take) > 1 or after is None) and all(r["ends"][e][k] == v for e in ("first", "last") for k, v in zip(self.keys, prefix, strict=False))
            held += r["n"] if whole else 0
            if held >= limit:
                break
        return take

    def page(self, limit: int, after: tuple | None = None, prefix: tuple = (), descending: bool = False) -> DataFrame:
        """The first `limit` rows behind the position `after`, of those whose first keys are `prefix`, in order."""
        rows = self.store.folders("rows", "part", self.parts(limit, after, prefix, descending)).drop("part")
        for k, v in zip(self.keys, prefix, strict=False):
            rows = rows.filter(F.col(k) == F.lit(v))
        if after is not None:
            rows = rows.filter(behind(self.keys[: len(after)], after, descending))
        return rows.orderBy(*[F.desc(k) if descending else F.asc(k) for k in self.keys]).limit(limit)
