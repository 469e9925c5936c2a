"""A directory tree as a table, without following links.

A whole tree is walked in rounds. In a round the directories that are still to be listed are dealt over all tasks; a task
goes on below what it was dealt until it has listed its share of entries, and hands back the directories that it has not
come to. So one deep or crowded folder is shared by all tasks from the second round on, and a flat tree is done in one. A
round is a staged table: a lost executor costs that round's listing. One directory's own entries are a data source.
"""

from __future__ import annotations

import os
import stat
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark import schema as S
from shelfmark.functions import scalar as X
from shelfmark.staging import staged

MAX_ENTRIES = 2_048


class One(InputPartition):
    """The root and its own entries."""


def _row(root: str, relative: str):
    """The row of an entry and whether to go below it."""
    info = os.lstat(os.path.join(root, relative))
    name, parent = os.path.basename(relative), os.path.dirname(relative)
    if stat.S_ISDIR(info.st_mode):
        skipped = "system_directory" if name.lower() in S.SYSTEM_DIRECTORIES else None
        return ("directory", relative, parent, name, info.st_mtime_ns, 0, skipped), skipped is None
    if stat.S_ISREG(info.st_mode):
        return ("file", relative, parent, name, info.st_mtime_ns, info.st_size, None), False
    return ("file", relative, parent, name, info.st_mtime_ns, 0, "link" if stat.S_ISLNK(info.st_mode) else "special"), False


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.identity = root_identity(self.root)

    def partitions(self):
        return [One(None)]

    def read(self, partition):
        if root_identity(self.root) != self.identity:
            raise RuntimeError("the root was replaced")
        info = os.lstat(self.root)
        yield ("directory", "", "", "", info.st_mtime_ns, 0, None)
        names = sorted(e.name for e in os.scandir(self.root))
        if len(names) > MAX_ENTRIES:
            raise RuntimeError("too many entries")
        for name in names:
            yield _row(self.root, name)[0]


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "directory_tree"

    def schema(self):
        return S.LISTING

    def reader(self, schema):
        return TreeReader(self.options)


def root_identity(path: str) -> tuple[int, int]:
    info = os.stat(path)
    return info.st_dev, info.st_ino


#: Entries that a task lists in one round, about.
SHARE = 20_000


def walk(spark, path: str, recursive: bool = True, share: int = SHARE, tasks: int | None = None) -> DataFrame:
    """Every entry below path and the root; skipped entries say why. The path must be one that all executors see. A whole tree is walked when this is called; a RuntimeError says that the root was replaced meanwhile."""
    if not recursive:
        spark.dataSource.register(TreeSource)
        return spark.read.format("directory_tree").option("recursive", "false").load(path)
    identity, tasks = root_identity(path), tasks or 4 * spark.sparkContext.defaultParallelism
    info = os.lstat(path)
    root = spark.createDataFrame([("directory", "", "", "", info.st_mtime_ns, 0, None)], S.LISTING)
    done, left = [root], spark.createDataFrame([("",)], "relative_path string")
    while True:
        found = staged(left.repartition(tasks).mapInArrow(_below(path, identity, share), T.StructType([*S.LISTING.fields, T.StructField("pending", T.BooleanType())])), "walk")
        done.append(found.filter("not pending").drop("pending"))
        left = found.filter("pending").select("relative_path")
        if left.isEmpty():
            if root_identity(path) != identity:
                raise RuntimeError("the root was replaced")
            return reduce(DataFrame.unionByName, done)


def _below(root: str, identity: tuple[int, int], share: int):
    """What lies below directories: their entries, and as pending the directories that a task has not come to."""
    names = [f.name for f in S.LISTING.fields]

    def run(batches):
        if root_identity(root) != identity:
            raise RuntimeError("the root was replaced")
        listed = 0
        for batch in batches:
            todo, out = batch.column(0).to_pylist()[::-1], []
            while todo and listed < share:
                above = todo.pop()
                for e in os.scandir(os.path.join(root, above)):
                    row, below = _row(root, f"{above}/{e.name}" if above else e.name)
                    out.append((*row, False))
                    listed += 1
                    if below:
                        todo.append(row[1])
                if len(out) >= 8192:
                    yield _batch(out, names)
                    out = []
            out += [("directory", relative, None, None, None, None, None, True) for relative in todo]
            if out:
                yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("mtime_ns", "size_bytes") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds, pa.bool_()], strict=True)], names=[*names, "pending"])


def classified(entries: DataFrame) -> DataFrame:
    """Entries with kind, format, mime_type and fingerprint; files of unknown extensions are skipped."""
    known = X.classify_path(F.col("relative_path"))
    out = entries.withColumn("c", F.when((F.col("kind") == "file") & F.col("skipped").isNull(), known))
    unknown = (F.col("kind") == "file") & F.col("skipped").isNull() & F.col("c").isNull()
    return out.select(
        "kind", "relative_path", "parent_path", "name", "mtime_ns", "size_bytes", F.when(unknown, "unsupported").otherwise(F.col("skipped")).alias("skipped"),
        F.col("c.kind").alias("asset_kind"), F.col("c.format").alias("format"), F.col("c.mime").alias("mime_type"), F.when(F.col("c").isNotNull(), X.source_fingerprint(F.col("size_bytes"), F.col("mtime_ns"))).alias("source_fingerprint"),
    )


def candidates(spark, path: str, used: DataFrame | None = None) -> DataFrame:
    """Child directories with the reason why one can't be a library: a link, a system directory, or an overlap with a used root_rel_path."""
    children = walk(spark, path, recursive=False).filter("relative_path <> '' and (kind = 'directory' or skipped = 'link')")
    if used is None:
        return children.select("name", F.col("skipped").alias("blocked"))
    inside = used.select(F.explode(X.path_ancestors(F.col("root_rel_path"))).alias("name")).filter("name <> ''").distinct().withColumn("taken", F.lit("overlap"))
    return children.join(inside, "name", "left").select("name", F.coalesce("skipped", "taken").alias("blocked"))
