"""A stored trigram index: posting blocks, searched from the rarest gram on, kept up by changes that are merged in time.

A block holds the ids of one gram in one span of ids, as places in the span in order: a gram that every row has is many
blocks of one size and no crowd. Blocks lie in folders by a hash of their gram, so a search opens the folders of its grams
only. It first reads how often each gram occurs (a small table of its own, in the same folders), takes the rarest few, and
intersects their blocks span by span; a candidate's text is then tested for the whole term, and texts lie in folders by
span, so that of those only the ones with candidates are read.

Changes are rows that came, changed or went since the index was built. A search takes no indexed row that has changed and
tests the changed ones themselves, so it is exact at any time; merging makes a new index of both. Everything is published
by the manifest of Snapshots: a reader sees an index and its changes as they belong together.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.snapshots import Snapshots
from shelfmark.staging import staged

#: Ids of a block's span, and folders of blocks.
SPAN, FOLDERS = 65_536, 256
#: Grams that are intersected: more of them seldom leave fewer candidates, and each is one more folder to read.
RAREST = 3


class SearchIndex:
    """rows(id, text) of one table; ids are not negative."""

    def __init__(self, spark: SparkSession, folder: str, span: int = SPAN, folders: int = FOLDERS):
        self.spark, self.store, self.span, self.folders = spark, Snapshots(spark, folder), span, folders

    def _folder(self, gram):
        return F.pmod(F.crc32(gram.cast("binary")), F.lit(self.folders)).cast("int")

    def build(self, rows: DataFrame) -> int:
        """Publishes the index of rows(id, text) without changes; returns its revision."""
        rows = staged(rows.select(F.col("id").cast("long").alias("id"), "text").withColumn("span", F.floor(F.col("id") / self.span)), "rows")
        run, schema = _blocks(self.span)
        blocks = staged(rows.filter(F.length("text") >= 3).groupBy("span").applyInPandas(run, schema).withColumn("folder", self._folder(F.col("gram"))), "blocks")
        often = blocks.groupBy("gram", "folder").agg(F.sum("n").cast("long").alias("n")).select("gram", "n", "folder")
        none = self.spark.createDataFrame([], "id long, text string")
        laid = lambda df, by, *order: df.repartition(by).sortWithinPartitions(by, *order)
        tables = {"blocks": laid(blocks, "folder", "gram", "span"), "often": laid(often, "folder", "gram"), "texts": laid(rows, "span", "id"), "changes": none}
        return self.store.publish(tables, self.store.revision(), by={"blocks": ["folder"], "often": ["folder"], "texts": ["span"]})

    def change(self, rows: DataFrame) -> int:
        """Publishes changes(id, text) on top of those that there are: a null text is a row that went."""
        new = rows.select(F.col("id").cast("long").alias("id"), "text")
        revision = self.store.revision()
        return self.store.publish({"changes": self.store.read("changes").join(new, "id", "left_anti").unionByName(new)}, revision, full=False)

    def rows(self) -> DataFrame:
        """All rows as they are now."""
        changes = self.store.read("changes")
        return self.store.read("texts").select("id", "text").join(changes, "id", "left_anti").unionByName(changes.filter("text is not null"))

    def merge(self) -> int:
        """A new index of all rows as they are now."""
        return self.build(self.rows())

    def search(self, *terms: str) -> DataFrame:
        """(id, text) of the rows that hold every term, literally. Terms under three characters have no grams and are tested only; a search without a longer one is a scan."""
        holds = reduce(lambda a, b: a & b, [F.contains("text", F.lit(t)) for t in terms])
        changes, texts = self.store.read("changes"), self.store.read("texts")
        parts = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
        if parts:
            places = self.candidates(parts)
            spans = [r[0] for r in places.select("span").distinct().limit(4097).collect()]  # by these the folders are chosen; beyond so many, the join alone decides
            texts = texts.filter(F.col("span").isin(spans)) if len(spans) <= 4096 else texts
            texts = texts.join(places.select(F.explode(F.transform("places", lambda at: F.col("span") * self.span + at)).alias("id")), "id", "left_semi")
        return texts.select("id", "text").filter(holds).join(changes, "id", "left_anti").unionByName(changes.filter(holds))

    def candidates(self, parts: list[str]) -> DataFrame:
        """(span, places) of the ids that have the rarest of the grams."""
        folders = lambda grams: F.col("folder").isin([_folder_of(g, self.folders) for g in grams])
        often = self.store.read("often").filter(folders(parts) & F.col("gram").isin(parts)).orderBy("n", "gram").select("gram").collect()  # a row a gram of the term
        blocks = self.store.read("blocks")
        if len(often) < len(parts):
            return blocks.limit(0).select("span", "places")  # a gram that no row has
        rare = [r[0] for r in often[:RAREST]]
        met = blocks.filter(folders(rare) & F.col("gram").isin(rare)).groupBy("span").agg(F.sort_array(F.collect_list(F.struct("n", "places"))).alias("b"))
        both = F.aggregate(F.slice("b", 2, RAREST), F.element_at("b", 1)["places"], lambda a, x: F.array_intersect(a, x["places"]))
        return met.filter(F.size("b") == len(rare)).select("span", both.alias("places")).filter(F.size("places") > 0)


def _blocks(width: int):
    """The blocks of a span of `width` ids: (gram, span, places, n). Rows meet by span, so that no gram of a text is a row that is shuffled."""

    def run(key, frame):
        import pandas as pd

        ids, texts = frame["id"].to_numpy(), frame["text"].tolist()
        signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(ids)), [len(t) for t in texts])
        inside = row[2:] == row[:-2]  # three characters of one text
        codes = ((signs[:-2] << np.uint64(42)) | (signs[1:-1] << np.uint64(21)) | signs[2:])[inside]
        kinds, kind = np.unique(codes, return_inverse=True)
        pairs = np.unique(kind.astype(np.int64) * width + (ids % width)[row[2:][inside]])
        kind, places = pairs // width, (pairs % width).astype(np.int32)
        starts = np.searchsorted(kind, np.arange(len(kinds)))
        low = np.uint64(2**21 - 1)
        grams = ["".join(map(chr, g)) for g in zip(*((kinds >> np.uint64(s) & low).tolist() for s in (42, 21, 0)), strict=True)]
        return pd.DataFrame({"gram": grams, "span": key[0], "places": np.split(places, starts[1:]), "n": np.diff([*starts, len(kind)])})

    return run, "gram string, span long, places array<int>, n int"


def _folder_of(gram: str, folders: int) -> int:
    return zlib.crc32(gram.encode()) % folders
