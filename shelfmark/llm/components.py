"""Connected components of a table of links, by alternating large and small stars; no group of links meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import rekeyed, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); label is the smallest node of the component. Loops and repeated links are allowed."""
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(rekeyed(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.join(rekeyed(large.groupBy("a").agg(F.min("b").alias("m")), "a"), "a")
        star = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(star.distinct(), "links")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node that points to another points to one, which points to none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()
