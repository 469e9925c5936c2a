"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the sources' cumulative shares to give a schedule of slots; the j-th slot of a
source takes the j-th equal-token block of that source's shuffled stream of words, starting again when the stream ends.

A document's size is its number of words; null and empty texts have size 0 and nothing is taken from them. A null source
is a source, the last one. Repeated rows and ids are documents of their own. Empty tables give empty results. Long texts
are taken in pieces, as blocks meet them. `mix` reads key, text and source alone, and `mixed_rows` keeps every column,
whatever its name. Every running sum of documents is done in two levels, so that a source that holds most rows is still
dealt over many tasks; the sources themselves, a row each, are summed in one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table, word_count, written

GOLDEN = (math.sqrt(5) - 1) / 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) of sizes(source, size): share times all words, dealt by weight, at most `most` times each source's size.

    The reshared excess ends where target = min(most * size, level * weight) for one level; sources reach their limit in
    the order of most * size / weight, so running sums over that order give the level. One row per source in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
    s = s.withColumn("limit", F.col("source_size") * most)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / open_weight)
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double"))).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(source, rank, slot): for each source as many ranked slots as its target has blocks.

    Shares are widened by a slack above the discrepancy of the golden-ratio sequence, so that no source lacks a slot.
    """
    quota, size = F.round("target").cast("long"), F.col("source_size")
    blocks = F.floor(quota / size) * F.ceil(size / block) + F.ceil((quota % size) / block)
    need = targets.filter(size > 0).withColumn("need", blocks.cast("long")).filter("need > 0")
    total, n = need.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    slack = 6 + math.ceil(4 * math.log(2 + total + 64 * n))
    slots = total + slack * n
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    share = need.withColumn("high", F.sum(F.col("need") + slack).over(upto) / F.lit(float(max(slots, 1))))
    share = share.withColumn("low", F.col("high") - (F.col("need") + slack) / F.lit(float(max(slots, 1))))
    bins = 4096
    share = share.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * bins), F.least(F.floor(F.col("high") * bins), F.lit(bins - 1)))))
    step = (GOLDEN * 2**20) % 1  # in two parts: the product keeps its digits for any slot number
    point = (F.floor(F.col("slot") / 2**20) * step + F.pmod(F.col("slot"), F.lit(2**20)) * GOLDEN) % 1
    at = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("bin", F.floor(F.col("u") * bins))
    edge = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | (F.col("high") > 1 - 1e-12))
    dealt = at.join(share, "bin").filter(edge).withColumn("chunk", F.floor(F.col("slot") / 65536)).select("source", "slot", "chunk", "need")
    same, earlier = Window.partitionBy("source", "chunk").orderBy("slot"), Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("source", "chunk").count().select(F.col("source").alias("s"), F.col("chunk").alias("k"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    ranked = dealt.join(offset, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("k"))).withColumn("rank", F.col("offset") + F.row_number().over(same) - 1)
    return ranked.filter(F.col("rank") < F.col("need")).select("source", "rank", "slot")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = 1024, seed: int = 7, most: int = 2, **shares) -> DataFrame:
    """(key, size, source_size, target, taken, slots) of every row of docs.

    taken counts words, repeats included; per source they sum to its rounded target. slots holds, for each round through
    the source's stream, the earliest slot of the schedule with words of the document, null if none; there are at most
    `most` rounds.
    """
    sized = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    targets = written(source_targets(sized, most=most, **shares), "targets")
    cols = {c: targets[c] for c in ("source_size", "target")}
    order = F.xxhash64(F.lit(seed), F.col("key"))
    spread = sized.withColumns({"order": order, "part": F.shiftrightunsigned(order, 52)})
    offset = spread.groupBy("source", "part").agg(F.sum("size").alias("words"))
    offset = offset.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "part").orderBy("order", "key", "size")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        spread.join(offset, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .withColumns({"start": F.col("offset") + F.coalesce(F.sum("size").over(earlier), F.lit(0)), "row": F.row_number().over(inside)})
        .select("key", "source", "size", "part", "row", "start")
    )
    t = targets.select(F.col("source").alias("ts"), *cols)
    laid = laid.join(t, F.col("source").eqNullSafe(F.col("ts"))).drop("ts").withColumn("quota", F.round("target").cast("long"))
    last = F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    pieces = pieces.withColumns({"from": F.greatest(F.col("start"), F.col("block") * block), "to": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})
    blocks = F.ceil(F.col("source_size") / block)
    slots = schedule(targets, block).join(t.select("ts", "source_size"), F.col("source").eqNullSafe(F.col("ts")))
    slots = slots.select(F.col("source").alias("ss"), F.pmod("rank", blocks).alias("sb"), F.floor(F.col("rank") / blocks).alias("round"), "slot")
    met = pieces.join(slots, F.col("source").eqNullSafe(F.col("ss")) & (F.col("block") == F.col("sb")), "left")
    room = F.col("quota") - F.col("round") * F.col("source_size") - F.col("from")
    got = F.when(F.col("slot").isNotNull(), F.greatest(F.lit(0), F.least(F.col("to") - F.col("from"), room))).otherwise(0)
    some = (F.col("to") > F.col("from")) & (got > 0)
    firsts = F.array(*[F.min(F.when(some & (F.col("round") == r), F.col("slot"))) for r in range(most)])
    return (
        met.groupBy("source", "part", "row", "size", "key")
        .agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.when(F.col("to") > F.col("from"), got).otherwise(0)).alias("taken"), firsts.alias("slots"))
        .select(F.col("key").alias(key), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"), "slots")
    )


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """docs with each row as often as the mix takes its words, to the nearest whole number, in the order of the schedule.

    A copy stands where the schedule first takes words of it in its round. Rows with one key count alike, as the one of
    which most is taken.
    """
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = mix(docs, text, source, key, **how).withColumn("copies", copies).filter("copies > 0")
    times = taken.groupBy(F.col(key).alias("of")).agg(F.max(F.struct("copies", "slots")).alias("most"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"))
    met = rows.join(times, F.col("key").eqNullSafe(F.col("of")))
    place = F.expr("transform(sequence(1, most.copies), n -> coalesce(get(most.slots, n - 1), array_max(most.slots)))")
    return met.withColumn("place", F.explode(place)).orderBy("place", "key").select("row.*")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
