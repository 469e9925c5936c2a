"""Near-duplicate documents by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum over a document's shingles, so a signature of
length 2k costs k hash evaluations per shingle. Bands of the signature propose documents that may be alike; one bit of
each value is kept to dismiss most false proposals; every link is confirmed on the full shingle sets. In small sets the
minimum and the maximum depend on each other, so that bands fail more often; sets of up to `small` shingles, and all that
may be linked with such, are therefore proposed by their rarest shingles: two sets that are linked share one of the rarest
of either, as many as a link may leave out and one more. Rareness is counted over all such sets, so a phrase that many short
texts have in common brings none of them together. No link of small sets is lost, and of larger ones a bucket of their
bands holds all but a few of a hundred million.

Documents with equal sets are one node from the start. Inside a bucket a hub is compared with all members. Members that
the hub does not link compete again in the next round. Distances are 1 - Jaccard, a metric: what links to a linked
member of the hub is at most twice the threshold from the hub, so pairs that no hub decides lie in components that
such grey pairs meet. Of the sets of these components those stay that share one of their rarest shingles (as many as a link
may leave out, and one more) with another component, as two that are linked must; those that do are grouped by the least of the
components, compared block by block, and give a spanning forest of their links. A bucket's size is thus never capped, and no bucket emits all
its pairs.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. Texts may be of any length.
Other columns are passed by, whatever their names. A row with a null id takes
part through its equals only. Repeated ids and rows are allowed. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import batches_of, rekeyed, table, written
from shelfmark.llm.components import components
from shelfmark.llm.textvec import mixed, shingles, words


@dataclass(frozen=True)
class Params:
    """width: words of a shingle. A pair is linked at `percent` or more. 2 * permutations values in bands of `rows`: a pair at 0.8 of more than `small` shingles shares no band in about 4 of 100 million cases."""

    width: int = 5
    percent: int = 80
    permutations: int = 108
    rows: int = 5
    small: int = 24
    rounds: int = 2
    block: int = 512
    seed: int = 11

    @property
    def values(self) -> int:
        return 2 * self.permutations

    def most_unlike(self, percent: int) -> int:
        """Differing bits that a pair of that similarity exceeds only by five standard deviations."""
        p = (1 + max(percent, 0) / 100) / 2
        return int(self.values * (1 - p) + 5 * np.sqrt(self.values * p * (1 - p)))


def permutation_keys(p: Params) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 2**63, (p.permutations, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """[documents, 2 * permutations] minima and maxima, alternating; all documents must have shingles."""
    keys, out = permutation_keys(p), np.empty((len(offsets) - 1, p.values), np.uint32)
    top = np.uint64(32)
    low = 0
    while low < len(offsets) - 1:  # as many documents as keep the work in the processor's cache
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 32768, "right")) - 1)
        part, at = sets[offsets[low] : offsets[high]], offsets[low:high] - offsets[low]
        v = np.empty_like(part)
        for i, (x, a) in enumerate(keys):
            np.bitwise_xor(part, x, out=v)
            np.multiply(v, a, out=v)
            out[low:high, 2 * i] = np.minimum.reduceat(v, at) >> top
            out[low:high, 2 * i + 1] = np.maximum.reduceat(v, at) >> top
        low = high
    return out


def bands(sig: np.ndarray, p: Params) -> np.ndarray:
    n = p.values // p.rows
    keys = np.broadcast_to(mixed(np.arange(n, dtype=np.uint64) + np.uint64(1)), (len(sig), n)).copy()
    for k in range(p.rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, k : n * p.rows : p.rows].astype(np.uint64))
    return keys


def node_of(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole set."""
    total = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1]) if len(sets) else np.zeros(0, np.uint64)
    return mixed(total ^ mixed(np.diff(offsets).astype(np.uint64)))


def _sketch(p: Params):
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())), ("few", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1), lower=True, most=1 << 20):
                sets, offsets = shingles(w, p.width)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                own = ids.slice(w.first, w.docs)
                if len(full) < w.docs:
                    none = np.flatnonzero(sizes == 0)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(none)), pa.nulls(len(none), pa.int64()), pa.array(np.zeros(len(none), np.int64)), *[pa.nulls(len(none), schema.field(k).type) for k in (3, 4, 5)]], schema=schema)
                if len(full):
                    at = np.concatenate([offsets[full], offsets[-1:]])
                    sig = signatures(sets, at, p)
                    odd = np.zeros((len(full), -(-p.values // 64) * 64), np.uint8)
                    odd[:, : p.values] = sig & np.uint32(1)
                    bits = np.packbits(odd, axis=1, bitorder="little").view("<i8")
                    banded = bands(sig, p).view(np.int64)
                    lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(m).ravel()))
                    size = sizes[full]
                    small = 100 * p.small >= p.percent * size
                    few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(small, size, 0))]), pa.int32()), pa.array(sets[np.repeat(small, size)].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(full)), pa.array(node_of(sets, at).view(np.int64)), pa.array(size), lists(bits), lists(banded), few], schema=schema)

    return run, "id long, node long, n long, bits array<long>, bands array<long>, few array<long>"


def _sets(p: Params):
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches):
        for batch in batches:
            for w in words(batch.column(0), lower=True, most=1 << 20):
                sets, offsets = shingles(w, p.width)
                full = np.flatnonzero(np.diff(offsets))
                if len(full):
                    at = np.concatenate([offsets[full], offsets[-1:]])
                    data = pa.BinaryArray.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(sets.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(node_of(sets, at).view(np.int64)), data], schema=schema)

    return run, "node long, set binary"


def _compare(batches):
    """Shared shingles of pairs of sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("together", pa.int64())])
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        shared, both = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            m = np.sort(np.concatenate([s, t]))
            shared[i] = np.count_nonzero(m[1:] == m[:-1])
            both[i] = len(s) + len(t) - shared[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(both)], schema=schema)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, together) of pairs(a, b), on full sets."""
    a, b = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_compare, "a long, b long, shared long, together long")


def _each_shingle(batches):
    """(node, label, n, shingle) of every shingle of sets."""
    for batch in batches:
        node, label, held = (batch.column(k) for k in range(3))
        sizes = np.array([len(s.as_buffer()) // 8 for s in held], np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + (1 << 18), "right")))
            n = sizes[first:last]
            wide = lambda c: pa.array(np.repeat(c.to_numpy()[first:last], n))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([wide(node), wide(label), pa.array(np.repeat(n, n)), pa.array(np.concatenate([np.frombuffer(held[k].as_buffer(), np.int64) for k in range(first, last)]))], names=["node", "label", "n", "shingle"])
            first = last


def _blocks(percent: int):
    """Links between rows of two blocks of a group: a spanning forest of them."""

    def run(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        one, two = ([np.frombuffer(s, np.uint64) for s in f["set"]] for f in (left, right))
        all_two = np.concatenate(two)
        order = np.argsort(all_two, kind="stable")
        keys, owner = all_two[order], np.repeat(np.arange(len(two)), [len(s) for s in two])[order]
        size = np.array([len(s) for s in two])
        na, nb = left["node"].to_numpy(), right["node"].to_numpy()
        la, lb = left["label"].to_numpy(), right["label"].to_numpy()
        joined, out = set(), []
        for i, s in enumerate(one):
            lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(two))
            for j in np.flatnonzero((100 * shared >= percent * (len(s) + size - shared)) & (lb != la[i])):
                if (la[i], lb[j]) not in joined:
                    joined |= {(la[i], lb[j]), (lb[j], la[i])}
                    out.append((na[i], nb[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def rarest(every: DataFrame, shared: DataFrame, p: Params) -> DataFrame:
    """Of every (node, n, shingle, ...) those by which a set meets all that it may be linked with: its rarest, as many as a link may leave out and one more. shared: (shingle, held) of those that sets share; the others are the rarest, and bring nothing together."""
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("held", "shingle"))
    lone = F.col("n") - F.count("*").over(own)
    may_miss = F.col("n") - F.ceil(F.col("n") * p.percent / 100)
    ranked = every.join(rekeyed(shared, "shingle"), "shingle").select(*every.columns, rank.alias("rank"), lone.alias("lone"))
    return ranked.filter(F.col("rank") + F.col("lone") <= may_miss + 1).drop("rank", "lone")


def small_keys(nodes: DataFrame, p: Params) -> DataFrame:
    """(node, band): the rarest shingles of sets of few."""
    every = nodes.filter("few is not null").select("node", "n", F.explode("few").alias("shingle"))
    shared = every.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    return rarest(every, shared, p).select("node", F.xxhash64(F.lit(p.seed), "shingle").alias("band"))


def undecided(grey: DataFrame, labels: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) across the components that grey pairs meet.

    Two sets that are linked share one of the rarest shingles of either; those of one component alone can't be shared
    across components, and come first in the order of rareness. Only sets that do share one with another component stay;
    a group is named by the least component of a shared shingle, has all that share such a one, and is compared by blocks.
    """
    named = lambda df, k: df.join(labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")), k, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", k))
    apart = written(named(named(grey, "a"), "b").filter("la <> lb").select(F.explode(F.array("la", "lb")).alias("label")).distinct(), "grey")
    member = labels.join(apart, "label", "left_semi").select("node", "label").unionByName(apart.select(F.col("label").alias("node"), "label")).distinct()
    member = written(member.join(sets, "node").dropDuplicates(["node"]).select("node", "label", "set"), "members")
    every = member.mapInArrow(_each_shingle, "node long, label long, n long, shingle long")
    ends = [F.count("*").alias("held"), F.min("label").alias("low"), F.max("label").alias("high")]
    across = every.groupBy("shingle").agg(*ends).filter("low <> high").select("shingle", "held")
    rare = written(rarest(every, across, p).select("shingle", "node", "label"), "rare")
    lists = rare.groupBy("shingle").agg(*ends).filter("low <> high").select("shingle", F.col("low").alias("group"))
    met = rare.join(rekeyed(lists, "shingle"), "shingle").select("node", "group").distinct()
    met = written(rekeyed(met, "node").join(member, "node").select("group", "node", "label", "set"), "met")
    count = met.groupBy("group").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    laid = rekeyed(met, "group").join(count, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = laid.withColumn("to", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = laid.withColumn("from", F.explode(F.sequence(F.lit(0), "block")))
    cols = [F.col(c).alias(c) for c in ("group", "node", "label", "set")]  # new columns: both sides come from one table
    left = left.select(*cols, F.col("block").alias("i"), F.col("to").alias("j"))
    right = right.select(*cols, F.col("from").alias("i"), F.col("block").alias("j"))
    return left.groupBy("group", "i", "j").cogroup(right.groupBy("group", "i", "j")).applyInPandas(_blocks(p.percent), "a long, b long")


def _meeting(left: DataFrame, turn: int) -> DataFrame:
    """Rows of buckets with more than one, each with its bucket's hub of this turn."""
    hub = left.groupBy("band").agg(F.min_by(F.struct("node", "n", "bits"), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    return written(left.join(rekeyed(hub.select("band", "hub"), "band"), "band"), "buckets")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of docs."""
    with batches_of(docs.sparkSession, p.block):
        return _near_duplicates(docs, text, key, p)


def _near_duplicates(docs: DataFrame, text: str, key: str, p: Params) -> DataFrame:
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    run, schema = _sketch(p)
    sketch = written(source.mapInArrow(run, schema), "sketch")
    nodes = sketch.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.first("few").alias("few"))
    nodes = written(nodes.filter("id is not null"), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("band")).unionByName(small_keys(nodes, p))
    often = keyed.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    met = keyed.join(rekeyed(often, "band"), "band").join(nodes.select("node", "id", "n", "bits"), "node")
    met = _meeting(met, 0)
    run, schema = _sets(p)
    sets = written(source.join(met.select("id").distinct(), "id").select("text").mapInArrow(run, schema), "sets")
    links = grey = None
    for turn in range(p.rounds):
        pair = [F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")]
        others = met.filter("node <> hub.node")
        fits = _alike(F.col("bits"), F.col("hub.bits"), p) & _sized(F.col("n"), F.col("hub.n"), p)
        done = written(measured(others.filter(fits).select(*pair).distinct(), sets), "measured")
        linked = done.filter(F.col("shared") * 100 >= F.col("together") * p.percent).select("a", "b").distinct()
        near = done.filter((F.col("shared") * 100 < F.col("together") * p.percent) & (F.col("shared") * 100 >= F.col("together") * (2 * p.percent - 100))).select("a", "b")
        links, grey = (linked, near) if links is None else (links.unionByName(linked), grey.unionByName(near))
        met = _meeting(others.select("band", "node", "n", "bits", *pair).join(linked, ["a", "b"], "left_anti").drop("a", "b"), turn + 1)
        if met.isEmpty():
            break
    else:
        grey = grey.unionByName(met.filter("node <> hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct())
    labels = written(components(links), "labels")
    more = written(undecided(grey.distinct(), labels, sets, p), "more")
    if not more.isEmpty():  # these join whole components, so that their labels alone are relabelled
        of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        above = written(components(ends).select(F.col("node").alias("label"), F.col("label").alias("least")), "above")
        lone = above.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("least").alias("label"))
        labels = written(labels.join(above, "label", "left").select("node", F.coalesce("least", "label").alias("label")).unionByName(lone), "labels")
    own = sketch.filter("node is not null").groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.groupBy("label").agg(F.min("id").alias("component_id"))
    named = own.join(least, "label").select("node", "component_id")
    out = sketch.select("id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least key stays. Rows with a null key stay; rows that repeat a key and text are one row."""
    kept = near_duplicates(docs.filter(F.col(key).isNotNull()), text, key, p).filter("kept").select(key).distinct()
    out = docs.join(kept, key, "left_semi")
    if not docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([key, text])
    return out.unionByName(docs.filter(F.col(key).isNull())).select(docs.columns)


def _alike(a: Column, b: Column, p: Params) -> Column:
    unlike = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(-(-p.values // 64))), F.lit(0))
    return unlike <= p.most_unlike(2 * p.percent - 100)


def _sized(a: Column, b: Column, p: Params) -> Column:
    """Whether sizes allow a Jaccard of one minus twice the allowed distance."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * (2 * p.percent - 100)


def op4_minmax_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), p=Params(width=2))
