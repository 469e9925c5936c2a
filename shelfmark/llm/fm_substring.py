"""Repeated passages by compressed FM-indexes, one per shard.

Every window of consecutive words belongs to the segment of windows around its minimizer, the least hash of the shorter
word runs in it; equal windows have equal minimizers, so a minimizer's segments can be judged apart from all others.
Segments of minimizers that occur once can't repeat and are never sent. The rest are dealt by minimizer over shards, one
of each content with its number of copies. A shard's segments make a Burrows-Wheeler transform in a wavelet matrix; the
segments are streamed through it from right to left by backward search, a bounded matching statistic at a time, and
windows with two occurrences or more are reported.

A minimizer with more than `crowded` different segments would make a shard too large. Its windows are cut again by a
second order, which puts runs in the slots of crowded minimizers last (a bit per slot, of a fixed number of slots): then
a window that only touches a common passage goes by a run of its own. What is crowded by this order too is dealt and
counted by the windows' own hashes, so that any passage may be as common as it likes.

Null and empty texts, and texts with fewer words than a window, lose nothing. Equal texts are one text with a weight.
Repeated ids and rows are allowed, and any length of text: a long one costs in proportion to its words. Other columns are
not looked at, whatever their names; empty tables give empty results. Words are compared by 64-bit hashes, segments and
windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import forget, table, written
from shelfmark.llm.textvec import Words, mixed, raw, words

_A = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """run: words of a minimizer; any number up to the window is exact, and one that seldom recurs by chance leaves few candidates. shard: segments of a shard on average. slots: bits of the filter of crowded minimizers, a power of two."""

    window: int = 35
    run: int = 16
    crowded: int = 2048
    shard: int = 2048
    slots: int = 1 << 18


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` consecutive words at every position; the last width - 1 are of no use."""
    out, have, part, size = None, 0, h, 1
    while True:
        if width & size:
            moved = part if not have else _ahead(part, have)
            out = part.copy() if out is None else mixed(out * _A + moved)
            have += size
        if have == width:
            return out
        part = mixed(part * _A + _ahead(part, size))
        size *= 2


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-by or None] = x[by:] if by < len(x) else x[:0].sum()
    return out


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x over each `width` positions."""
    part, size = x, 1
    while 2 * size <= width:
        part, size = np.minimum(part, _ahead(part, size)), 2 * size
    return part if size == width else np.minimum(part, _ahead(part, width - size))


def names_of(h: np.ndarray, start: np.ndarray, width: np.ndarray, minimizer: np.ndarray) -> np.ndarray:
    """A 64-bit key of each run h[start:start+width] and its minimizer, from running sums of a polynomial in the hashes."""
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 2**64))
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(h), x)])) for x in (base, back))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    own = (sums[start + width] - sums[start]) * down[start]
    return mixed(mixed(own) * _A + mixed(minimizer ^ mixed(width.astype(np.uint64))))


def segments(w: Words, p: Params, some: np.ndarray | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """First window, number of windows, minimizer, weight and name of each segment; the weight is 2 if its minimizer recurs in it.

    some: the windows to look at, all if None. common: a bit per slot; runs in a slot that is set become minimizers only
    where a window has no other run.
    """
    n, none = len(w.hashes), np.zeros(0, np.int64)
    if n < p.window:
        return none, none, none.view(np.uint64), none, none.view(np.uint64)
    grams = runs(w.hashes, p.run)
    if common is not None:
        grams = (grams >> np.uint64(1)) | (common[(grams & np.uint64(p.slots - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
    low = least(grams, p.window - p.run + 1)
    valid = np.arange(n) + p.window <= np.repeat(w.offsets[1:], w.lengths())
    if some is not None:
        valid &= some
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return none, none, none.view(np.uint64), none, none.view(np.uint64)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | begins[1:]
    count = np.flatnonzero(stop) + 1 - first
    value = low[first]
    width = count + p.window - p.run
    same = np.add.reduceat((grams[_spread(first, width)] == np.repeat(value, width)).astype(np.int64), np.concatenate([[0], np.cumsum(width)[:-1]]))
    return first, count, value, np.minimum(same, 2), names_of(w.hashes, first, count + p.window - 1, value)


def _spread(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(width)
    return np.repeat(start - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)


class WaveletMatrix:
    """Symbols of a sequence by bit planes, with counts of ones per 64 positions."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.planes, now = levels, [], symbols
        for level in range(levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int64)
            self.planes.append((packed, ones, len(bit) - int(bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """How often the symbols occur before the positions, counted from the place of the symbol's own first occurrence."""
        at = list(positions)
        for level, (packed, ones, zeros) in zip(range(self.levels - 1, -1, -1), self.planes, strict=True):
            set_ = ((symbol >> level) & 1).astype(bool)
            for k, pos in enumerate(at):
                word = pos >> 6
                one = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)))
                at[k] = np.where(set_, zeros + one, pos - one)
        return at


class FMIndex:
    """Of sequences of symbols 1..; weights: of the sequences. 0 ends each sequence."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, window: int):
        self.window = window
        text = np.concatenate([x for s in sequences for x in (s, np.zeros(1, np.int64))])
        n = len(text)
        rank, kept, width = text, {}, 1
        kept[1] = rank
        while True:
            ahead = np.zeros(n, np.int64)
            if width < n:
                ahead[:-width] = rank[width:]
            order = np.argsort(rank * (n + 1) + ahead, kind="stable")
            key = (rank * (n + 1) + ahead)[order]
            new = np.zeros(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank, width = new + 1, 2 * width
            kept[width] = rank
            if width > window or rank.max() == n:
                break
        self.order = order
        suffixes = order
        back = text[suffixes - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.matrix = WaveletMatrix(back, self.levels)
        count = np.bincount(text, minlength=int(text.max()) + 2)
        self.before = np.concatenate([[0], np.cumsum(count)])
        symbols = np.arange(int(text.max()) + 1)
        self.origin = self.matrix.rank(symbols, np.zeros(len(symbols), np.int64))[0]
        # suffixes alike in all but the last word of a window stand together: where their group begins and ends
        shared, have, differ = window - 1, 0, np.zeros(n, bool)
        while have < shared:
            size = max(k for k in kept if k <= shared - have)
            at = suffixes + have
            part = np.where(at < n, kept[size][np.minimum(at, n - 1)], -at)
            differ[1:] |= part[1:] != part[:-1]
            have += size
        differ[0] = True
        starts = np.flatnonzero(differ)
        group = np.cumsum(differ) - 1
        self.low, self.high = starts[group], np.append(starts[1:], n)[group]
        each = np.repeat(weights, [len(s) + 1 for s in sequences])
        self.weight = np.concatenate([[0], np.cumsum(each[suffixes])])
        self.size = n

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.matrix.rank(symbol, lo, hi)
        shift = self.before[symbol] - self.origin[symbol]
        return lo + shift, hi + shift

    def occurrences(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Of every window of the streamed sequences, its weight in the index; matches are followed up to the window's length."""
        length = np.array([len(s) for s in sequences])
        out = [np.zeros(max(0, m - self.window + 1), np.int64) for m in length]
        order = np.argsort(-length, kind="stable")
        width = int(length.max(initial=0))
        table_ = np.zeros((len(sequences), width), np.int64)
        for r, k in enumerate(order):
            table_[r, : length[k]] = sequences[k][::-1]  # column t: the t-th word from the right
        sorted_length = length[order]
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.size)
        weights = np.zeros((len(order), max(0, width - self.window + 1)), np.int64)
        for t in range(width):
            live = int(np.searchsorted(-sorted_length, -t, "left"))
            if t >= self.window:  # the interval is of a whole window: give up its last word first
                some = hi[:live] > lo[:live]
                at = np.minimum(lo[:live], self.size - 1)
                lo[:live], hi[:live] = np.where(some, self.low[at], 0), np.where(some, self.high[at], 0)
            lo[:live], hi[:live] = self.back(table_[:live, t], lo[:live], hi[:live])
            if t >= self.window - 1:
                weights[:live, t - self.window + 1] = self.weight[hi[:live]] - self.weight[lo[:live]]
        for r, k in enumerate(order):
            m = len(out[k])
            out[k][:] = weights[r, :m][::-1]
        return out


def repeated_windows(sequences: list[np.ndarray], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each sequence of word hashes, which windows have a weight of 2 or more in all sequences together."""
    _, ids = np.unique(np.concatenate(sequences), return_inverse=True)
    ids = np.split(ids.astype(np.int64) + 1, np.cumsum([len(s) for s in sequences])[:-1])
    return [n >= 2 for n in FMIndex(ids, weights, window).occurrences(ids)]


_SEGMENT = {"minimizer": (pa.int64(), "long"), "first": (pa.int32(), "int"), "windows": (pa.int32(), "int"), "weight": (pa.int8(), "tinyint"), "name": (pa.int64(), "long")}


def _columns(found: tuple[np.ndarray, ...], w: Words) -> list[np.ndarray]:
    """Segments in the order of _SEGMENT, first counted from the document's start."""
    first, count, value, weight, name = found
    local = first - w.offsets[np.searchsorted(w.offsets, first, "right") - 1]
    return [value.view(np.int64), local.astype(np.int32), count.astype(np.int32), weight.astype(np.int8), name.view(np.int64)]


def _scan(p: Params):
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string()), *[(n, pa.list_(k)) for n, (k, _) in _SEGMENT.items()]])

    def run(batches):
        for batch in batches:
            data, at = raw(batch.column(3))
            for w in words(batch.column(3)):
                found = segments(w, p)
                each = pa.array(np.searchsorted(found[0], w.offsets).astype(np.int32))
                whole = [hashlib.sha256(b" ".join(data[at[w.first + d] : at[w.first + d + 1]].tobytes().split())).hexdigest() for d in range(w.docs)]
                head = [batch.column(k).slice(w.first, w.docs) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(w.lengths()), pa.array(whole), *[pa.ListArray.from_arrays(each, pa.array(x)) for x in _columns(found, w)]], schema=schema)

    return run, "id long, k1 long, k2 long, n_words long, whole string, " + ", ".join(f"{n} array<{k}>" for n, (_, k) in _SEGMENT.items())


def _listed(batch):
    """For some documents of a batch at a time: their words, the rows and word offsets of the segments, and the segments' fields."""
    cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    lists = cols["segments"]
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    flat = lists.flatten()
    fields = {flat.type.field(k).name: flat.field(k).to_numpy() for k in range(flat.type.num_fields)}
    for w in words(cols["text"]):
        part = slice(ends[w.first], ends[w.first + w.docs])
        doc = np.repeat(np.arange(w.docs), np.diff(ends[w.first : w.first + w.docs + 1]))
        yield w, w.first + doc, w.offsets[doc] + fields["first"][part], {n: x[part] for n, x in fields.items()}


def _again(p: Params, common: np.ndarray):
    """The windows of the listed segments, in segments by rarer minimizers."""
    head = ["k1", "id0", "copies"]

    def run(batches):
        for batch in batches:
            for w, _, start, f in _listed(batch):
                some = np.zeros(len(w.hashes), bool)
                some[_spread(start, f["windows"])] = True
                found = segments(w, p, some, common)
                row = pa.array(w.first + np.searchsorted(w.offsets, found[0], "right") - 1)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(row) for n in head], *[pa.array(x) for x in _columns(found, w)]], names=[*head, *_SEGMENT])

    return run, "k1 long, id0 long, copies long, " + ", ".join(f"{n} {k}" for n, (_, k) in _SEGMENT.items())


def _contents(p: Params):
    """(name, minimizer, weight, content) of the listed segments; content: word hashes."""

    def run(batches):
        for batch in batches:
            for w, _, start, f in _listed(batch):
                width = f["windows"].astype(np.int64) + p.window - 1
                ends = np.concatenate([[0], np.cumsum(width)])
                for a in range(0, len(start), 20_000):
                    b = min(len(start), a + 20_000)
                    content = w.hashes[_spread(start[a:b], width[a:b])].tobytes()
                    offsets = ((ends[a : b + 1] - ends[a]) * 8).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*[pa.array(f[n][a:b]) for n in ("name", "minimizer", "weight")], pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(content)])], names=["name", "minimizer", "weight", "content"])

    return run, "name long, minimizer long, weight long, content binary"


def _single(p: Params):
    """(hash, check, k1, id0, first, weight) of every window of the listed segments; hash and check are its 128 bits."""
    head = ["k1", "id0", "copies"]

    def run(batches):
        for batch in batches:
            for w, row, start, f in _listed(batch):
                long = len(w.hashes) >= p.window
                own, check = (runs(h, p.window).view(np.int64) if long else np.zeros(0, np.int64) for h in (w.hashes, mixed(w.hashes ^ _A)))
                at = _spread(start, f["windows"])
                rows = pa.array(np.repeat(row, f["windows"]))
                k1, id0, weight = (batch.column(n).take(rows) for n in head)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(check[at]), k1, id0, pa.array(_spread(f["first"].astype(np.int64), f["windows"])), weight], names=["hash", "check", "k1", "id0", "first", "weight"])

    return run, "hash long, check long, k1 long, id0 long, first long, weight long"


def _shard(p: Params):
    def run(frame):
        import pandas as pd

        sequences = [np.frombuffer(x, np.uint64) for x in frame["content"]]
        marks = repeated_windows(sequences, frame["weight"].to_numpy(np.int64), p.window)
        some = [k for k, m in enumerate(marks) if m.any()]
        return pd.DataFrame({"name": frame["name"].to_numpy()[some], "minimizer": frame["minimizer"].to_numpy()[some], "marks": [np.packbits(marks[k]).tobytes() for k in some]})

    return run


def _removed(p: Params):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for batch in batches:
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            gone, sha = [], []
            for text, found in zip(cols["text"], cols["found"], strict=True):
                parts = (text.as_py() or "").encode().split()
                cover = np.zeros(len(parts) + 1, np.int64)
                for f in found.as_py():
                    at = f["first"] + (np.flatnonzero(np.unpackbits(np.frombuffer(f["marks"], np.uint8))) if f["marks"] is not None else np.zeros(1, np.int64))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + p.window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                gone.append(int((~keep).sum()))
                sha.append(hashlib.sha256(b" ".join([parts[k] for k in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_arrays([cols["k1"], cols["k2"], pa.array(gone, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    return run, "k1 long, k2 long, n_removed long, kept string"


def crowded(found: DataFrame, p: Params) -> DataFrame:
    """Minimizers with so many different segments that their shard would be too large."""
    return written(found.groupBy("minimizer").agg(F.countDistinct("name").alias("n")).filter(F.col("n") > p.crowded).select("minimizer"), "crowded")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row of docs."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    source = source.select("id", F.coalesce("id", F.lit(-(2**63))).alias("id0"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("k2"), "text").alias("k2"), "text")
    one_text = ["k1", "id0"]

    def with_text(of: DataFrame) -> DataFrame:
        return source.drop("id").join(of, one_text).dropDuplicates(one_text)

    run, schema = _scan(p)
    scan = written(source.select("id", "k1", "k2", "text").mapInArrow(run, schema), "scan").withColumn("id0", F.coalesce("id", F.lit(-(2**63))))
    classes = scan.filter(F.size("minimizer") > 0).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id0").alias("id0"))
    flat = lambda df, *more: df.select(*more, F.explode(F.arrays_zip(*_SEGMENT)).alias("s")).select(*more, "s.*")
    often = flat(scan).groupBy("minimizer").agg(F.sum("weight").alias("n")).filter("n > 1").select("minimizer")
    one = scan.select("k2", *one_text, *_SEGMENT).join(classes, ["k2", *one_text]).dropDuplicates(["k2", *one_text])
    found = written(flat(one, *one_text, "copies").join(often, "minimizer"), "candidates")
    dense = crowded(found, p)
    slots = dense.select(F.col("minimizer").bitwiseAND(F.lit(p.slots - 1)).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
    if len(slots):
        common = np.zeros(p.slots, bool)
        common[slots] = True
        listed = found.join(dense, "minimizer").groupBy(*one_text, "copies").agg(F.collect_list(F.struct("first", "windows")).alias("segments"))
        run, schema = _again(p, common)
        again = written(with_text(listed).mapInArrow(run, schema), "again")
        more = again.groupBy("minimizer").agg(F.sum(F.col("weight") * F.col("copies")).alias("n")).filter("n > 1").select("minimizer")
        rarer = written(found.join(dense, "minimizer", "left_anti").unionByName(again.join(more, "minimizer")), "candidates")
        forget(found, again, dense)
        found, dense = rarer, crowded(rarer, p)
    settled = found.join(dense, "minimizer", "left_anti")
    names = settled.groupBy("name", "minimizer").agg(F.sum("copies").alias("weight"), F.min(F.struct(*one_text, "first", "windows")).alias("at"))
    names = written(names.select("name", "minimizer", "weight", "at.*"), "names")
    listed = names.groupBy(*one_text).agg(F.collect_list(F.struct("first", "windows", "name", "minimizer", "weight")).alias("segments"))
    run, schema = _contents(p)
    shards = max(1, -(-names.count() // p.shard))
    shard = F.pmod(F.xxhash64("minimizer"), F.lit(shards))
    marked = with_text(listed).mapInArrow(run, schema).withColumn("shard", shard).groupBy("shard").applyInPandas(_shard(p), "name long, minimizer long, marks binary")
    marked = written(marked, "marks")
    forget(names)
    met = settled.join(marked, ["name", "minimizer"]).select(*one_text, "first", "marks")
    if not dense.isEmpty():
        listed = found.join(dense, "minimizer").groupBy(*one_text, "copies").agg(F.collect_list(F.struct("first", "windows")).alias("segments"))
        run, schema = _single(p)
        lone = with_text(listed).mapInArrow(run, schema)
        twice = lone.groupBy("hash", "check").agg(F.sum("weight").alias("n")).filter("n > 1").select("hash", "check")
        met = met.unionByName(lone.join(twice, ["hash", "check"]).select(*one_text, F.col("first").cast("int").alias("first"), F.lit(None).cast("binary").alias("marks")))
    per_text = met.groupBy(*one_text).agg(F.collect_list(F.struct("first", "marks")).alias("found"))
    run, schema = _removed(p)
    result = with_text(per_text).select("k1", "k2", "text", "found").mapInArrow(run, schema)
    out = scan.select("id", "k1", "k2", "n_words", "whole").join(result, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def op10_fm_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
