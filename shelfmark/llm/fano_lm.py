"""Language-model scores from an Elias-Fano n-gram trie.

Tasks count the words, word pairs and, at order three, triples of their texts and send sorted blocks of counts, dealt over
buckets by the hash of the word or pair; a triple goes with its first two words. The successors of a context are dealt over
eight buckets, so that no word, however common, meets in one task. Each bucket becomes one memory-mapped file in the shared
folder: contexts as a monotone sequence, monotone pointers to their successors, successors spread over their context's range,
pointers from these pairs to third words, third words spread over their pair's, and quantised logarithms of discounted counts in
codebooks. A query finds its context, then its word by successor search in the context's range, then the next one in the
pair's. The model interpolates absolute discounting with add-one unigrams:

    p(w|v)   = max(c(vw) - D, 0) / c(v) + g(v) * (c(w) + 1) / (N + V + 1),
    p(w|u,v) = max(c(uvw) - D, 0) / c(uv) + g(uv) * p(w|v),   g the mass left; the first word of a text has p(w|v).

Null and empty texts are the end alone. Rows with a null id are trained on. Repeated rows count each time. With no
training rows all counts are 0. Words are lower-cased in A-Z; words and contexts are compared by 64-bit hashes, successors
of a context by 32 bits of them. Texts are scored whole, of any length: a long one costs in proportion to its words. Ties
don't arise: every text has its own score. `score` returns the keys and its results; other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_crc, shared_dir, table, written
from shelfmark.llm.elias_fano import EliasFano, packed, unpacked
from shelfmark.llm.textvec import mixed, words

END, BEGIN = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B52DCE729)
_S32, _LOW = np.uint64(32), np.uint64(2**32 - 1)
_STEP, _FLOOR, _WAYS, _MORE = 2048, -2.0, 8, 5


@dataclass(frozen=True)
class Params:
    """order: 2 has words and pairs, 3 triples too. least: pairs seen less often leave their mass to the words; at 1 none does, as order 3 needs it. docs_per_bucket: so many buckets are made. chunk: tokens that a task counts before it sends its counts on."""

    order: int = 2
    discount: float = 0.75
    least: int = 1
    docs_per_bucket: int = 2000
    chunk: int = 4_000_000

    def __post_init__(self):
        if self.order not in (2, 3) or (self.order == 3 and self.least > 1):
            raise ValueError("the order is 2 or 3, and triples need all pairs")


@dataclass(frozen=True)
class Model:
    """folder: of the files u-<bucket> (words), b-<bucket> (pairs, triples) and c-<bucket> (contexts of pairs)."""

    folder: str
    buckets: int
    tokens: int
    distinct: int
    p: Params


def put(uri: str, data: bytes) -> None:
    """Writes a file whole; a task that is run again replaces it by the same."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        temporary = f"{where.path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, where.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as f:
            f.write(data)


def mapped(uri: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; from a store that can't be mapped, through a temporary copy."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        return unpacked(np.memmap(where.path, np.int64, "r").view(np.ndarray))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as f:
        copy.write(f.read())
        copy.flush()
        return unpacked(np.memmap(copy, np.int64, "r").view(np.ndarray))


def tokens(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and ends of the documents in order, the token before each, and the offsets of the documents."""
    offsets = w.offsets + np.arange(len(w.offsets))
    out = np.empty(offsets[-1], np.uint64)
    ends = offsets[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = END, w.hashes
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[offsets[:-1]] = BEGIN
    return out, before, offsets


def placed(contexts: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts in order, and keys of pairs: their context's place among them, and 32 bits of the successor."""
    kinds, place = np.unique(contexts, return_inverse=True)
    return kinds, (place.astype(np.uint64) << _S32) | low


def relative(start: np.ndarray, fans: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Successors, by 32 bits, in the range [start, start + fans) of their context: evenly spread, however many one context has."""
    return (start.astype(np.uint64) << _S32) + low * fans.astype(np.uint64)


def spread(contexts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What pairs are dealt by: a context's successors go to eight buckets at most."""
    return mixed(contexts) + (low & np.uint64(_WAYS - 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def numbers(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def _blocks(kind: int, keys: np.ndarray, low: np.ndarray, count: np.ndarray, buckets: int, fans=None, third=None, third_count=None):
    """A row per bucket: its sorted words or contexts as differences, the successors of pairs, and their counts; of triples the number per pair, the third words, and their counts."""
    at = bucket_of(spread(keys, low) if kind else keys, buckets)
    order = np.argsort(at, kind="stable")
    keys, low, count, at = keys[order], low[order].astype(np.uint32), count[order].astype(np.uint32), at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    if fans is None:
        upto = np.zeros(len(keys) + 1, np.int64)
        fans, third, third_count = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    else:
        begin = (np.cumsum(fans) - fans)[order]
        fans = fans[order]
        upto = np.concatenate([[0], np.cumsum(fans)])
        at3 = np.repeat(begin - upto[:-1], fans) + np.arange(upto[-1])
        fans, third, third_count = fans.astype(np.uint32), third[at3], third_count[at3].astype(np.uint32)
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        x, y = upto[a], upto[b]
        steps = np.diff(keys[a:b], prepend=np.uint64(0))
        yield kind, int(at[a]), int(b - a), planes(steps), low[a:b].tobytes() if kind else b"", planes(count[a:b]), planes(fans[a:b]), third[x:y].tobytes(), planes(third_count[x:y])


def _unblock(n: int, keys: bytes, low: bytes, count: bytes, fans: bytes, third: bytes, third_count: bytes) -> tuple[np.ndarray, ...]:
    third = np.frombuffer(third, np.uint32).astype(np.uint64)
    return (
        np.cumsum(numbers(keys, n, np.uint64), dtype=np.uint64),
        np.frombuffer(low, np.uint32).astype(np.uint64),
        numbers(count, n, np.uint32).astype(np.int64),
        numbers(fans, n if fans else 0, np.uint32).astype(np.int64),
        third,
        numbers(third_count, len(third), np.uint32).astype(np.int64),
    )


def _summed(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, count = keys[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(count, starts) if len(keys) else count


def _counts(p: Params, buckets: int):
    names = ["kind", "bucket", "n", "keys", "successors", "counts", "fans", "thirds", "third_counts"]

    def run(batches):
        held, size = [], 0

        def pairs(own, before, first):
            contexts, pairs = placed(before, own >> _S32)
            if p.order == 2:
                keys, count = np.unique(pairs, return_counts=True)
                triples = ()
            else:
                keys, place, count = np.unique(pairs, return_inverse=True, return_counts=True)
                later = np.flatnonzero(~first)
                three, many = np.unique((place[later - 1].astype(np.uint64) << _S32) | (own[later] >> _S32), return_counts=True)
                triples = np.bincount((three >> _S32).astype(np.int64), minlength=len(keys)), (three & _LOW).astype(np.uint32), many
            return _blocks(1, contexts[(keys >> _S32).astype(np.int64)], keys & _LOW, count, buckets, *triples)

        def send():
            own, before, first = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keys, count = np.unique(own, return_counts=True)
            for blocks in (_blocks(0, keys, keys, count, buckets), pairs(own, before, first)):
                rows = list(zip(*blocks, strict=True))
                for a in range(0, len(rows[0]), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 256]) for c in rows], names=names)

        for batch in batches:
            for w in words(batch.column(0), lower=True):
                token, before, offsets = tokens(w)
                first = np.zeros(len(token), bool)
                first[offsets[:-1]] = True
                held.append((token, before, first))
                size += len(token)
                if size >= p.chunk:
                    yield from send()
                    size = 0
        if size:
            yield from send()

    return run, "kind long, bucket long, n long, keys binary, successors binary, counts binary, fans binary, thirds binary, third_counts binary"


def coded(x: np.ndarray) -> np.ndarray:
    return np.round((np.log10(np.maximum(x, 1e-2)) - _FLOOR) * _STEP).astype(np.uint16)


def decoded(x: np.ndarray) -> np.ndarray:
    return 10.0 ** (x.astype(np.float64) / _STEP + _FLOOR)


def booked(x: np.ndarray) -> list[np.ndarray]:
    """Coded values as a codebook and places in it."""
    book, place = np.unique(coded(x), return_inverse=True)
    return [book, place.astype(np.uint8 if len(book) <= 256 else np.uint16)]


def _level(folder: str, p: Params, buckets: int):
    """Writes a bucket's file; returns (kind, bucket, distinct, total, contexts, mass): of words the sums, of pairs the contexts, their number and mass, by bucket of contexts."""

    def run(key, frame):
        import pandas as pd

        kind, bucket = int(key[0]), int(key[1])
        names = ["n", "keys", "successors", "counts", "fans", "thirds", "third_counts"]
        parts = [_unblock(*row) for row in zip(*(frame[x] for x in names), strict=True)]
        keys, low, count, fans, third, third_count = (np.concatenate(x) for x in zip(*parts, strict=True))
        if kind:
            kinds, keys = placed(keys, low)
        sent = keys
        keys, count = _summed(keys, count)
        if kind == 0:
            put(f"{folder}/u-{bucket}", packed([*EliasFano.arrays(keys), *EliasFano.arrays(np.concatenate([[0], np.cumsum(count)]), _MORE)]))
            return pd.DataFrame({"kind": [0], "bucket": [bucket], "distinct": [len(keys)], "total": [int(count.sum())], "contexts": [b""], "mass": [b""]})
        often = count >= p.least
        keys, mass = keys[often], count[often] - p.discount
        context, start = np.unique(keys >> _S32, return_index=True)
        context = kinds[context.astype(np.int64)]
        own = np.diff([*start, len(keys)])
        successors = relative(np.repeat(start, own), np.repeat(own, own), keys & _LOW)
        arrays = [*EliasFano.arrays(context), *EliasFano.arrays(np.concatenate([start, [len(keys)]]), _MORE), *EliasFano.arrays(successors, 1), *booked(mass)]
        if p.order == 3:
            pair = np.repeat(np.searchsorted(keys, sent).astype(np.uint64), fans)
            three, many = _summed((pair << _S32) | third, third_count)
            own = np.bincount((three >> _S32).astype(np.int64), minlength=len(keys))
            start3 = np.concatenate([[0], np.cumsum(own)])
            three = relative(np.repeat(start3[:-1], own), np.repeat(own, own), three & _LOW)
            arrays += [*EliasFano.arrays(start3, 2), *EliasFano.arrays(three, 1), *booked(many - p.discount)]
        put(f"{folder}/b-{bucket}", packed(arrays))
        total = np.add.reduceat(mass, start) if len(start) else np.zeros(0)
        at = bucket_of(context, buckets)
        order = np.argsort(at, kind="stable")
        out = [(1, int(at[r[0]]), len(r), 0, planes(np.diff(context[r], prepend=np.uint64(0))), planes(total[r])) for r in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(r)]
        return pd.DataFrame(out or [(1, bucket, 0, 0, b"", b"")], columns=["kind", "bucket", "distinct", "total", "contexts", "mass"])

    return run, "kind long, bucket long, distinct long, total long, contexts binary, mass binary"


def _contexts(folder: str):
    def run(key, frame):
        import pandas as pd

        context = np.concatenate([np.cumsum(numbers(c, n, np.uint64), dtype=np.uint64) for c, n in zip(frame["contexts"], frame["distinct"], strict=True)])
        context, mass = _summed(context, np.concatenate([numbers(m, n, np.float64) for m, n in zip(frame["mass"], frame["distinct"], strict=True)]))
        put(f"{folder}/c-{int(key[0])}", packed([*EliasFano.arrays(context), coded(mass)]))
        return pd.DataFrame({"bucket": [int(key[0])], "n": [len(context)]})

    return run, "bucket long, n long"


def fit(docs: DataFrame, text: str = "text", p: Params = Params()) -> Model:
    """The model of all rows of docs."""
    spark = docs.sparkSession
    buckets = max(64, docs.count() // p.docs_per_bucket)
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    run, schema = _counts(p, buckets)
    blocks = docs.select(text).mapInArrow(run, schema)
    run, schema = _level(folder, p, buckets)
    levels = written(blocks.groupBy("kind", "bucket").applyInPandas(run, schema), "levels")
    run, schema = _contexts(folder)
    levels.filter("kind = 1").select("bucket", "distinct", "contexts", "mass").groupBy("bucket").applyInPandas(run, schema).agg(F.sum("n")).collect()
    n, v = levels.filter("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return Model(folder, buckets, n, v, p)


class Trie:
    """A model's files, opened as they are needed."""

    def __init__(self, model: Model, most_open: int = 2048):
        self.model, self.open, self.most = model, {}, most_open

    def file(self, kind: str, bucket: int):
        name = f"{kind}-{bucket}"
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open)))
            try:
                a = mapped(f"{self.model.folder}/{name}")
                self.open[name] = {"u": lambda: (EliasFano.of(*a[:5]), EliasFano.of(*a[5:10])), "b": lambda: (*self.level(a[:17], 3), *self.level(a[17:], 2)), "c": lambda: (EliasFano.of(*a[:5]), a[5])}[kind]()
            except FileNotFoundError:  # a bucket without n-grams has no file
                self.open[name] = None
        return self.open[name]

    @staticmethod
    def level(a: list[np.ndarray], n: int) -> tuple:
        """n sequences and a reader of discounted counts, if the file has the level."""
        return (*(EliasFano.of(*a[5 * k : 5 * k + 5]) for k in range(n)), lambda j: decoded(a[-2])[a[-1][j]]) if a else ()

    def by_bucket(self, kind: str, at: np.ndarray):
        order = np.argsort(at.astype(np.uint16) if self.model.buckets <= 1 << 16 else at, kind="stable")
        cut = np.flatnonzero(np.diff(at[order])) + 1
        for rows in np.split(order, cut) if len(at) else ():
            if f := self.file(kind, int(at[rows[0]])):
                yield rows, f

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for rows, (hashes, upto) in self.by_bucket("u", bucket_of(keys, self.model.buckets)):
            i = hashes.find(keys[rows])
            rows, i = rows[i >= 0], i[i >= 0]
            a, b = upto.span(i)
            out[rows] = b - a
        return out

    def pairs(self, before: np.ndarray, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of contexts and 32 bits of successors in the buckets `at`: discounted counts (0: not there), and, at order three, where their third words start in the bucket and how many differ."""
        out, start, fans = np.zeros(len(before)), np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
        for rows, (contexts, pointers, successors, mass, *third) in self.by_bucket("b", at):
            own = before[rows]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            times = np.diff([*first, len(own)])
            i = contexts.find(own[first])
            rows, i, times = rows[np.repeat(i >= 0, times)], i[i >= 0], times[i >= 0]
            a, b = pointers.span(i)
            j = successors.find(relative(np.repeat(a, times), np.repeat(b - a, times), low[rows]))
            rows, j = rows[j >= 0], j[j >= 0]
            out[rows] = mass(j)
            if third:
                start[rows], end = third[0].span(j)
                fans[rows] = end - start[rows]
        return out, start, fans

    def triples(self, first: np.ndarray, fans: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Discounted counts of third words, by 32 bits of them, where those of their pair start in the buckets `at` and how many differ."""
        out = np.zeros(len(first))
        for rows, (*_, successors, mass) in self.by_bucket("b", at):
            j = successors.find(relative(first[rows], fans[rows], low[rows]))
            out[rows[j >= 0]] = mass(j[j >= 0])
        return out

    def masses(self, keys: np.ndarray) -> np.ndarray:
        """Discounted mass of contexts."""
        out = np.zeros(len(keys))
        for rows, (contexts, mass) in self.by_bucket("c", bucket_of(keys, self.model.buckets)):
            i = contexts.find(keys[rows])
            out[rows[i >= 0]] = decoded(mass[i[i >= 0]])
        return out

    def scores(self, token: np.ndarray, before: np.ndarray, offsets: np.ndarray, docs: int):
        """(known tokens, base score, score by pairs, at order three score by triples) of documents. docs: training documents, the count of the context of first words."""
        m, start = self.model, offsets[:-1]
        kinds, which = np.unique(np.concatenate([token, before[start]]), return_inverse=True)
        count = self.counts(kinds)
        of_context = np.where(kinds == BEGIN, docs, count).astype(np.float64)
        left = np.where(of_context > 0, 1 - np.minimum(self.masses(kinds) / np.maximum(of_context, 1), 1 - 1e-6), 1.0)
        t = which[: len(token)]
        b = np.empty_like(t)
        b[1:], b[start] = t[:-1], which[len(token) :]
        keys, back = np.unique((b.astype(np.uint64) << _S32) | (token >> _S32), return_inverse=True)
        context, low = kinds[(keys >> _S32).astype(np.int64)], keys & _LOW
        at = bucket_of(spread(context, low), m.buckets)
        seen, first, fans = self.pairs(context, low, at)
        p = seen[back] / np.maximum(of_context[b], 1) + left[b] * (count[t] + 1) / (m.tokens + m.distinct + 1)
        base = np.log10((count + 1) / (m.tokens + 1 * (m.distinct + 1)))
        out = [(count[t] > 0).astype(np.int64), base[t], np.log10(np.minimum(p, 1.0))]
        if m.p.order == 3:
            later = np.ones(len(token), bool)
            later[start] = False
            later = np.flatnonzero(later)
            pair = back[later - 1]
            later, pair = later[fans[pair] > 0], pair[fans[pair] > 0]
            order = np.argsort(pair)
            later, pair = later[order], pair[order]
            of_pair = np.round(seen[pair] + m.p.discount)
            three = self.triples(first[pair], fans[pair], token[later] >> _S32, at[pair])
            p[later] = (three + m.p.discount * fans[pair] * p[later]) / of_pair
            out.append(np.log10(np.minimum(p, 1.0)))
        return tuple(np.add.reduceat(x, start) for x in out)


def score(docs: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys of docs with n_tokens, n_known, base_score, score (by words and pairs) and, at order three, score_3 (by triples too)."""
    kinds = dict(docs.dtypes)
    names = ["n_tokens", "n_known", "base_score", "score", "score_3"][: model.p.order + 2]

    def run(batches):
        trie = Trie(model)
        ends = int(trie.counts(np.array([END]))[0])
        for batch in batches:
            *rest, column = batch.columns
            for w in words(column, lower=True):
                token, before, offsets = tokens(w)
                found = trie.scores(token, before, offsets, ends)
                yield pa.RecordBatch.from_arrays([*[r.slice(w.first, w.docs) for r in rest], pa.array(np.diff(offsets)), *map(pa.array, found)], names=[*keys, *names])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{n} {'long' if n[0] == 'n' else 'double'}" for n in names]]))


def op5_fano_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc("doc_id", 7) == 2, F.lit(False))
    model = fit(docs.filter(~held_out), p=Params(order=3))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "score_3")
