"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds all languages bit-sliced: a slot is a bitmask of languages, so that one AND over an n-gram's slots
returns every language that contains it. A text's popcount per language, corrected for that language's false-positive
rate, decides.

N-grams are four bytes of the text with ASCII letters lower-cased and other ASCII characters as spaces, padded by spaces.
A language's n-grams are those with at least `rate` of its n-grams in the training texts, hence at most 1 / rate. The
filter is fitted on at most `per_language` distinct labelled texts a language (in expectation, chosen by a hash of the
text), and all their copies.

Null texts and texts without a letter get `und` and score 0; so does every text if no language was learned. Ties go to
the language with more training texts, then to the first in order. Repeated rows get equal results. Whole texts
are read, of any length; empty tables give an empty filter and empty results. `identify` returns the keys and its results,
`with_language` keeps every column; other columns are not looked at, whatever their names. A language is a bit of every
slot, so that the filter grows with the number of languages that the labels name, which must fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_crc, table
from shelfmark.llm.textvec import mixed, raw

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Params:
    per_language: int = 5000
    rate: float = 1e-5
    hashes: int = 3
    slots_per_gram: int = 12


@dataclass(frozen=True)
class Filter:
    """slots: [n, words of 64 languages at most]; false: each language's false-positive rate; prior: the share of its training texts."""

    languages: tuple[str, ...]
    slots: np.ndarray
    hashes: int
    false: np.ndarray
    prior: np.ndarray


def grams(column, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, offsets, n-grams) for some documents at a time. Runs of spaces count once."""
    data, at = raw(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1))
        part = _FOLD[data[at[first] : at[last]]]
        bounds = at[first : last + 1] - at[first]
        text = np.insert(part, np.repeat(bounds[:-1], 1), 32) if len(part) else np.full(last - first, 32, np.uint8)
        bounds = bounds + np.arange(len(bounds))
        keep = (text != 32) | (np.concatenate([[0], text[:-1]]) != 32)
        keep[bounds[:-1]] = True
        ends = np.concatenate([[0], np.cumsum(keep)])[bounds]
        text = np.concatenate([text[keep], np.full(4, 32, np.uint8)])
        four = np.ndarray((len(text) - 4,), np.dtype("<u4"), buffer=text.data, strides=(1,)).copy()
        # the last three of a document would run into the next: their rest counts as spaces
        for back in (1, 2, 3):
            pos = ends[1:] - back
            pos = pos[pos >= ends[:-1]]
            four[pos] = (four[pos] & np.uint32((1 << (8 * back)) - 1)) | np.uint32(0x20202020 & ~((1 << (8 * back)) - 1))
        yield first, ends, four
        first = last


def _count(batches):
    for batch in batches:
        language = np.array(batch.column(1).to_pylist(), object)
        for first, ends, four in grams(batch.column(0)):
            own = language[first : first + len(ends) - 1]
            for name in sorted(set(own)):
                pick = np.repeat(own == name, np.diff(ends))
                gram, count = np.unique(four[pick], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])


def _places(gram: np.ndarray, hashes: int, size: int) -> Iterator[np.ndarray]:
    h = mixed(gram.astype(np.uint64) + np.uint64(1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", p: Params = Params()) -> Filter:
    """The filter of the languages of labelled rows; rows with a null language or text are left out."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    copies = rows.select("lang", F.xxhash64("text").alias("h")).groupBy("lang", "h").agg(F.count("*").alias("n"))
    sizes = copies.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    share, texts = {r["lang"]: r["n"] for r in sizes}, {r["lang"]: r["texts"] for r in sizes}
    if not share:
        return Filter((), np.zeros((1, 1), np.uint8), p.hashes, np.zeros(0), np.zeros(0))
    languages = tuple(sorted(share))
    limits = F.create_map(*[F.lit(x) for k in languages for x in (k, int(2**31 * min(1.0, p.per_language / texts[k])))])
    taken = rows.filter(F.pmod(F.xxhash64("text"), F.lit(2**31)) < limits[F.col("lang")])
    counts = taken.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counts.join(F.broadcast(totals), "lang").filter((F.col("n") >= F.col("total") * p.rate) & (F.col("n") > 1)).select("lang", "gram").toPandas()
    all_grams = np.unique(often["gram"].to_numpy(np.int64))
    size = 1 << max(10, int(np.ceil(np.log2(max(1, len(all_grams)) * p.slots_per_gram))))
    words = -(-len(languages) // 64)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((size, words), kind)
    false = np.zeros(len(languages))
    for k, name in enumerate(languages):
        gram = often.loc[often["lang"] == name, "gram"].to_numpy(np.int64)
        for place in _places(gram, p.hashes, size):
            slots[place, k // 64] |= kind(1 << (k % 64))
        false[k] = ((slots[:, k // 64] >> kind(k % 64)) & kind(1)).mean() ** p.hashes
    return Filter(languages, slots, p.hashes, false, np.array([share[k] for k in languages]) / sum(share.values()))


def popcounts(f: Filter, four: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[documents, languages] n-grams that each language contains, corrected for false positives, as a share of all."""
    n = np.diff(ends)
    found = None
    for place in _places(four, f.hashes, len(f.slots)):
        found = f.slots[place] if found is None else found & f.slots[place]
    kind, out, some = f.slots.dtype.type, np.zeros((len(n), len(f.languages))), n > 0
    if found is not None and some.any():
        at = ends[:-1][some]
        for k in range(len(f.languages)):
            out[some, k] = np.add.reduceat(((found[:, k // 64] >> kind(k % 64)) & kind(1)).astype(np.int64), at)
    share = out / np.maximum(n, 1)[:, None]
    return np.clip((share - f.false) / (1 - f.false), 0, 1)


def identify(docs: DataFrame, f: Filter, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys of docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(f)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keys, F.when(letters, F.col(text)).alias("__text"))

    def run(batches):
        own = sent.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            *rest, column = batch.columns
            lettered = np.asarray(column.is_valid())
            pred, score = np.full(len(column), len(own.languages)), np.zeros(len(column))
            if own.languages:
                for first, ends, four in grams(column):
                    got = popcounts(own, four, ends)
                    best = np.argmax(got + 1e-12 * own.prior, axis=1)
                    at = slice(first, first + len(best))
                    pred[at], score[at] = best, got[np.arange(len(best)), best]
            pred[~lettered], score[~lettered] = len(own.languages), 0
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[pred], pa.string()), pa.array(score)], names=[*keys, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "lang_pred string", "score double"]))


def with_language(docs: DataFrame, f: Filter, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs whose text is in one of the filter's languages: identified, with a score of at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(f)
    at = docs.columns.index(text)

    def run(batches):
        own = sent.value
        for batch in batches:
            column = batch.column(at)
            keep = np.zeros(len(column), bool)
            if own.languages:
                for first, ends, four in grams(column):
                    keep[first : first + len(ends) - 1] = popcounts(own, four, ends).max(axis=1) >= least
            yield batch.filter(pa.array(keep))

    return docs.filter(F.col(text).rlike(r"\p{L}")).mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce(id_crc("doc_id", 4) == 2, F.lit(False)))


def op2_language_bitmask(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    f = fit(training_rows(docs.select("doc_id", "text", "lang")))
    out = identify(docs, f)
    return out.select("doc_id", F.coalesce(id_crc("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
