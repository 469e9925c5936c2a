"""SentencePiece segmentations sampled by forward filtering and backward sampling, and lossless decoding.

The pieces of a public model make a lattice over the text's bytes, with a space where a piece has its space mark. Scores
of pieces fall with their rank in the vocabulary; bytes are pieces of last resort, so every text has a segmentation.
Forward filtering sums the segmentations up to every position; backward sampling draws pieces from the end, with random
numbers that depend on the seed, the row's key, the place in the text and the step only, so that any run on any number
of machines draws the same. Decoding joins the pieces' bytes and gives the text back exactly.

The lattice is cut only where no piece of the vocabulary crosses: before spaces that follow other characters, around line
ends, and in stretches of over `longest` bytes at places that no piece spans. Every segmentation of the whole text is thus
one of its chunks', with the same probability; equal chunks are filtered once and sampled separately.

Null texts have null pieces, empty texts none. A null key is a key of its own; rows with equal keys and texts get equal
segmentations. Texts of any length are encoded whole; a stretch that pieces span everywhere is one chunk, and costs in
proportion to its length. Other columns are not looked at, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.textvec import hashed, mixed, raw

#: The folder of public tokenizer files; a parameter of every function that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_P = np.uint64(0x100000001B3)
#: Shares and random numbers are whole multiples of one part in this.
_UNIT = 2**40


@dataclass(frozen=True)
class Params:
    """flat: 1 samples in proportion to the scores' products, less flattens them. byte_score: natural logarithm of a byte's probability. longest: bytes of a stretch from which on it is cut where pieces allow it."""

    model: str = MODEL
    seed: int = 1
    flat: float = 1.0
    byte_score: float = -14.0
    longest: int = 40


@dataclass(frozen=True)
class Vocabulary:
    """Keys of pieces in order with their ids and probabilities, a bit table of the keys and one of the keys of what longer pieces begin with, the bytes of the longest piece, and each id's bytes."""

    keys: np.ndarray
    ids: np.ndarray
    probability: np.ndarray
    bits: np.ndarray
    begins: np.ndarray
    longest_piece: int
    bytes_: np.ndarray
    offsets: np.ndarray
    byte_ids: np.ndarray
    byte_probability: float


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(p: Params) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=p.model)
    table_, keys, ids, byte_ids, begun, longest_piece = [], [], [], np.zeros(256, np.int64), set(), 0
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            table_.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            table_.append(b"")
        else:
            data = piece.replace("▁", " ").encode()
            table_.append(data)
            longest_piece = max(longest_piece, len(data))
            k = 0
            for b in data:
                begun.add(k)
                k = (k * int(_P) + b + 1) % 2**64
            keys.append(k)
            ids.append(i)
    keys, ids = np.array(keys, np.uint64), np.array(ids)
    rank = np.empty(len(ids))
    rank[np.argsort([-model.get_score(int(i)) for i in ids], kind="stable")] = np.arange(len(ids))
    mass = (1.0 / (rank + 10.0)) ** p.flat
    order = np.argsort(keys)
    bits = np.zeros(1 << 21, bool)
    bits[_slot(keys)] = True
    begins = np.zeros(1 << 21, bool)
    begins[_slot(np.array(sorted(begun), np.uint64))] = True
    return Vocabulary(keys[order], ids[order], (mass / mass.sum())[order], bits, begins, longest_piece, np.frombuffer(b"".join(table_), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table_])]), byte_ids, float(np.exp(p.byte_score)))


def longest_pieces(data: np.ndarray, at: np.ndarray, left: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Bytes of the longest piece at each of the places; left: bytes that it may have."""
    out, live, key = np.ones(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.uint64)
    for k in range(v.longest_piece):
        some = (left[live] > k) & v.begins[_slot(key)]
        live, key = live[some], key[some]
        if not len(live):
            break
        key = key * _P + data[at[live] + k] + np.uint64(1)
        hit = np.flatnonzero(v.bits[_slot(key)])
        hit = hit[v.keys[np.minimum(np.searchsorted(v.keys, key[hit]), len(v.keys) - 1)] == key[hit]]
        out[live[hit]] = k + 1
    return out


def chunks(data: np.ndarray, bounds: np.ndarray, longest: int, v: Vocabulary) -> np.ndarray:
    """Starts of chunks, bounds included; data holds the documents between the bounds."""
    space, line = data == 32, data == 10
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    first[bounds] = True
    start = np.flatnonzero(first)
    size = np.diff(start)
    long = np.flatnonzero(size > longest)
    if len(long):
        ends = np.cumsum(size[long])
        at = np.repeat(start[long] - ends + size[long], size[long]) + np.arange(ends[-1])
        reach = np.maximum.accumulate(at + longest_pieces(data, at, np.repeat(start[long] + size[long], size[long]) - at, v))
        safe = at[1:][reach[:-1] <= at[1:]]  # no piece from before spans these places
        for s, n in zip(start[long], size[long], strict=True):
            k = int(np.searchsorted(safe, s + longest))
            while k < len(safe) and safe[k] < s + n:
                first[safe[k]] = True
                k = int(np.searchsorted(safe, safe[k] + longest))
    return np.flatnonzero(first)


class Lattice:
    """Of many distinct byte strings: the edges into each position, with their cumulative shares."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, v: Vocabulary):
        self.base = np.concatenate([[0], np.cumsum(size + 1)])
        n, width = len(start), int(size.max(initial=0))
        to, frm, piece, prob = [], [], [], []
        order = np.argsort(-size, kind="stable")
        sizes = size[order]
        for i in range(width):  # edges that leave position i of every string longer than i
            live = order[: np.searchsorted(-sizes, -i, "left")]
            node, at, left = self.base[live] + i, start[live] + i, size[live] - i
            first = data[at]
            to.append((node + 1).astype(np.int32)), frm.append(node.astype(np.int32)), piece.append(v.byte_ids[first].astype(np.int32)), prob.append(np.full(len(live), v.byte_probability))
            key = np.zeros(len(live), np.uint64)
            for k in range(min(v.longest_piece, width - i)):
                some = (left > k) & v.begins[_slot(key)]  # only where a piece can go on
                if not some.all():
                    key, node, at, left = key[some], node[some], at[some], left[some]
                key = key * _P + data[at + k] + np.uint64(1)
                hit = np.flatnonzero(v.bits[_slot(key)])
                place = np.minimum(np.searchsorted(v.keys, key[hit]), len(v.keys) - 1)
                hit, place = hit[v.keys[place] == key[hit]], place[v.keys[place] == key[hit]]
                to.append((node[hit] + k + 1).astype(np.int32)), frm.append(node[hit].astype(np.int32)), piece.append(v.ids[place].astype(np.int32)), prob.append(v.probability[place])
        to, frm, piece, prob = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (to, frm, piece, prob))
        by = np.argsort(to, kind="stable")
        to, self.frm, self.piece, prob = to[by], frm[by], piece[by], prob[by]
        self.first = np.searchsorted(to, np.arange(self.base[-1] + 1))
        forward = np.zeros(self.base[-1])
        forward[self.base[:-1]] = 1.0
        depth = to - np.repeat(self.base[:-1], size + 1)[to] if len(to) else to
        share = np.zeros(len(to))
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, width + 2))
        for d in range(1, width + 1):  # filter: all strings a position at a time
            e = by_depth[cuts[d - 1] : cuts[d]]
            if len(e):
                share[e] = forward[self.frm[e]] * prob[e]
                starts = np.flatnonzero(np.concatenate([[True], to[e][1:] != to[e][:-1]]))
                total = np.add.reduceat(share[e], starts)
                forward[to[e][starts]] = total
                share[e] /= np.repeat(total, np.diff([*starts, len(e)]))
        upto = np.cumsum(np.rint(share * _UNIT).astype(np.int64))  # in whole numbers: the same whatever stands before
        head = self.first[to] if len(to) else to
        self.share = upto - np.where(head > 0, upto[head - 1], 0)

    def joined(self, other: Lattice) -> Lattice:
        """The strings of both, the other's behind."""
        out, nodes, edges = object.__new__(Lattice), self.base[-1], len(self.piece)
        out.base, out.first = np.concatenate([self.base[:-1], other.base + nodes]), np.concatenate([self.first[:-1], other.first + edges])
        out.frm, out.piece, out.share = np.concatenate([self.frm, (other.frm + nodes).astype(np.int32)]), np.concatenate([self.piece, other.piece]), np.concatenate([self.share, other.share])
        return out

    def sample(self, which: np.ndarray, size: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence in order, and how many each has."""
        node, start = self.base[which] + size, self.base[which]
        live, step, drawn = np.flatnonzero(node > start), 0, []
        count = np.zeros(len(which), np.int64)
        while len(live):
            at = node[live]
            u = (mixed(seeds[live] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(24)).astype(np.int64)
            edge, last = self.first[at], self.first[at + 1] - 1
            more = np.flatnonzero((self.share[edge] <= u) & (edge < last))
            while len(more):
                edge[more] += 1
                more = more[(self.share[edge[more]] <= u[more]) & (edge[more] < last[more])]
            drawn.append((live, self.piece[edge]))
            node[live] = self.frm[edge]
            count[live] += 1
            live, step = live[node[live] > start[live]], step + 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for s, (rows, piece) in enumerate(drawn):
            out[ends[rows] - 1 - s] = piece
        return out, count


class Known:
    """The lattice of chunks that a worker has met more than once in a slice, up to `room` chunks; it changes no result."""

    def __init__(self, room: int = 40_000):
        self.room, self.hashes, self.place, self.lattice = room, np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Which of its strings each chunk is, -1 if none."""
        at = np.searchsorted(self.hashes, hashes)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == hashes[hit]
        out = np.full(len(hashes), -1)
        out[hit] = self.place[at[hit]]
        return out

    def add(self, hashes: np.ndarray, lattice: Lattice) -> None:
        place = np.concatenate([self.place, len(self.place) + np.arange(len(hashes))])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], place[order]
        self.lattice = self.lattice.joined(lattice) if self.lattice else lattice


@lru_cache(maxsize=2)
def known_chunks(p: Params) -> Known:
    return Known()


def encode_column(column, keys, p: Params, most: int = 1 << 19):
    """(first document, offsets, pieces) of some documents at a time."""
    v, own = vocabulary(p), known_chunks(p)
    data, at = raw(column)
    known = np.asarray(keys.is_valid())
    row_seed = mixed(np.asarray(keys.cast(pa.int64()).fill_null(0)).view(np.uint64) ^ mixed(np.where(known, 0, 1).astype(np.uint64) + np.uint64(2 * p.seed)))
    first, n = 0, len(at) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1))
        part = np.concatenate([data[at[first] : at[last]], np.zeros(8, np.uint8)])
        bounds = at[first : last + 1] - at[first]
        cut = chunks(part[: bounds[-1]], bounds, p.longest, v)
        start, size = cut[:-1], np.diff(cut)
        hashes, lead, which, often = np.unique(hashed(part, start, cut[1:]), return_index=True, return_inverse=True, return_counts=True)
        place = own.places(hashes)
        new = np.flatnonzero((place < 0) & (often > 1))[: own.room - len(own.hashes)]
        if len(new) or own.lattice is None:
            own.add(hashes[new], Lattice(part, start[lead[new]], size[lead[new]], v))
            place = own.places(hashes)
        new = np.flatnonzero(place < 0)
        lattice = own.lattice.joined(Lattice(part, start[lead[new]], size[lead[new]], v))
        place[new] = len(own.hashes) + np.arange(len(new))
        per_doc = np.searchsorted(start, bounds)
        doc = np.repeat(np.arange(last - first), np.diff(per_doc))
        seeds = mixed(row_seed[first + doc] + (np.arange(len(start)) - per_doc[doc]).astype(np.uint64))
        pieces, count = lattice.sample(place[which], size, seeds)
        yield first, np.concatenate([[0], np.cumsum(count)])[per_doc], pieces
        first = last


def decode_pieces(pieces: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces, and their offsets."""
    begin, size = v.offsets[pieces], v.offsets[pieces + 1] - v.offsets[pieces]
    ends = np.concatenate([[0], np.cumsum(size)])
    return v.bytes_[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params(), check: bool = False) -> DataFrame:
    """(key, pieces) of every row of docs; with check also the digest of what the pieces decode to, and whether that is the text."""

    def run(batches):
        v = vocabulary(p)
        for batch in batches:
            ids, column = batch.columns
            data, at = raw(column)
            for first, offsets, pieces in encode_column(column, ids, p):
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pieces), mask=pa.array(~np.asarray(column.slice(first, n).is_valid())))
                cols, names = [ids.slice(first, n), lists], [key, "pieces"]
                if check:
                    back, ends = decode_pieces(pieces, v)
                    cut = ends[offsets]
                    whole = [back[cut[d] : cut[d + 1]].tobytes() for d in range(n)]
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in whole]), pa.array([x == data[at[first + d] : at[first + d + 1]].tobytes() for d, x in enumerate(whole)])]
                    names += ["decoded_sha256", "lossless"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", decoded_sha256 string, lossless boolean" if check else ""
    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, pieces array<int>{more}")


def decode(encoded: DataFrame, key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """(key, text) of encoded rows (key, pieces). Bytes that pieces leave incomplete decode as replacement characters."""

    def run(batches):
        v = vocabulary(p)
        for batch in batches:
            ids, lists = batch.columns
            lists = lists.cast(pa.large_list(pa.int64()))
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            back, ends = decode_pieces(flat, v)
            cut = ends[offsets]
            valid = np.asarray(lists.is_valid())
            yield pa.RecordBatch.from_arrays([ids, pa.array([back[cut[d] : cut[d + 1]].tobytes().decode("utf-8", "replace") if valid[d] else None for d in range(len(ids))], pa.string())], names=[key, "text"])

    return encoded.select(key, "pieces").mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")


def op1_piece_sampling(spark, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), check=True)
    return out.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "decoded_sha256", "lossless")
