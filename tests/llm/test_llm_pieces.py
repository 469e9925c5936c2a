import collections
import dataclasses
import hashlib

import numpy as np
import pytest
from oddities import ROWS, none, odd

from shelfmark.llm import piece_sampling as M


def test_lossless_and_reproducible(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = M.op1_piece_sampling(spark, sf_dir)
    texts = dict(map(tuple, docs.collect()))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows.keys() == texts.keys() and all(r["lossless"] for r in rows.values())
    assert all(rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items())
    again = {r["doc_id"]: r["pieces"] for r in M.encode(docs.repartition(5)).collect()}
    assert all(again[i] == r["pieces"] for i, r in rows.items())
    other = {r["doc_id"]: r["pieces"] for r in M.encode(docs, p=M.Params(seed=2)).collect()}
    assert sum(other[i] != r["pieces"] for i, r in rows.items()) > 0.8 * len(rows)
    back = dict(map(tuple, M.decode(out.select("doc_id", "pieces")).collect()))
    assert back == texts


def shares(text, p):
    """Every segmentation of a text with its probability."""
    v = M.vocabulary(p)
    data = text.encode()
    score = {}
    for i in range(len(v.offsets) - 1):
        b = v.bytes_[v.offsets[i] : v.offsets[i + 1]].tobytes()
        hit = [k for k in range(len(v.ids)) if v.ids[k] == i] if b and b in data else []
        if hit:
            score.setdefault(b, []).append((i, float(v.probability[hit[0]])))
    for b in set(data):
        score.setdefault(bytes([b]), []).append((int(v.byte_ids[b]), v.byte_probability))

    def all_from(at):
        if at == len(data):
            return [((), 1.0)]
        return [((i, *rest), s * q) for end in range(at + 1, len(data) + 1) for i, s in score.get(data[at:end], ()) for rest, q in all_from(end)]

    every = all_from(0)
    total = sum(q for _, q in every)
    return {ids: q / total for ids, q in every}


def test_sampling_follows_the_lattice(spark):
    p = dataclasses.replace(M.Params(), flat=0.5)
    n, want = 6000, shares("the cat", p)
    got = collections.Counter(tuple(r["pieces"]) for r in M.encode(spark.range(n).selectExpr("id AS doc_id", "'the cat' AS text"), p=p).collect())
    cut = [shares("the", p), shares(" cat", p)]  # the lattice is cut before a space
    want = {a + b: x * y for a, x in cut[0].items() for b, y in cut[1].items()}
    assert set(got) <= set(want)
    for ids, q in sorted(want.items(), key=lambda x: -x[1])[:8]:
        assert got[ids] / n == pytest.approx(q, abs=5 * (q * (1 - q) / n) ** 0.5 + 1e-3)


def test_oddities(spark):
    got = M.encode(odd(spark), check=True).collect()
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r["pieces"])
    assert by_id[1][0] == by_id[1][1] and by_id[2] == [None] and by_id[3] == [[]]
    back = {r["doc_id"]: r["text"] for r in M.decode(M.encode(odd(spark))).collect()}
    assert back == {r[0]: r[1] for r in ROWS}
    assert M.encode(none(spark)).isEmpty() and M.decode(M.encode(none(spark))).isEmpty()


def test_the_longest_pieces_are_sampled(spark):
    v = M.vocabulary(M.Params())
    size = np.diff(v.offsets)
    long = [int(i) for i in v.ids if size[i] > 16]
    assert v.longest_piece == size.max() > 16 and len(long) > 10
    text = {i: v.bytes_[v.offsets[i] : v.offsets[i + 1]].tobytes().decode() for i in long}
    rows = [(100 * n + j, t) for n, t in enumerate(text.values()) for j in range(100)]
    got = M.encode(spark.createDataFrame(rows, "doc_id long, text string"), check=True).collect()
    assert all(r["lossless"] for r in got) and set(long) <= {i for r in got for i in r["pieces"]}
    data = next(iter(text.values())).encode()
    lattice = M.Lattice(np.frombuffer(data + bytes(8), np.uint8), np.array([0]), np.array([len(data)]), v)
    piece = {v.bytes_[v.offsets[i] : v.offsets[i + 1]].tobytes() for i in v.ids}
    want = [(a, b) for a in range(len(data)) for b in range(a + 1, len(data) + 1) if data[a:b] in piece]
    assert len(lattice.piece) == len(want) + len(data)  # all pieces, and a byte from every place


def test_no_piece_spans_a_cut():
    """Stretches without spaces, of any script: no occurrence of any piece crosses a place where the lattice is cut."""
    p = M.Params()
    v = M.vocabulary(p)
    piece = {v.bytes_[v.offsets[i] : v.offsets[i + 1]].tobytes() for i in v.ids}
    assert not any(b"\n" in x or b" " in x.lstrip(b" ") for x in piece)
    rng = np.random.default_rng(8)
    letters = sorted({x.decode() for x in piece if len(x) <= 6 and b" " not in x and x.decode("utf-8", "ignore").encode() == x})
    texts = ["".join(rng.choice(letters, 400)) for _ in range(20)] + ["a" * 3000, "https://example.org/" + "path/name-" * 60, "".join(rng.choice(list("0123456789abcdef"), 2000))]
    several = 0
    for text in texts:
        data = text.encode()
        cut = M.chunks(np.frombuffer(data, np.uint8), np.array([0, len(data)]), p.longest, v)
        several += len(cut) > 2
        assert cut[0] == 0 and cut[-1] == len(data)
        for c in cut[1:-1].tolist():
            assert not any(data[a:b] in piece for a in range(max(0, c - v.longest_piece), c) for b in range(c + 1, min(len(data), a + v.longest_piece) + 1))
    assert several > 10
