import collections
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oddities import none, odd
from pyspark.sql import functions as F

from shelfmark.llm import fano_lm as M
from shelfmark.llm.elias_fano import Bits, EliasFano


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def brute(rows, p=M.Params()):
    one, two = collections.Counter(), collections.Counter()
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for w in train:
        one.update(w)
        two.update(zip(["<s>", *w], w))
    n, v = sum(one.values()), len(one)
    mass = collections.Counter()
    for (a, _), c in two.items():
        if c >= p.least:
            mass[a] += c - p.discount
    one["<s>"] = len(train)
    out = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, x in zip(["<s>", *w], w):
            c = two[a, x] if two[a, x] >= p.least else 0
            left = 1 - mass[a] / one[a] if one[a] else 1.0
            score += math.log10((c - p.discount if c else 0) / max(one[a], 1) + left * (one[x] + 1) / (n + v + 1))
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


def test_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in M.op5_fano_lm(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4] == pytest.approx(w[4], rel=1e-9)
        assert got[i][5] == pytest.approx(w[5], rel=5e-3, abs=0.02)  # quantised probabilities


def test_held_out_is_better_than_base(spark, sf_dir):
    r = M.op5_fano_lm(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_probabilities_of_a_context_sum_to_one(spark):
    df = spark.createDataFrame([("a b a c a b",), ("b a b",), ("c c a b",)], "text string")
    model = M.fit(df)
    trie = M.Trie(model)
    from shelfmark.llm.textvec import words
    import pyarrow as pa

    w = next(words(pa.array(["a b c"]), lower=True))
    vocabulary = np.concatenate([w.hashes, [M.END]])
    total = 0.0
    for x in vocabulary:
        _, _, s = trie.scores(np.array([x]), np.array([w.hashes[0]]), np.array([0, 1]), 3)
        total += 10 ** s[0]
    unseen = trie.scores(np.array([12345], np.uint64), np.array([w.hashes[0]]), np.array([0, 1]), 3)[2][0]
    assert total + 10**unseen == pytest.approx(1.0, rel=2e-3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 2**64 - 1))
def test_elias_fano(values, other):
    x = np.unique(np.array(values, np.uint64))
    e = EliasFano.of(*EliasFano.arrays(x))
    assert (e.access(np.arange(len(x))) == x).all()
    probe = np.array([*values, other], np.uint64)
    found = e.find(probe)
    for v, i in zip(probe, found):
        assert (i >= 0 and x[i] == v) if v in x else i < 0


def test_oddities(spark):
    model = M.fit(odd(spark))
    got = M.score(odd(spark), model)
    assert got.count() == odd(spark).count()
    assert {r["n_tokens"] for r in got.filter("doc_id in (2, 3, 4)").collect()} == {1}
    assert got.filter("isnan(score) or score > 0").isEmpty()
    nothing = M.fit(none(spark))
    assert (nothing.tokens, nothing.distinct) == (0, 0)
    assert M.score(odd(spark), nothing).filter("n_known > 0 or isnan(score)").isEmpty()
    assert M.score(none(spark), model).isEmpty()


def test_contexts_that_share_32_bits_stay_apart(tmp_path, monkeypatch):
    import pandas as pd
    import pyarrow as pa
    from shelfmark.llm.textvec import words

    texts = ["often x", "often x", "often z"] * 20 + ["rare y y"] * 2
    own = {t: next(words(pa.array([t]), lower=True)).hashes[0] for t in ("often", "rare", "x", "y", "z")}
    alias = (own["often"] & ~M._LOW) | np.uint64(12345)

    def near(column, lower):
        for w in words(column, lower=lower):
            w.hashes[w.hashes == own["rare"]] = alias
            yield w

    monkeypatch.setattr(M, "words", near)
    p, buckets = M.Params(), 4
    blocks = pd.concat(b.to_pandas() for b in M._counts(p, buckets)[0]([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    levels = pd.concat(M._level(str(tmp_path), p, buckets)[0](key, frame) for key, frame in blocks.groupby(["kind", "bucket"]))
    for bucket, frame in levels[(levels["kind"] == 1) & (levels["contexts"].str.len() > 0)].groupby("bucket"):
        M._contexts(str(tmp_path))[0]((bucket,), frame)
    one = levels[levels["kind"] == 0]
    trie = M.Trie(M.Model(str(tmp_path), buckets, int(one["total"].sum()), int(one["distinct"].sum()), p))
    d, n, v = p.discount, 3 * 60 + 4 * 2, 6
    contexts = np.array([own["often"], alias])
    assert trie.masses(contexts) == pytest.approx([60 - 2 * d, 2 - d], rel=2e-3)
    score = lambda a, b: trie.scores(np.array([b]), np.array([a]), np.array([0, 1]), len(texts))[2][0]
    assert 10 ** score(alias, own["z"]) == pytest.approx(d / 2 * 21 / (n + v + 1), rel=5e-3)
    assert 10 ** score(alias, own["y"]) == pytest.approx((2 - d) / 2 + d / 2 * 5 / (n + v + 1), rel=5e-3)
    assert 10 ** score(own["often"], own["x"]) == pytest.approx((40 - d) / 60 + 2 * d / 60 * 41 / (n + v + 1), rel=5e-3)


def test_pairs_seen_once_are_counted(spark):
    rows = [(1, "a b c"), (2, "b a d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in M.score(df, M.fit(df)).collect()}
    # all pairs occur once: (1 - D) / c(v) + D * kinds(v) / c(v) * (c(w) + 1) / (N + V + 1), N = 8, V = 5
    one = {"a": 2, "b": 2, "c": 1, "d": 1, "</s>": 2, "<s>": 2}
    kinds = {"<s>": 2, "a": 2, "b": 2, "c": 1, "d": 1}
    for i, text in rows:
        w = [*text.split(), "</s>"]
        want = sum(math.log10(0.25 / one[v] + 0.75 * kinds[v] / one[v] * (one[x] + 1) / 14) for v, x in zip(["<s>", *w], w))
        assert got[i] == pytest.approx(want, rel=2e-3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=400))
def test_select_and_run_of_bits(values):
    bits = np.array(values)
    b = Bits(*Bits.arrays(bits))
    for bit in (0, 1):
        where = np.flatnonzero(bits == bit)
        assert (b.select(np.arange(len(where)), bit) == where).all()
    upto = [next((j for j in range(i, len(bits)) if not bits[j]), len(bits)) - i for i in range(len(bits))]
    assert (b.run(np.arange(len(bits))) == upto).all()


def brute_triples(rows, p=M.Params(order=3)):
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    train = [["<s>", *tokens(t)] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for w in train:
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    n, v = sum(c for x, c in one.items() if x != "<s>"), len(one) - 1
    fans, fans2 = collections.Counter(a for a, _ in two), collections.Counter(a[:2] for a in three)
    out = {}
    for i, t in rows:
        w, score = ["<s>", *tokens(t)], 0.0
        for k in range(1, len(w)):
            prob = (one[w[k]] + 1) / (n + v + 1)
            for gram, count, c, f in ((w[k - 1 : k + 1], two, one[w[k - 1]], fans[w[k - 1]]), (w[k - 2 : k + 1], three, two[tuple(w[k - 2 : k])], fans2[tuple(w[k - 2 : k])])):
                if c and len(gram) > 1:
                    prob = max(count[tuple(gram)] - p.discount, 0) / c + p.discount * f / c * prob
            score += math.log10(prob)
        out[i] = score
    return out


def test_triples_are_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_triples(rows)
    got = {r["doc_id"]: r for r in M.op5_fano_lm(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i]["score_3"] == pytest.approx(w, rel=5e-3, abs=0.02)  # quantised probabilities
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score_3"] for r in held) > sum(r["score"] for r in held)


def test_triples_after_a_common_pair_and_over_chunks(spark):
    """A pair with thousands of different third words, sent in many blocks; copies; texts of no and one word."""
    texts = [*(f"the one x{k} the one y{k % 7}" for k in range(3000)), *["the one x1 the"] * 50, None, "", "the", "one the one"]
    rows = [(k, t) for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    p = M.Params(order=3, chunk=2000)
    want = brute_triples(rows, p)
    got = {r["doc_id"]: r["score_3"] for r in M.score(df, M.fit(df, p=p)).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w, rel=5e-3, abs=0.02)


def test_probabilities_after_a_pair_sum_to_one(spark):
    import pyarrow as pa
    from shelfmark.llm.textvec import words

    df = spark.createDataFrame([("a b a c a b",), ("b a b",), ("c c a b",)], "text string")
    trie = M.Trie(M.fit(df, p=M.Params(order=3)))
    of = {t: next(words(pa.array([t]), lower=True)).hashes[0] for t in "abc"}
    a, b = of["a"], of["b"]

    def last(x):
        whole = trie.scores(np.array([a, b, x]), np.array([M.BEGIN, a, b]), np.array([0, 3]), 3)[3][0]
        return 10 ** (whole - trie.scores(np.array([a, b]), np.array([M.BEGIN, a]), np.array([0, 2]), 3)[3][0])

    assert sum(last(x) for x in [*of.values(), M.END, np.uint64(12345)]) == pytest.approx(1.0, rel=2e-3)


def test_oddities_with_triples(spark):
    p = M.Params(order=3)
    model = M.fit(odd(spark), p=p)
    got = M.score(odd(spark), model)
    assert got.count() == odd(spark).count()
    assert got.filter("isnan(score_3) or score_3 > 0").isEmpty()
    nothing = M.fit(none(spark), p=p)
    assert M.score(odd(spark), nothing).filter("score_3 <> score or isnan(score_3)").isEmpty()
    assert M.score(none(spark), model).isEmpty()
    with pytest.raises(ValueError):
        M.Params(order=3, least=2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=2, max_size=200), st.integers(0, 6))
def test_spans_of_uneven_steps(fans, more):
    x = np.cumsum(fans)
    a, b = EliasFano.of(*EliasFano.arrays(x, more)).span(np.arange(len(x) - 1))
    assert (a == x[:-1]).all() and (b == x[1:]).all()


def test_successors_of_a_common_context_make_no_long_runs():
    """Of 40,000 successors of one context and one of each of 1,000 others; side by side by their context's place, they fill runs of thousands of ones."""
    rng = np.random.default_rng(1)
    fans = np.array([40_000, *[1] * 1000])
    start = np.cumsum(fans) - fans
    low = np.concatenate([np.sort(rng.choice(2**32, 40_000, replace=False)), rng.integers(0, 2**32, 1000)]).astype(np.uint64)
    keys = M.relative(np.repeat(start, fans), np.repeat(fans, fans), low)
    assert (keys[1:] > keys[:-1]).all()
    e = EliasFano.of(*EliasFano.arrays(keys))
    assert (e.find(keys) == np.arange(len(keys))).all()
    assert e.bits.run(e.bits.select(np.arange(len(keys)), 1)).max() < 64
