import random
import re

import numpy as np
import pytest
from oddities import ROWS, none, odd

from shelfmark.llm import minmax_dedup as M
from shelfmark.llm.components import components


def brute(rows, width, percent=80):
    sets, first = {}, {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[top(k)] = min(first.get(top(k), i), i)
    return sorted(((i, len(sets[k]), first.get(top(k)) if sets[k] else i, i is not None and (not sets[k] or first.get(top(k)) == i)) for k, (i, _) in enumerate(rows)), key=str)


def family(rng, n, size, steps):
    """Texts that drift apart, so that links make long chains."""
    words = [f"a{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(words)
        for _ in range(steps):
            words[rng.randrange(size)] = f"b{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_is_brute_force(spark, width):
    rng = random.Random(width)
    texts = family(rng, 60, 80, 2) + family(rng, 40, 40, 1) + family(rng, 30, 200, 12) + ["x y"] * 5 + ["x Y z"] * 3 + ["", None, "one"] + family(rng, 20, 3, 1)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p=M.Params(width=width))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, width)


def edges(sizes, n, rng):
    """Pairs of sets of shingles just at the threshold."""
    for _ in range(n):
        union = int(rng.integers(*sizes))
        x = rng.integers(0, 2**64, union, dtype=np.uint64)
        lone = union - -(-80 * union // 100)
        cut = int(rng.integers(0, lone + 1))
        yield np.sort(x[: union - cut]), np.sort(np.concatenate([x[: union - lone], x[union - cut :]]))


def test_no_link_of_larger_sets_is_lost():
    """Of 100,000 pairs at the threshold each shares a band."""
    rng, p = np.random.default_rng(4), M.Params()
    for sizes, n in (((p.small + 2, 60), 60_000), ((60, 150), 30_000), ((150, 600), 10_000)):
        sets = [x for pair in edges(sizes, n, rng) for x in pair]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        banded = M.bands(M.signatures(np.concatenate(sets), offsets, p), p)
        assert (banded[::2] == banded[1::2]).any(axis=1).all()


def test_no_link_of_small_sets_is_lost(spark):
    """Short texts, pairs of which differ by one or two words; each links with its like whatever phrase all have in common."""
    rng = random.Random(6)
    rows, want = [], []
    for k in range(12_000):
        words = ["notice", "hereby"] + [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(0, 25))]
        other = list(words)
        for _ in range(rng.choice([1, 1, 1, 2])):
            i = rng.randrange(2, len(other) + 1)
            other[i : i + rng.randrange(2)] = [f"v{rng.randrange(10**7)}"] * rng.randrange(2)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        x, y = ({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} for w in (words, other))
        want.append(100 * len(x & y) >= 80 * len(x | y))
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p=M.Params(width=2)).collect()}
    first = {}
    for i, t in rows:  # short ones may be equal to others
        first.setdefault(t, i)
    assert sum(want) > 4000
    for k, linked in enumerate(want):
        assert (got[2 * k] == got[2 * k + 1]) or not linked, rows[2 * k : 2 * k + 2]
        assert linked or got[2 * k] != got[2 * k + 1] or len(rows[2 * k][1].split()) < 8, rows[2 * k : 2 * k + 2]


def test_common_phrase_brings_nothing_together(spark):
    """100,000 short texts that begin alike and have no link: no bucket holds more than a few."""
    rng, p = random.Random(9), M.Params(width=2)
    docs = spark.createDataFrame([(i, "for immediate release " + " ".join(f"w{rng.randrange(50_000)}" for _ in range(11))) for i in range(100_000)], "doc_id long, text string")
    run, schema = M._sketch(p)
    nodes = docs.select("doc_id", "text").mapInArrow(run, schema)
    held = M.small_keys(nodes, p).groupBy("band").count()
    assert (held.agg({"count": "max"}).first()[0] or 0) <= 12
    assert M.near_duplicates(docs, p=p).filter("not kept").isEmpty()


def test_undecided_components_are_joined_whatever_the_blocks(spark):
    """Chains of sets that no hub decides: what links between components join is joined, in blocks of any size, by confirmed links alone."""
    rng = random.Random(8)
    shared = [rng.randrange(2**62) for _ in range(40)]
    sets = []
    for _ in range(12):
        own = shared + [rng.randrange(2**62) for _ in range(25)]
        for _ in range(10):
            own = [x for x in own if rng.random() > 0.06] + [rng.randrange(2**62) for _ in range(4)]
            sets.append(set(own))
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and i % 7 != j % 7}

    def joined(pairs):
        top = list(range(7))
        for i, j in pairs:
            a, b = top[i % 7], top[j % 7]
            top = [min(a, b) if t in (a, b) else t for t in top]
        return top

    assert len(set(joined(links))) < 7
    held = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)], "node long, set binary")
    labels = spark.createDataFrame([(i, i % 7) for i in range(len(sets))], "node long, label long")
    grey = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    for block in (3, 1024):
        got = {(max(r), min(r)) for r in map(tuple, M.undecided(grey, labels, held, M.Params(block=block)).collect())}
        assert got <= links and joined(got) == joined(links)


def test_templates_are_not_compared(spark):
    """Texts of one template, alike but not linked, each with words of its own: none stays to be compared in full."""
    rng = random.Random(4)
    form = [f"form{i}" for i in range(60)]
    rows = [(i, " ".join(form + [f"own{i}x{rng.randrange(9)}y{k}" for k in range(20)])) for i in range(600)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p=M.Params(width=2, rounds=1))
    assert got.filter("kept").count() == 600


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, M.op4_minmax_dedup(spark, sf_dir).collect()), key=str) == brute([tuple(r) for r in docs.collect()], 2)


def test_oddities(spark):
    got = sorted(map(tuple, M.near_duplicates(odd(spark)).collect()), key=str)
    assert got == brute([r[:2] for r in ROWS], 5)
    assert M.near_duplicates(none(spark)).isEmpty()
    kept = M.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r[0] is None, r[0]) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 8, 9)] + [(True, None)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == dict.fromkeys(range(101), 0) | {500: 400, 400: 400}
