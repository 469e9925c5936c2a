import collections
import hashlib
import random
import re

import pytest
from oddities import ROWS, none, odd

from shelfmark.llm import fm_substring as M


def brute(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(1)
    line = " ".join(f"c{i}" for i in range(60))
    own = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    out = [(i, f"{own(rng.randrange(5, 60), 50_000)} {line if i % 3 == 0 else ''} {own(30, 9)}") for i in range(200)]
    return out + [(1000, None), (1001, ""), (1002, "a " * 80)] + [(2000 + i, out[i][1]) for i in range(20)] + [(0, out[0][1])]


@pytest.mark.parametrize("p", [M.Params(), M.Params(crowded=15), M.Params(crowded=0, shard=50), M.Params(window=9, run=4, crowded=5), M.Params(crowded=15, slots=2)])
def test_is_brute_force(spark, p):
    got = M.remove_repeats(spark.createDataFrame(rows(), "doc_id long, text string"), p=p)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(), p.window)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, M.op10_fm_substring(spark, sf_dir).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 35)


def test_oddities(spark):
    assert sorted(map(tuple, M.remove_repeats(odd(spark)).collect()), key=str) == brute([r[:2] for r in ROWS], 35)
    assert M.remove_repeats(none(spark)).isEmpty()
