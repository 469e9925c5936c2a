import collections
import re

import pytest
from oddities import ROWS, none, odd
from pyspark.sql import functions as F

from shelfmark.llm import source_mix as M


def expected(rows):
    """Targets by the rule as it is stated: 150% dealt by weight, the excess over twice a source's size reshared."""
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, live = {}, 1.5 * sum(size.values()), list(names)
    while live:
        w = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / w > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in live}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(2 * size[s] for s in over)
        live = [s for s in live if s not in over]
    return size, target


def checked(docs, out):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    size, target = expected(rows)
    got = out.join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = M.op7_source_mix(spark, sf_dir), M.op7_source_mix(spark, sf_dir)
    assert one.count() == docs.count() and one.exceptAll(two).isEmpty()
    checked(docs, one)


def test_small_blocks_and_a_hot_source(spark):
    rows = [(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(1000, None, None), (1001, "", "none"), (1002, "x " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    checked(docs, M.mix(docs, block=64))


def test_schedule_interleaves(spark):
    targets = spark.createDataFrame([("a", 1000, 1000.0), ("b", 1000, 500.0)], "source string, source_size long, target double")
    rows = M.schedule(targets, 10).orderBy("slot").collect()
    assert collections.Counter(r["source"] for r in rows) == {"a": 100, "b": 50}
    first = collections.Counter(r["source"] for r in rows[:60])
    assert abs(first["a"] - 2 * first["b"]) <= 9
    for s in "ab":
        assert [r["rank"] for r in rows if r["source"] == s] == list(range(100 if s == "a" else 50))


def test_oddities(spark):
    out = M.mix(odd(spark))
    assert out.count() == len(ROWS)
    size, target = expected([(r[0], r[1], r[3]) for r in ROWS])
    assert out.agg(F.sum("taken")).first()[0] == pytest.approx(sum(target.values()), abs=len(size))
    assert M.mix(none(spark)).isEmpty() and M.mixed_rows(none(spark)).isEmpty()
    assert M.mixed_rows(odd(spark)).columns == odd(spark).columns
    clash = odd(spark).withColumns({c: F.lit(c) for c in ("row", "of", "most", "place", "__key", "__n", "copies", "slots")})
    got = M.mixed_rows(clash)
    assert got.columns == clash.columns and got.distinct().exceptAll(clash.distinct()).isEmpty() and not got.isEmpty()


def test_rows_stand_in_the_order_of_the_schedule(spark):
    """Any stretch of the mixed rows has its sources in about the shares of their targets."""
    rows = [(i, "w " * 50, "abc"[i % 3] if i % 4 else "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = {r["source"]: r["target"] for r in M.mix(docs).join(docs, "doc_id").select("source", "target").distinct().collect()}
    got = [r["source"] for r in M.mixed_rows(docs, block=100).collect()]
    for at in range(0, len(got) - 900, 300):
        part = collections.Counter(got[at : at + 900])
        for s, t in share.items():
            assert part[s] / 900 == pytest.approx(t / sum(share.values()), abs=0.05), (at, s)
