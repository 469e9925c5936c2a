"""Numbering in levels, claims by spans and the trigram index, against plain loops."""

import collections
import random

import pytest

from shelfmark.operators import commits, ingest, jobs


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_new_ids_follow_in_order(spark, monkeypatch, span):
    monkeypatch.setattr(ingest, "SPAN", span)
    columns = "id long, library_id long, relative_path string, directory_id long, name string, kind string, format string, mime_type string, size_bytes long, mtime_ns long, source_fingerprint string, last_seen_generation long, width long, height long, duration_ms long, probe_status string, probe_error_code string"
    row = lambda i, lib, d, name: (i, lib, f"{d}/{name}", d, name, "image", "jpg", "image/jpeg", 1, 1, "f", 1, None, None, None, "pending", None)
    old = [row(40, 1, 5, "a"), row(41, 2, 9, "b")]
    new = [row(None, lib, d, f"n{k}") for lib in (1, 2, 3) for d in (7, 2, 11, 5) for k in range(lib + d % 3)]
    got = ingest.merge(spark.createDataFrame(old, columns), spark.createDataFrame(old + new, columns), 2)
    ids = {(r["library_id"], r["directory_id"], r["relative_path"]): r["id"] for r in got.collect()}
    fresh = sorted((r[1], r[3], r[2]) for r in new)
    assert ids == {k: 42 + i for i, k in enumerate(fresh)} | {(1, 5, "5/a"): 40, (2, 9, "9/b"): 41}
    nothing = ingest.merge(spark.createDataFrame([], columns), spark.createDataFrame([], columns), 1)
    assert nothing.isEmpty()


@pytest.mark.parametrize("span", [1, 4, 65_536])
def test_claims_take_turns(spark, monkeypatch, span):
    monkeypatch.setattr(jobs, "SPAN", span)
    rows = [(i, 1 if i % 3 else 2 + i % 2, "queued", 0, 0) for i in range(50, 90)] + [(7, 3, "queued", 0, 99), (8, 3, "done", 0, 0)]
    queue = spark.createDataFrame(rows, "id long, library_id long, status string, priority int, available_at_ms long")
    served = spark.createDataFrame([(1, 0, 30), (2, 0, 4)], "library_id long, priority int, last_sequence long")
    turns, want = collections.Counter(), {}
    for i, lib, *_ in sorted(r for r in rows if r[2] == "queued" and r[4] == 0):
        turns[lib] += 1
        want[i] = (lib, turns[lib], {3: 1, 2: 2, 1: 3}[lib])
    got = jobs.claim_order(queue, served, 10).collect()
    assert {r["job_id"]: (r["library_id"], r["turn"], r["seat"]) for r in got} == want


def test_stored_index(spark, tmp_path):
    texts = ["holiday/beach one.jpg", "holiday/beach two.jpg", "aaaa", "ab", "", None, "each be", "beach"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, search_path_key string")
    ingest.stored_order(ingest.trigrams(rows)).write.parquet(str(tmp_path / "grams"))
    grams = spark.read.parquet(str(tmp_path / "grams"))
    for term in ("beach", "aaa", "nothing", "day/beach t"):
        want = {i for i, t in enumerate(texts) if t and term in t}
        assert {r["id"] for r in ingest.found(rows, grams, term).collect()} == want
        by_index = {r["id"] for r in ingest.trigram_candidates(grams, term).collect()}
        assert {r["id"] for r in ingest.scanned_candidates(rows, term).collect()} == by_index >= want
    plan = ingest.trigram_candidates(grams, "beach")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


def test_index_differences(spark):
    texts = ["abcd", "bcde", "xyz", "aaaa", None, "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, search_path_key string")
    want = collections.Counter((i, t[k : k + 3]) for i, t in enumerate(texts) if t for k in range(len(t) - 2) if t.index(t[k : k + 3]) == k)
    index = collections.Counter({(0, "abc"): 1, (0, "bcd"): 1, (1, "bcd"): 2, (2, "zzz"): 1, (9, "new"): 1, (3, "aaa"): 1})
    grams = spark.createDataFrame(list(index.elements()), "id long, gram string")
    got = collections.Counter((r["side"], r["id"], r["gram"]) for r in ingest.index_differences(grams, rows).collect())
    assert got == collections.Counter({("extra", *k): n for k, n in (index - want).items()}) + collections.Counter({("missing", *k): n for k, n in (want - index).items()})
    same = ingest.trigrams(rows)
    assert ingest.index_differences(same, rows).isEmpty()
    assert ingest.index_differences(same.limit(0), rows.limit(0)).isEmpty()


def test_moves_by_one_join(spark, monkeypatch):
    """What came and went, told by one join, gives the moves that a whole merge gives, alike files and empty tables included."""
    columns = "id long, library_id long, relative_path string, directory_id long, name string, kind string, format string, mime_type string, size_bytes long, mtime_ns long, source_fingerprint string, last_seen_generation long, width long, height long, duration_ms long, probe_status string, probe_error_code string"
    rng = random.Random(3)
    row = lambda i, lib, d, name: (i, lib, f"{d}/{name}", d, name, "image", "jpg", "image/jpeg", 1, 1, rng.choice([None, "f", "g"]), 1, None, None, None, "pending", None)
    old = [row(40 + k, 1 + k % 2, k % 5, f"o{k}") for k in range(60)]
    new = [row(None, 1 + k % 2, k % 7, f"n{k}") for k in range(50)]
    one, two = spark.createDataFrame(old, columns), spark.createDataFrame(rng.sample(old, 40) + new, columns)
    for assets, listing in ((one, two), (one, two.limit(0)), (one.limit(0), two)):
        want = sorted(map(tuple, commits.moved(assets, ingest.merge(assets, listing, 2), listing).collect()))
        gone, came = ingest.unmatched(assets, listing)
        assert sorted(map(tuple, commits.paired(gone, came).collect())) == want
        assert gone.count() + came.count() <= 70 or not assets.count()
    assert len(sorted(map(tuple, commits.paired(*ingest.unmatched(one, two)).collect()))) > 5
