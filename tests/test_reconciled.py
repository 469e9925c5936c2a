import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources.reconciled import Reconciled
from shelfmark.sources.snapshots import Conflict

ASSETS = "id long, library_id long, directory_id long, relative_path string, name string, kind string, format string, mime_type string, size_bytes long, mtime_ns long, source_fingerprint string, last_seen_generation long, width long, height long, duration_ms long, probe_status string, probe_error_code string"


def asset(i, lib, directory, path, size, generation=2):
    return (i, lib, directory, path, path.rpartition("/")[2], "image", "jpeg", "image/jpeg", size, 1, f"v1:{size}:1", generation, 640, 480, None, "ready", None)


@pytest.fixture
def tree_of():
    rng, dirs = random.Random(1), [(1, 1, None, ""), (50, 2, None, "")]
    for i in range(2, 40):
        parent = rng.choice([d for d in dirs if d[1] == 1])
        dirs.append((i, 1, parent[0], f"{parent[3]}/d{i}".lstrip("/")))
    rows, n = [], 0
    for d in dirs:
        for k in range(rng.randrange(5)):
            n += 1
            rows.append(asset(n, d[1], d[0], f"{d[3]}/f{k}.jpg".lstrip("/"), 10))
    return dirs, rows


def test_commit(spark, tmp_path, tree_of):
    dirs, rows = tree_of
    paths = {d[0]: d[3] for d in dirs}
    store = Reconciled(spark, str(tmp_path), slots=16)
    claimed = [3, 7, 12, 50]
    jobs = [(d, 2 if d == 50 else 1, "running", 2, 1 if d == 7 else 2, 1, 0) for d in claimed] + [(20, 1, "queued", 1, None, 0, 5)]
    job_schema = "key long, library_id long, status string, requested_revision long, claimed_revision long, attempts int, available_at_ms long"
    store.create(spark.createDataFrame(rows, ASSETS), spark.createDataFrame(dirs, "id long, library_id long, parent_id long, relative_path string"), spark.createDataFrame(jobs, job_schema), spark.createDataFrame([(1,), (2,)], "id long"))
    before = store.store.manifest()

    kept = {(r[1], r[3]): r for r in rows if r[2] not in claimed}
    found, want = [], dict(kept)
    top = max(r[0] for r in rows)
    for r in rows:
        if r[2] in (3, 7) and not r[3].endswith("f0.jpg"):
            size = 11 if r[3].endswith("f1.jpg") else 10
            found.append(asset(None, r[1], r[2], r[3], size))
            want[r[1], r[3]] = (r[0], *asset(0, r[1], r[2], r[3], size, 3)[1:]) if size == 10 else (r[0], *asset(0, r[1], r[2], r[3], size, 3)[1:12], None, None, None, "pending", None)
        elif r[2] == 50:
            found.append(asset(None, r[1], r[2], r[3], 10))
            want[r[1], r[3]] = (r[0], *r[1:11], 3, *r[12:])
    for d in (12, 3):
        for k in range(2):
            found.append(asset(None, 1, d, f"{paths[d]}/new{k}.jpg", 5))
    for k, r in enumerate(sorted((f for f in found if "/new" in f[3]), key=lambda f: (f[1], f[2], f[3]))):
        want[r[1], r[3]] = (top + 1 + k, *r[1:11], 3, None, None, None, "pending", None)
    found.append(asset(None, 1, 20, f"{paths[20]}/not asked.jpg", 5))

    outcomes = {r["key"]: (r["outcome"], r["content_increment"]) for r in store.commit(spark.createDataFrame(found, ASSETS), 3, 1000).collect()}
    assert outcomes[7][0] == "queued" and {outcomes[d][0] for d in (3, 12, 50)} == {"done"} and outcomes[50][1] == 0
    assert sorted(map(tuple, store.store.read("assets").select([c.split()[0] for c in ASSETS.split(", ")]).collect())) == sorted(want.values())
    direct = {d[0]: sum(w[2] == d[0] for w in want.values()) for d in dirs}
    total = {d[0]: sum(n for e, n in direct.items() if (e == d[0] or d[3] == "" or paths[e].startswith(d[3] + "/")) and (e == 50) == (d[0] == 50)) for d in dirs}
    assert {r["id"]: (r["direct_count"], r["recursive_count"]) for r in store.store.read("counts").collect()} == {d[0]: (direct[d[0]], total[d[0]]) for d in dirs}
    left = {r["key"]: (r["status"], r["attempts"], r["claimed_revision"], r["available_at_ms"]) for r in store.store.read("jobs").collect()}
    assert left == {20: ("queued", 0, None, 5), 7: ("queued", 0, None, 1750)}
    assert {r["id"]: r["content_revision"] for r in store.store.read("libraries").collect()} == {1: sum(outcomes[d][1] for d in (3, 7, 12)), 2: 0}

    after = store.store.manifest()
    rewritten = {s for s in after["tables"]["assets"] if after["tables"]["assets"][s] != before["tables"]["assets"].get(s)}
    slots = {r[0] for r in spark.createDataFrame([(d,) for d in claimed], "d long").select(store._slot("d")).collect()}
    assert {int(s) for s in rewritten} <= slots and len(slots) < 16
    assert after["generation"] == before["generation"] and after["content_revision"] == before["content_revision"] + 1
    with pytest.raises(Conflict):
        store.store.publish({}, before["revision"], full=False)


def test_nothing_to_commit(spark, tmp_path, tree_of):
    dirs, rows = tree_of
    store = Reconciled(spark, str(tmp_path), slots=4)
    jobs = spark.createDataFrame([], "key long, library_id long, status string, requested_revision long, claimed_revision long, attempts int, available_at_ms long")
    store.create(spark.createDataFrame(rows, ASSETS), spark.createDataFrame(dirs, "id long, library_id long, parent_id long, relative_path string"), jobs, spark.createDataFrame([(1,), (2,)], "id long"))
    before = store.store.manifest()["tables"]["assets"]
    assert store.commit(spark.createDataFrame(rows, ASSETS), 3, 1).isEmpty()
    assert store.store.manifest()["tables"]["assets"] == before and store.store.read("assets").count() == len(rows)
    assert store.store.read("counts").filter(F.col("direct_count") > 0).count() > 0


def test_large_slots_are_many_tasks(spark, tmp_path):
    """However few the slots are, one that is large is written by several tasks, on both ways."""
    n, key = 40_000, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    dirs = spark.createDataFrame([(1, 1, None, ""), (2, 1, 1, "a"), (3, 1, 1, "b")], "id long, library_id long, parent_id long, relative_path string")
    row = lambda d, path: [F.lit(1).cast("long").alias("library_id"), d.cast("long").alias("directory_id"), path.alias("relative_path"), path.alias("name"), *[F.lit("image").alias(c) for c in ("kind", "format", "mime_type")], F.col("id").alias("size_bytes"), F.col("id").alias("mtime_ns"), F.sha2(F.col("id").cast("string"), 256).alias("source_fingerprint")]
    d = F.col("id") % 2 + 2
    listing = spark.range(n).select(*row(d, F.concat(F.element_at(F.array(F.lit("a/"), F.lit("b/")), (F.col("id") % 2 + 1).cast("int")), F.col("id").cast("string"))))
    rest = [F.lit(2).cast("long").alias("last_seen_generation"), *[F.lit(7).cast("long").alias(c) for c in ("width", "height", "duration_ms")], F.lit("ready").alias("probe_status"), F.lit(None).cast("string").alias("probe_error_code"), F.col("relative_path").alias("derived")]
    assets = listing.filter("size_bytes % 10 <> 0").select((F.col("size_bytes") + 1).alias("id"), "*", *rest)
    jobs = spark.createDataFrame([(2, 1, "running", 1, 1, 1, 0)], "key long, library_id long, status string, requested_revision long, claimed_revision long, attempts int, available_at_ms long")
    store, before = Reconciled(spark, str(tmp_path), slots=1), spark.conf.get(key)
    files = lambda: store.store.read("assets").select("_metadata.file_path").distinct().count()
    spark.conf.set(key, "256KB")
    try:
        store.create(assets, dirs, jobs, spark.createDataFrame([(1,)], "id long"))
        created = files()
        store.commit(listing.filter("size_bytes % 7 <> 0"), 3, 1000)
        assert created > 1 and files() > 1
    finally:
        spark.conf.set(key, before)
    own = {r["relative_path"]: r["id"] for r in assets.filter("directory_id = 3 or size_bytes % 7 <> 0").collect()}
    got = {r["relative_path"]: (r["id"], r["width"], r["derived"]) for r in store.store.read("assets").collect()}
    new = sorted(f"a/{i}" for i in range(0, n, 10) if i % 7)
    assert got == {p: (i, 7, p) for p, i in own.items()} | {p: (n + 1 + k, None, None) for k, p in enumerate(new)}
