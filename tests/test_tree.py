from types import SimpleNamespace

from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.operators import ingest, jobs, operations, tree
from shelfmark.plans import browse_queries, job_queries
from shelfmark.plans.project import Catalogue

DIR = "id long, library_id long, parent_id long, relative_path string, name string, last_seen_generation long"


def chain(spark, n):
    rows, path = [(1, 1, None, "", "", 2)], ""
    for i in range(n):
        path = f"{path}/d{i:03d}".strip("/")
        rows.append((i + 2, 1, i + 1, path, f"d{i:03d}", 2))
    return spark.createDataFrame(rows, DIR)


def test_deep_rollup(spark):
    dirs = chain(spark, 128)
    assets = spark.createDataFrame([(i, i, 1) for i in range(1, 130)], "id long, directory_id long, library_id long")
    got = {r["id"]: r["recursive_count"] for r in tree.rollup_counts(dirs, assets).collect()}
    assert got[1] == 129 and all(got[i + 2] == 128 - i for i in range(128))


def test_ancestors_by_parent_agree(spark):
    dirs = chain(spark, 120)
    got = tree.ancestors_by_parent(dirs).groupBy("id").count().collect()
    assert sorted((r["id"], r["count"]) for r in got) == [(i, i - 1) for i in range(2, 122)]


def test_incremental_is_full(spark, sf_dir):
    c = Catalogue(spark, sf_dir)
    left = c.assets.filter("id % 5 <> 0")
    delta = c.assets.filter("id % 5 = 0").groupBy(F.col("directory_id").alias("id")).agg((-F.count("*")).alias("delta"))
    moved = tree.incremental_rollup(c.directories, tree.rollup_counts(c.directories, c.assets).drop("child_count"), delta)
    full = tree.rollup_counts(c.directories, left).select("id", "direct_count", "recursive_count")
    assert moved.exceptAll(full).isEmpty() and full.exceptAll(moved).isEmpty()


def test_topology_finds_faults(spark):
    good = chain(spark, 5)
    assert tree.topology(good).isEmpty()
    cycle = good.withColumn("parent_id", F.when(F.col("id") == 2, 6).otherwise(F.col("parent_id")))
    assert not tree.topology(cycle).isEmpty()


def test_change_sequence(spark):
    cols = "library_id long, relative_path string, directory_id long, name string, kind string, format string, mime_type string, size_bytes long, mtime_ns long, source_fingerprint string"
    walk = lambda path, mtime: spark.createDataFrame([(1, path, 1, path, "image", "jpeg", "image/jpeg", 5, mtime, f"v1:5:{mtime}")], cols)
    none = spark.createDataFrame([], cols + ", id long, last_seen_generation long, width long, height long, duration_ms long, probe_status string, probe_error_code string")
    g1 = ingest.merge(none, walk("photo.jpg", 1), 1)
    g1 = g1.withColumns({"probe_status": F.lit("ready"), "width": F.lit(9).cast("long")})
    g2 = ingest.merge(g1, walk("photo.jpg", 1), 2)
    g3 = ingest.merge(g2, walk("photo.jpg", 2), 3)
    g4 = ingest.merge(g3, walk("new.jpg", 2), 4)
    a, b, c = (g.first() for g in (g1, g2, g3))
    assert a["id"] == b["id"] == c["id"] == 1 and b["source_fingerprint"] == a["source_fingerprint"] and b["width"] == 9
    assert c["source_fingerprint"] != b["source_fingerprint"] and c["width"] is None and c["probe_status"] == "pending"
    rows = {r["relative_path"]: r for r in g4.collect()}
    assert rows["new.jpg"]["id"] == 2 and rows["new.jpg"]["source_fingerprint"] == c["source_fingerprint"]
    assert [r["relative_path"] for r in ingest.stale(g4, 4).collect()] == ["photo.jpg"]


def test_fair_claims(spark):
    q = spark.createDataFrame([(i, i, lib, "grid", 0, "queued", 0) for i, lib in ((1, 1), (2, 1), (3, 2), (4, 1), (5, 2))] + [(6, 6, 1, "storyboard", 100, "queued", 0)], "id long, asset_id long, library_id long, variant string, priority int, status string, available_at_ms long")
    served = {}
    order = []
    left = q
    for turn in range(1, 7):
        s = spark.createDataFrame([(lib, p, n) for (lib, p), n in served.items()], "library_id long, priority int, last_sequence long")
        row = jobs.next_claim(left, s, 10).first()
        order.append(row["job_id"])
        served[row["library_id"], row["priority"]] = turn
        left = left.filter(F.col("id") != row["job_id"])
    none = spark.createDataFrame([], "library_id long, priority int, last_sequence long")
    batch = [r["job_id"] for r in jobs.claim_order(q, none, 10).orderBy("turn", "seat").collect()]
    assert order == [*batch, 6] == [1, 3, 2, 5, 4, 6]


def test_eviction_is_a_prefix(spark):
    t = spark.createDataFrame([(i, "grid", "ready", i % 7, 10) for i in range(50)], "asset_id long, variant string, status string, last_accessed_at_ms long, byte_size long")
    got = {r["asset_id"] for r in operations.eviction(t, 205).collect()}
    want = sorted(range(50), key=lambda i: (i % 7, i))[:30]
    assert got == set(want)
    assert operations.eviction(t, 500).isEmpty()
    assert operations.eviction(t.limit(0), 0).isEmpty()


def test_eviction_of_crowded_times(spark):
    """Spans follow the accesses, wherever they crowd; any number of them gives the same rows."""
    times = [5] * 40 + [10**12 + k // 3 for k in range(100)] + [2 * 10**12 + k for k in range(60)] + [None, None]
    rows = [(i, "grid", "ready", at, 1 + i * 7 % 13) for i, at in enumerate(times)]
    t = spark.createDataFrame(rows, "asset_id long, variant string, status string, last_accessed_at_ms long, byte_size long")
    left, used, want = 700, sum(r[4] for r in rows), set()
    for r in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0])):
        if used <= left:
            break
        want.add(r[0])
        used -= r[4]
    for spans in (2, 16, 1024):
        assert {r["asset_id"] for r in operations.eviction(t, left, spans).collect()} == want


def test_every_failure_has_its_latest_attempt(spark):
    n = 10_500
    jobs_ = spark.range(n).selectExpr("id", "id AS asset_id", "'grid' AS variant", "'failed' AS status", "'timeout' AS error_code")
    tried = spark.range(2 * n).selectExpr("id", f"id % {n} AS job_id", "'retry' AS outcome", "id AS duration_ms").filter("job_id > 0")
    c = SimpleNamespace(media_jobs=jobs_, attempts=tried)
    query = {name: run for name, run, _ in job_queries.ENTRIES}["correlated_latest_attempt"]
    got = {r["id"]: r["attempt_id"] for r in query(c).collect()}
    assert got == {i: n + i if i else None for i in range(n)}
    assert operations.failures(jobs_, tried).count() == S.DEFAULT_LIMIT + 1


def test_overlap_is_whole(spark, sf_dir):
    rows = [(i, lib, p) for i, (lib, p) in enumerate([(1, ""), (1, "a"), (1, "a/b"), (1, "ab"), (1, "a/b"), (1, "a/b/c"), (2, ""), (2, "a/b"), (2, "a/bc")])]
    rows += [(10_000_000 + i, lib, p) for i, lib, p in rows]
    holds = lambda x, y: x == "" or x == y or y.startswith(x + "/")
    want = sorted((i, j) for i, k, x in rows for j, m, y in rows if i != j and k == m and holds(x, y))
    assert sorted(map(tuple, tree.overlaps(spark.createDataFrame(rows, "id long, library_id long, relative_path string")).collect())) == want
    c = Catalogue(spark, sf_dir)
    query = {name: run for name, run, _ in browse_queries.ENTRIES}["theta_directory_overlap"]
    own = [(r["id"], r["library_id"], r["relative_path"]) for r in c.directories.collect()]
    assert sorted(map(tuple, query(c).collect())) == sorted((i, j) for i, k, x in own for j, m, y in own if i != j and k == m and holds(x, y))
