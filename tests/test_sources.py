import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import tree
from shelfmark.sources import content, snapshots, walker

FILES = ["cover.webp", "album/photo.jpg", "album/nested/clip.MOV", "album/nested/notes.txt", ".hidden/kept.png", "@eaDir/derived.jpg", ".Trash/removed.gif", "vector.svg"]


@pytest.fixture
def root(tmp_path):
    for f in FILES:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(f)
    (tmp_path / "empty").mkdir()
    return tmp_path


def test_walk(spark, root):
    os.symlink(root / "cover.webp", root / "link.webp")
    rows = walker.classified(walker.walk(spark, str(root))).collect()
    kept = [r for r in rows if r["skipped"] is None]
    assert sum(r["kind"] == "directory" for r in kept) == 5 and sum(r["kind"] == "file" for r in kept) == 4
    skipped = {r["relative_path"]: r["skipped"] for r in rows if r["skipped"]}
    assert skipped == {"@eaDir": "system_directory", ".Trash": "system_directory", "album/nested/notes.txt": "unsupported", "vector.svg": "unsupported", "link.webp": "link"}


def test_deep_and_single(spark, tmp_path):
    """A root with a single child that holds all: it is walked by many tasks, in rounds, each entry once."""
    top, want = tmp_path / "only", set()
    for a in range(12):
        for b in range(6):
            (top / f"a{a}" / f"b{b}").mkdir(parents=True)
            for f in range(5):
                (top / f"a{a}" / f"b{b}" / f"f{f}.jpg").touch()
    deep = top
    for k in range(60):
        deep = deep / f"d{k}"
        deep.mkdir()
    for p in tmp_path.rglob("*"):
        want.add(str(p.relative_to(tmp_path)))
    rounds = []
    plain = walker.staged
    walker.staged = lambda df, name: rounds.append(plain(df.withColumn("task", F.spark_partition_id()), name)) or rounds[-1].drop("task")
    try:
        rows = [r["relative_path"] for r in walker.walk(spark, str(tmp_path), share=20, tasks=8).collect()]
    finally:
        walker.staged = plain
    assert sorted(rows) == sorted(want | {""})
    tasks = rounds[0].unionByName(rounds[1])
    for r in rounds[2:]:
        tasks = tasks.unionByName(r)
    assert tasks.filter("not pending").select("task").distinct().count() >= 6
    assert max(r["count"] for r in tasks.filter("not pending").groupBy("task").count().collect()) < len(want) / 2
    with pytest.raises(FileNotFoundError):
        walker.walk(spark, str(tmp_path / "nowhere"))


def test_counts(spark, root):
    rows = walker.classified(walker.walk(spark, str(root))).filter("skipped is null")
    key = F.xxhash64("relative_path")
    dirs = rows.filter("kind = 'directory'").select(key.alias("id"), F.lit(1).alias("library_id"), F.when(F.col("relative_path") != "", F.xxhash64("parent_path")).alias("parent_id"), "relative_path", "name")
    assets = rows.filter("kind = 'file'").select(key.alias("id"), F.xxhash64("parent_path").alias("directory_id"))
    got = tree.rollup_counts(dirs, assets).join(dirs.select("id", "relative_path"), "id").collect()
    assert {r["relative_path"]: (r["direct_count"], r["recursive_count"]) for r in got} == {"": (1, 4), "album": (1, 2), "album/nested": (1, 1), ".hidden": (1, 1), "empty": (0, 0)}


def test_candidates(spark, root):
    used = spark.createDataFrame([("album/x",)], "root_rel_path string")
    got = {r["name"]: r["blocked"] for r in walker.candidates(spark, str(root), used).collect()}
    assert got == {"@eaDir": "system_directory", ".Trash": "system_directory", "album": "overlap", ".hidden": None, "empty": None}


def test_content(spark, root):
    rows = walker.classified(walker.walk(spark, str(root))).filter("asset_kind is not null").withColumn("id", F.xxhash64("relative_path"))
    known = spark.createDataFrame(rows.select("id", "relative_path", "size_bytes", "source_fingerprint").collect())
    got = content.contents(spark, str(root), known).collect()
    assert {r["relative_path"]: bytes(r["content"]).decode() for r in got} == {f: f for f in FILES if f.endswith(("webp", "jpg", "MOV", "png")) and not f.startswith(("@", ".T"))}
    (root / "cover.webp").write_text("COVER.WEBP")  # as large, but another file
    os.utime(root / "cover.webp", ns=(1, 1))
    (root / "album/photo.jpg").unlink()
    assert {r["relative_path"] for r in content.contents(spark, str(root), known).collect()} == {"album/nested/clip.MOV", ".hidden/kept.png"}


def test_snapshots(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}")
    assert s.revision() == 0
    assert s.publish({"t": spark.range(5)}, 0, sort={"t": ["id"]}) == 1
    assert s.read("t").count() == 5
    with pytest.raises(snapshots.Conflict):
        s.publish({"t": spark.range(9)}, 0)
    with pytest.raises(snapshots.Conflict):
        s._put({"revision": 1})
    assert s.read("t").count() == 5
    s.publish({"u": spark.range(3)}, 1, full=False)
    m = s.manifest()
    assert (m["generation"], m["content_revision"]) == (1, 2) and s.read("t").count() == 5


def test_ranges_of_a_large_file(spark, tmp_path):
    """A sparse file of 3 GiB: three ranges of it, and the whole in cuts, with no more than a cut in a row."""
    big = tmp_path / "big.mkv"
    with open(big, "wb") as f:
        for at, mark in ((0, b"begin"), (2**31 + 12_345, b"middle"), (3 * 2**30 - 3, b"end")):
            f.seek(at)
            f.write(mark)
    (tmp_path / "empty.jpg").touch()
    (tmp_path / "small.jpg").write_bytes(bytes(range(200)))
    found = walker.classified(walker.walk(spark, str(tmp_path))).filter("asset_kind is not null")
    rows = found.select(F.crc32(F.col("relative_path").cast("binary")).alias("id"), "relative_path", "source_fingerprint").collect()
    assets = spark.createDataFrame(rows, "id long, relative_path string, source_fingerprint string")  # as they are now
    ids = {r["relative_path"]: r["id"] for r in assets.collect()}
    ranges = [(ids["big.mkv"], 2**31 + 12_340, 2**31 + 12_355), (ids["big.mkv"], 3 * 2**30 - 5, 2**40), (ids["big.mkv"], 2**20 - 2, 2**20 + 1), (ids["small.jpg"], 0, 0), (ids["small.jpg"], 500, 600), (77, 0, 9)]
    got = content.chunks(spark, str(tmp_path), assets, spark.createDataFrame(ranges, "id long, start long, end long"), 2**20).collect()
    assert sorted((r["id"], r["offset"], bytes(r["content"])) for r in got) == sorted([
        (ids["big.mkv"], 2**31 + 12_340, b"\0" * 5 + b"middle" + b"\0" * 5), (ids["big.mkv"], 3 * 2**30 - 5, b"\0\0end"), (ids["big.mkv"], 2**20 - 2, b"\0\0"), (ids["big.mkv"], 2**20, b"\0\0"), (ids["small.jpg"], 0, b"\0"),
    ])
    whole = content.chunks(spark, str(tmp_path), assets).select("id", "offset", F.length("content").alias("n"), F.sha2("content", 256).alias("sha"))
    sizes = whole.groupBy("id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("rows")).collect()
    assert {r["id"]: (r["n"], r["most"], r["rows"]) for r in sizes} == {ids["big.mkv"]: (3 * 2**30, content.CHUNK, 384), ids["small.jpg"]: (200, 200, 1)}
    assert {r["relative_path"] for r in content.contents(spark, str(tmp_path), assets).select("relative_path").collect()} == {"empty.jpg", "small.jpg"}
    os.utime(big, (1, 1))
    assert content.chunks(spark, str(tmp_path), assets).select("id").distinct().count() == 1
