import random
import zlib

from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.sources.clustered import Clustered
from shelfmark.sources.search_index import SearchIndex


def read_bytes(df):
    """Bytes of the files that a scan opens, by the plan's own count."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct().collect()
    return sum(r["file_size"] for r in files), len(files)


def test_search_is_contains(spark, tmp_path):
    rng = random.Random(1)
    words = ["holiday", "berlin", "straße", "beach", "2024", "img", "上海", "ab", "z"]
    rows = {i * 7: "/".join(rng.choice(words) + rng.choice(["", "_", f"{rng.randrange(50)}"]) for _ in range(rng.randrange(1, 5))) for i in range(3000)}
    index = SearchIndex(spark, str(tmp_path / "index"), span=1024, folders=16)
    index.build(spark.createDataFrame(list(rows.items()), "id long, text string"))

    def agrees():
        for terms in (("berlin",), ("straße1",), ("holiday", "beach"), ("上海",), ("ab",), ("nowhere",), ("/img", "2024", "z"), ("each2", "ol")):
            got = {r["id"]: r["text"] for r in index.search(*terms).collect()}
            assert got == {i: t for i, t in rows.items() if all(x in t for x in terms)}, terms

    agrees()
    changed = {i: rng.choice([None, "new/berlin_77", "beach"]) for i in [*rng.sample(sorted(rows), 200), 10**6, 10**6 + 1]}
    index.change(spark.createDataFrame(list(changed.items()), "id long, text string"))
    rows = {i: t for i, t in (rows | changed).items() if t is not None}
    agrees()
    again = {i: t for i, t in zip(sorted(changed)[:50], ["straße19"] * 50, strict=True)}
    index.change(spark.createDataFrame(list(again.items()), "id long, text string"))
    rows |= again
    agrees()
    index.merge()
    assert index.store.read("changes").isEmpty() and index.rows().count() == len(rows)
    agrees()


def test_search_reads_a_tenth(spark, tmp_path):
    """A term that a few rows hold: the files that are opened are less than a tenth of the texts."""
    n = 200_000
    rows = spark.range(n).select("id", F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("/"), F.sha2((F.col("id") + n).cast("string"), 256), F.when(F.col("id") % 65_536 == 5, "/needle.jpg").otherwise(".jpg")).alias("text"))
    index = SearchIndex(spark, str(tmp_path / "index"), span=2048)
    index.build(rows)
    whole, _ = read_bytes(index.store.read("texts"))
    parts = sorted({"needle"[i : i + 3] for i in range(4)})
    folders = F.col("folder").isin([zlib.crc32(g.encode()) % index.folders for g in parts])
    grams, _ = read_bytes(index.store.read("blocks").filter(folders))
    often, _ = read_bytes(index.store.read("often").filter(folders))
    spans = [r["span"] for r in index.candidates(parts).collect()]
    texts, files = read_bytes(index.store.read("texts").filter(F.col("span").isin(spans)))
    assert files == len(spans) == 4 and grams + often + texts < whole / 10
    assert sorted(r["id"] for r in index.search("needle").collect()) == [5, 65_541, 131_077, 196_613]


def test_pages_read_two_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), f"Bild {rng.randrange(400)}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "library_id long, name string, id long").withColumn("key", X.natural_name_key(F.col("name")))
    keys = ("library_id", "key", "name", "id")
    table = Clustered(spark, str(tmp_path / "t"), keys, rows=500)
    table.write(df)
    files = read_bytes(table.store.read("rows"))[1]
    assert files >= 10
    want = sorted(rows, key=lambda r: (r[0], int(r[1].split()[1]), r[1], r[2]))
    for down in (False, True):
        order = want[::-1] if down else want
        at, seen = None, []
        for _ in range(9):
            got = table.page(51, at, descending=down).collect()
            seen += [(r["library_id"], r["name"], r["id"]) for r in got]
            assert len(table.parts(51, at, descending=down)) <= 2 and len(got) == 51
            at = tuple(got[-1][k] for k in keys)
        assert seen == order[: 9 * 51]
    parts = table.store.read("parts").count()
    assert parts == files
    page = table.page(51, tuple(table.page(1, prefix=(1,)).first()[k] for k in keys), prefix=(1,))
    assert [(r["library_id"], r["name"], r["id"]) for r in page.collect()] == [w for w in want if w[0] == 1][1:52]
    assert table.page(10, tuple(table.page(1, descending=True).first()[k] for k in keys)).isEmpty()


def test_files_of_a_page(spark, tmp_path):
    """However many parts there are, a page of fewer rows than a part has opens two files at most."""
    table = Clustered(spark, str(tmp_path / "t"), ("k", "id"), rows=100)
    table.write(spark.range(5000).select((F.col("id") % 997).alias("k"), "id"))
    for at in (None, (3, 0), (500, 4000), (996, 10)):
        parts = table.parts(51, at)
        assert len(parts) <= 2 and read_bytes(table.store.read("rows").filter(F.col("part").isin(parts)))[1] == len(parts)
        got = [tuple(r) for r in table.page(51, at).collect()]
        assert got == [r for r in sorted((i % 997, i) for i in range(5000)) if at is None or r > at][:51]


def test_parts_are_no_tasks(spark, tmp_path, monkeypatch):
    """A table of many parts is cut in few tasks, each of many parts, and each part is one file of so many rows."""
    monkeypatch.setattr("shelfmark.sources.clustered.RANGE", 20_000, raising=False)
    table, tasks = Clustered(spark, str(tmp_path / "t"), ("k", "id"), rows=100), []
    publish = table.store.publish
    monkeypatch.setattr(table.store, "publish", lambda tables, *a, **k: tasks.extend(df.rdd.getNumPartitions() for n, df in tables.items() if n == "rows") or publish(tables, *a, **k))
    table.write(spark.range(40_000).select((F.col("id") % 997).alias("k"), "id"))
    parts = table.store.read("parts").select("part", "n", "first", "last").orderBy("part").collect()
    assert tasks[0] <= 16 and len(parts) > 300 and all(100 <= r["n"] < 200 for r in parts)
    assert all(tuple(a["last"]) < tuple(b["first"]) for a, b in zip(parts, parts[1:], strict=False))
    assert read_bytes(table.store.read("rows"))[1] == len(parts) and table.store.read("rows").count() == 40_000
    assert [tuple(r) for r in table.page(300, (500, 20_440)).collect()] == [r for r in sorted((i % 997, i) for i in range(40_000)) if r > (500, 20_440)][:300]


def test_empty(spark, tmp_path):
    table = Clustered(spark, str(tmp_path / "t"), ("id",))
    table.write(spark.range(0))
    assert table.page(5).isEmpty() and table.page(5, (3,)).isEmpty()
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame([], "id long, text string"))
    assert index.search("abc").isEmpty() and index.search("a").isEmpty()
    index.change(spark.createDataFrame([(1, "abcd")], "id long, text string"))
    assert index.search("abc").count() == 1


def test_grams_are_not_shuffled(spark, tmp_path):
    """An index is built from rows that meet by their span: what is exchanged on the way are texts and blocks, no row a gram."""
    from pyspark.sql import functions

    exploded, explode = [], functions.explode
    rows = spark.range(3000).select("id", F.concat(F.lit("né/𝔘z"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "zzzzz").otherwise("")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(4000, None), (4001, ""), (4002, "ab"), (4003, "abc"), (4004, "𝔘𝔘𝔘𝔘")], "id long, text string"))
    index = SearchIndex(spark, str(tmp_path / "index"), span=1000, folders=4)
    functions.explode = lambda c: exploded.append(c) or explode(c)
    try:
        index.build(rows)
    finally:
        functions.explode = explode
    assert not exploded
    texts = {r["id"]: r["text"] or "" for r in rows.collect()}
    want = {}
    for i, t in texts.items():
        for g in {t[k : k + 3] for k in range(len(t) - 2)}:
            want.setdefault((g, i // 1000), []).append(i % 1000)
    got = {(r["gram"], r["span"]): (r["places"], r["n"], r["folder"]) for r in index.store.read("blocks").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(n == len(p) and f == zlib.crc32(k[0].encode()) % 4 for k, (p, n, f) in got.items())
    often = {r["gram"]: r["n"] for r in index.store.read("often").collect()}
    assert often == {g: sum(len(v) for k, v in want.items() if k[0] == g) for g in {k[0] for k in want}}
