import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import walker
from shelfmark.streaming import debounce, fallback, journal

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def some(rng, n):
    return [{"library_id": rng.randrange(1, 4), "directory": f"d{rng.randrange(5)}", "name": f"f{rng.randrange(9)}", "event": rng.choice(["create", "close_write", "delete", "overflow"]), "is_directory": rng.random() < 0.3, "at_ms": k} for k in range(n)]


def test_restart_gives_each_change_once(spark, tmp_path):
    """A query that is stopped and started again, with files added before, between and after, reads every event once."""
    rng, folder, sent = random.Random(1), str(tmp_path / "journal"), []

    def add(files):
        for _ in range(files):
            events = some(rng, rng.randrange(1, 30))
            number = journal.append(folder, events)
            sent.extend((number * journal.PER_FILE + k, e["library_id"], e["directory"], e["event"], e["at_ms"]) for k, e in enumerate(events))

    def run():
        stream = journal.watch(spark, folder, 2).select("seq", "library_id", "directory", "event", "at_ms")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        return q

    def wait(q):
        import time

        for _ in range(300):
            if q.exception() or (os.path.exists(tmp_path / "out") and spark.read.schema("seq long").parquet(str(tmp_path / "out")).count() >= len(sent)):
                break
            time.sleep(0.2)
        q.stop()
        assert q.exception() is None

    add(3)
    wait(run())
    add(5)
    q = run()
    add(2)
    wait(q)
    open(tmp_path / "journal" / journal._name(12), "w").close()  # behind a gap: it waits
    wait(run())
    rows = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "library_id", "directory", "event", "at_ms").collect())
    assert rows == sorted(sent) and len({r[0] for r in rows}) == len(rows)


def test_append_takes_no_number_twice(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "j")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: journal.append(folder, [{"library_id": k}]), range(40)))
    assert sorted(numbers) == list(range(40)) and journal.length(folder) == 40
    assert not [f for f in os.listdir(folder) if f.startswith(".")]


def test_events_between_listings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_text("1")
    (tmp_path / "a" / "y.jpg").write_text("1")
    old = spark.createDataFrame(walker.walk(spark, str(tmp_path)).collect(), walker.S.LISTING)
    (tmp_path / "a" / "x.jpg").write_text("22")
    (tmp_path / "a" / "y.jpg").unlink()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "z.jpg").write_text("1")
    events = journal.events_between(old, walker.walk(spark, str(tmp_path)), 3)
    assert sorted((r["directory"], r["name"], r["event"], r["is_directory"]) for r in events.collect()) == [("", "b", "create", True), ("a", "x.jpg", "close_write", False), ("a", "y.jpg", "delete", False), ("b", "z.jpg", "close_write", False)]
    assert sorted((r["directory"], r["kind"]) for r in debounce.watch_actions(events).collect()) == [("", "dirty"), ("a", "dirty"), ("a", "dirty"), ("b", "dirty")]


def one_by_one(events):
    now, fence, out = {}, {}, []
    for lib, seq, kind, directory, generation in sorted(events, key=lambda e: e[1]):
        if kind == "published":
            now[lib] = max(now.get(lib, 0), generation)
        elif now.get(lib, 0) >= 1 and now[lib] > fence.get(lib, -1):
            if kind == "dirty":
                out.append((lib, seq, "reconcile", directory, None))
            else:
                fence[lib] = now[lib]
                out.append((lib, seq, "full_scan", None, fallback.CODES[kind]))
    return sorted(out)


@pytest.fixture
def watched():
    rng, events = random.Random(5), []
    for seq in range(400):
        kind = rng.choice(["dirty"] * 8 + ["published", "overflow", "invalidated"])
        events.append((rng.randrange(1, 4), seq, kind, f"d{rng.randrange(4)}" if kind == "dirty" else None, rng.randrange(seq // 40 + 1) if kind == "published" else None))
    return events


SCHEMA = "library_id long, seq long, kind string, directory string, generation long"


def test_fallback_in_batch(spark, watched):
    got = sorted(tuple(r) for r in fallback.actions(spark.createDataFrame(watched, SCHEMA)).collect())
    assert got == one_by_one(watched) and {"reconcile", "full_scan"} == {g[2] for g in got}
    assert fallback.actions(spark.createDataFrame([], SCHEMA)).isEmpty()
    all_ = fallback.of_all(spark.createDataFrame([(None, 1, "overflow", None, None), (2, 2, "dirty", "d", None)], SCHEMA), spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted((r["library_id"], r["kind"]) for r in all_.collect()) == [(1, "overflow"), (2, "dirty"), (2, "overflow")]


def test_fallback_of_a_stream(spark, watched, tmp_path):
    """The stream gives the batch's actions, over batches and a restart: the fence is state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for a in range(0, 400, 100):
        spark.createDataFrame(watched[a : a + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        q = fallback.followed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*fallback.ACTION.names).collect()) == one_by_one(watched)


def test_from_journal_to_actions(spark, tmp_path):
    """The whole way: journal, mapping, fallback."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = str(tmp_path / "journal")
    base = {"library_id": 1, "directory": "a", "name": "x", "is_directory": False}
    journal.append(folder, [base | {"event": "published", "generation": 1}, base | {"event": "close_write"}, base | {"event": "overflow"}, base | {"event": "close_write"}])
    journal.append(folder, [base | {"event": "published", "generation": 2}, base | {"event": "delete"}])
    raw = journal.watch(spark, folder)
    kind = F.when(F.col("event").isin("published", "overflow"), F.col("event")).when(F.col("event") == "unmounted", "invalidated").otherwise("dirty")
    q = fallback.followed(raw.select("library_id", "seq", kind.alias("kind"), "directory", "generation")).writeStream.format("memory").queryName("acted").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["action"] for r in spark.table("acted").orderBy("seq").collect()] == ["reconcile", "full_scan", "reconcile"]
