import random

from shelfmark.streaming import debounce as D

T0 = 1_700_000_000_000


def expected(times, quiet, cap):
    out, now = [], None
    for t in sorted(times):
        if now and t > now[1]:
            out.append(tuple(now))
            now = None
        now = [now[0], min(t + quiet, now[0] + cap), now[2] + 1] if now else [t, min(t + quiet, t + cap), 1]
    return out + [tuple(now)] if now else out


def test_batch_bursts(spark):
    rng = random.Random(3)
    data = {k: [T0 + rng.randrange(20_000) for _ in range(40)] for k in "abc"}
    df = spark.createDataFrame([(k, t) for k, ts in data.items() for t in ts], "key string, at_ms long")
    got = sorted(tuple(r) for r in D.bursts(df).collect())
    assert got == sorted((k, *b) for k, ts in data.items() for b in expected(ts, 750, 5000))
    assert D.bursts(df.limit(0)).isEmpty()


def test_stream_is_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    times = [T0 + t for t in (0, 500, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500, 5000, 5400, 5500, 9000)]
    rows = [("a", t) for t in times] + [("b", T0 + 10)]
    df = spark.createDataFrame(rows, "key string, at_ms long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = D.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("z", T0 + 10**7)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("bursts").collect()) == sorted(tuple(r) for r in D.bursts(df).collect())


def test_actions_and_windows(spark, sf_dir):
    raw = spark.createDataFrame([(1, "d", "x", "create", False), (1, "d", "x", "close_write", False), (1, "d", "n", "create", True), (2, "", "", "overflow", False), (2, "e", "", "unmounted", False)], "library_id long, directory string, name string, event string, is_directory boolean")
    assert sorted(tuple(r) for r in D.watch_actions(raw).collect()) == [(1, "d", "dirty"), (1, "d", "dirty"), (2, "", "invalidated"), (2, "", "overflow")]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert D.event_windows(events).agg({"n": "sum"}).first()[0] == events.count()


def test_one_long_stretch(spark):
    times = list(range(T0, T0 + 100 * 60_000, 100))
    df = spark.createDataFrame([("a", t) for t in times] + [(None, T0), ("b", None)], "key string, at_ms long")
    got = D.bursts(df.repartition(7))
    assert sorted(tuple(r) for r in got.filter("key = 'a'").collect()) == [("a", *b) for b in expected(times, 750, 5000)]
    assert [tuple(r) for r in got.filter("key is null").collect()] == [(None, T0, T0 + 750, 1)] and got.filter("key = 'b'").isEmpty()
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
