import random

from shelfmark.streaming import top as M

SCHEMA = "key string, score long, id long"


def best(rows, most):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted({(-s, i) for k, s, i in rows if k == key})[:most]
        out += [(key, n + 1, -s, i) for n, (s, i) in enumerate(own)]
    return sorted(out)


def some(rng, n):
    return [(rng.choice("abcd") if rng.random() < 0.6 else "hot", rng.randrange(60), rng.randrange(400)) for _ in range(n)]


def test_batch(spark):
    rows = some(random.Random(1), 900)
    assert sorted(map(tuple, M.top(spark.createDataFrame(rows + rows[:50], SCHEMA), 7).collect())) == best(rows, 7)
    assert M.top(spark.createDataFrame([], SCHEMA), 3).isEmpty()


def test_stream_is_the_batch(spark, tmp_path):
    """After every batch, and over a restart, the last of each place is the top of all rows so far; nothing is sent for keys that don't move."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, rows, held, sent = random.Random(2), [], {}, []

    def keep(df, n):
        got = [tuple(r) for r in df.collect()]
        sent.append({r[0] for r in got})
        held.update({(k, rank): (s, i) for k, rank, s, i in got})

    for turn in range(4):
        new = some(rng, 120) if turn != 2 else [("a", -5, 1)]
        rows += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = M.topped(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 6)
        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted((k, rank, s, i) for (k, rank), (s, i) in held.items()) == best(rows, 6)
    assert sent[0] == set("abcd") | {"hot"} and not any(sent[k] for k in range(len(sent)) if sent[k] == {"a"})
