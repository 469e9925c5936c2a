import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import pruned_graph as M


def brute(rows, every, k=20):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = sorted({(-float(q @ v), j) for j, v in ok if j != i and len(v) == len(q)})[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([tuple(r) for r in table.select("vec_id", "embedding").collect()], 20)
    got = collected(M.op8_pruned_graph(spark, sf_dir))
    assert got.keys() == want.keys()
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_many_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 3, size=(1500, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = M.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    p = M.Params(shard_rows=200, shards=1000, query_rows=20, part=30)
    got, want = collected(M.nearest(df.filter("vec_id % 20 = 0"), M.index(df, p), p)), brute(rows, 20)
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hit >= 0.95 * 20 * len(want)
    for i in got:
        assert [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)


def test_recall_at_the_querys_own_shard_size(spark):
    """4,096 vectors of 64 dimensions and uneven lengths in one shard, searched as op8 does: recall of 0.9 at least."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 64))
    x *= rng.uniform(0.5, 3, size=(len(x), 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    df = M.usable(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    graphs = M.index(df)
    assert graphs.count() == 1
    got = collected(M.nearest(df.filter("vec_id % 20 = 0"), graphs))
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {i: set(np.argsort(-score[i])[:20].tolist()) for i in range(0, len(x), 20)}
    assert got.keys() == want.keys()
    assert sum(len({j for j, _ in got[i]} & want[i]) for i in want) >= 0.9 * 20 * len(want)


def test_hub_keeps_diverse_edges():
    """A point that all others point to is pruned over all of them, however many."""
    rng = np.random.default_rng(5)
    x = np.vstack([np.zeros((1, 8)), rng.normal(size=(800, 8)) + 8 * np.eye(8)[rng.integers(0, 8, 800)]])
    edges, _ = M.build(x, M.Params(degree=8))
    side = {int(np.argmax(x[j])) for j in edges[0] if j >= 0}
    assert len(side) >= 6


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [0.5, 0.5])]
    u = M.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = collected(M.nearest(u.filter("vec_id = 0"), M.index(u)))
    assert got == {0: [(1, 6.0), (2, 1.0)]}


def test_oddities(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(0, 45)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (20, [1.0, 2.0]), (140, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("ids", "shard", "dim", "entry", "rank")})
    u = M.usable(df, "vec_id", "embedding")
    got = collected(M.nearest(u.filter("vec_id % 20 = 0"), M.index(u)))
    want = brute(rows, 20)
    assert {i: v for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert M.nearest(u.limit(0), M.index(u.limit(0))).isEmpty()
    assert M.nearest(u.limit(0), M.index(u)).isEmpty()
