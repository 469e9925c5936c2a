import numpy as np
from parity import same
from pyspark.sql import functions as F

from shelfmark.llm import flat_graph as M


def brute(rows, least=0.95):
    """Rows (vec_id, n_links, component_id, kept) by comparing all pairs."""
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    nodes = sorted({(i, tuple(v)) for (i, v), good in zip(rows, ok, strict=True) if good})
    by_dim = {}
    for k, (_, v) in enumerate(nodes):
        by_dim.setdefault(len(v), []).append(k)
    linked = [np.zeros(0, int)] * len(nodes)
    for at in by_dim.values():
        x = np.array([nodes[k][1] for k in at])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        for r, k in enumerate(at):
            linked[k] = np.array(at)[near[r]]
    top = list(range(len(nodes)))
    for k in range(len(nodes)):
        if top[k] == k:
            todo = [k]
            while todo:
                for j in linked[todo.pop()]:
                    if top[j] != k:
                        top[j] = k
                        todo.append(j)
    place = {n: k for k, n in enumerate(nodes)}
    out = []
    for (i, v), good in zip(rows, ok, strict=True):
        k = place[(i, tuple(v))] if good else None
        component = nodes[top[k]][0] if good else i
        out.append((i, len(linked[k]) if good else 0, component, i is not None and component == i))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def crowds(rng, n, dim, groups, spread):
    """Noise, and groups of near copies; ids in no order."""
    x = [rng.normal(size=(n, dim))]
    for size in groups:
        c = rng.normal(size=dim)
        x.append(c + spread * np.linalg.norm(c) / np.sqrt(dim) * rng.normal(size=(size, dim)))
    x = np.vstack(x) * rng.uniform(0.01, 100, size=(n + sum(groups), 1))
    return [(int(i), [float(e) for e in v]) for i, v in zip(rng.permutation(len(x)), x, strict=True)]


def test_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = crowds(rng, 300, 24, [2] * 20 + [5] * 10 + [60, 150], 0.12)
    walk = np.cumsum(rng.normal(size=(80, 24)) * 0.12, axis=0) + 3 * rng.normal(size=24)  # a chain: neighbours are linked, its ends are not
    rows += [(10_000 + i, [float(e) for e in v]) for i, v in enumerate(walk)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert rows_of(M.near_duplicates(df)) == want
    shards = M.Params(shard_rows=64, shard_most=50, block=16, reach=1.5)
    got = rows_of(M.near_duplicates(df, p=shards))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert len({r[2] for r in got}) <= 1.02 * len({r[2] for r in want})


def test_crowd_over_many_shards(spark):
    """A third of all vectors are near copies of one: the shards that they fill are bounded, and no link is lost."""
    rng = np.random.default_rng(2)
    rows = crowds(rng, 1200, 16, [600], 0.1)
    p = M.Params(shard_rows=200, shard_most=100, block=32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    every = M.points(df)
    dealt = M.members(every, M.centers_of(every, p), p)
    assert max(r["count"] for r in dealt.groupBy("dim", "cluster", "chunk").count().collect()) < 200
    got, want = rows_of(M.near_duplicates(df, p=p)), brute(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_recall_on_near_copies(spark):
    """4,000 vectors of 64 dimensions, 1,500 of them in groups: 0.99 of the links at least, none that is not there."""
    rng = np.random.default_rng(3)
    rows = crowds(rng, 2500, 64, [2] * 200 + [10] * 40 + [300, 400], 0.15)
    got, want = rows_of(M.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), p=M.Params(shard_rows=512))), brute(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) > 0
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_audit(spark):
    """Audited recall is the part of the probes' links that was found."""
    rng = np.random.default_rng(4)
    rows = crowds(rng, 100, 8, [40], 0.05)
    every = M.points(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    exact = M.exact_links(every, every, M.Params())
    assert M.audited_recall(every, exact.filter("n > 0"), M.Params()) == 1.0
    half = exact.filter("n > 0").withColumn("n", F.col("n") / 2)
    assert abs(M.audited_recall(every, half, M.Params()) - 0.5) < 0.05


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(6)
    for n, m in ((5, 3), (50, 40), (400, 1500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = np.arange(n)
        x, y = M.forest(label, a, b)
        assert len(x) == n - len(set(label.tolist()))
        again = np.arange(n)
        M.forest(again, x, y)
        assert (again == label).all() and (label[a] == label[b]).all()


def test_centres_of_a_crowd():
    """Near copies, a third of a sample, give one centre."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(600, 32)), np.ones(32) + 0.05 * rng.normal(size=(300, 32))])
    x = M.unit(rng.permutation(x))
    centers = M.fitted_centers(x, 12, M.Params())
    assert len(centers) == 12 and np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert (centers @ M.unit(np.ones((1, 32)))[0] > 0.8).sum() <= 1


def test_embeddings(spark, sf_dir, duck):
    got = M.op12_flat_graph(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assert rows_of(got) == brute([tuple(r) for r in table.collect()])
    assert same(got, duck, M.OP12_SQL) is None


def test_oddities(spark, duck):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    rows += [(9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.001]), (11, []), (12, [1e300, 1e300]), (13, [1e-300, 1e-300]), (14, [5.0]), (2, [-1.0, 0.0]), (15, [-1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "h1", "dim", "n", "weight", "id", "label", "cluster", "component_id")})
    assert rows_of(M.near_duplicates(df)) == brute(rows)
    assert M.near_duplicates(df.limit(0)).isEmpty()
    assert rows_of(M.near_duplicates(df.filter("vec_id in (4, 5)"))) == [(4, 0, 4, True), (5, 0, 5, True)]
