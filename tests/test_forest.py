import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import forest as M

NODES = "id long, parent_id long"


def truth(parents):
    """state, root and depth by walking up."""
    out = {}
    for i in parents:
        path, x = [], i
        while parents.get(x) is not None and parents[x] in parents and x not in path:
            path.append(x)
            x = parents[x]
        if x in path:
            out[i] = (None, None, "cycle" if i in path[path.index(x) :] else "below_cycle")
        else:
            out[i] = (x, len(path), "tree" if parents[x] is None else "orphan")
    return out


def forests(rng):
    for n in (1, 2, 7, 60, 400):
        parents = {i: None if i == 0 or rng.random() < 0.05 else rng.randrange(i) for i in range(n)}
        yield parents
        loose = dict(parents) | {i: rng.randrange(n + 5) for i in rng.sample(range(n), n // 4)}  # cycles, orphans, loops
        yield loose


def test_depths_and_states(spark):
    for parents in forests(random.Random(1)):
        got = {r["id"]: (r["root"], r["depth"], r["state"]) for r in M.depths(spark.createDataFrame(list(parents.items()), NODES)).collect()}
        assert got == truth(parents)


def test_descendants_in_cycles_too(spark):
    rng = random.Random(2)
    for parents in forests(rng):
        tops = rng.sample(sorted(parents), min(3, len(parents)))
        below = set()
        for i in parents:
            seen, x = set(), i
            while x in parents and x not in seen:
                seen.add(x)
                x = parents[x]
            if seen & set(tops):
                below.add(i)
        got = M.descendants(spark.createDataFrame(list(parents.items()), NODES), spark.createDataFrame([(t,) for t in [*tops, *tops]], "id long"))
        rows = [r["id"] for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == below


def test_ancestors_and_sums(spark):
    rng = random.Random(3)
    parents = {i: None if i < 3 else rng.randrange(max(0, i - 6), i) for i in range(300)}
    want, total = set(), {i: i % 7 for i in parents}
    for i in parents:
        x, d = parents[i], 1
        while x is not None:
            want.add((i, x, d))
            total[x] += i % 7
            x, d = parents[x], d + 1
    df = spark.createDataFrame([(i, p, i % 7) for i, p in parents.items()], "id long, parent_id long, v long")
    assert {tuple(r) for r in M.ancestors(df).collect()} == want
    assert {tuple(r) for r in M.ancestors(df, 5).collect()} == {w for w in want if w[2] <= 5}
    assert dict(map(tuple, M.subtree_sums(df, "v").collect())) == total


def test_chains_of_a_hundred_thousand(spark):
    """Depth, reach and sums of deep chains, and a cycle as long, in the logarithm of their depth."""
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    ring = spark.range(n, n + 60_000).select("id", F.when(F.col("id") > n, F.col("id") - 1).otherwise(n + 49_999).alias("parent_id"))
    both = chain.unionByName(ring)
    got = M.depths(both)
    assert got.filter("state = 'tree' and root = 0 and depth = id").count() == n
    assert {r["state"]: r["count"] for r in got.groupBy("state").count().collect()} == {"tree": n, "cycle": 50_000, "below_cycle": 10_000}
    assert M.descendants(both, spark.createDataFrame([(99_000,), (n + 7,)], "id long")).count() == 1000 + 60_000
    sums = M.subtree_sums(chain.withColumn("one", F.lit(1)), "one")
    assert sums.filter(F.col("total") == n - F.col("id")).count() == n


def test_rollup_refuses_bad_trees(spark):
    good = [(1, 1, None), (2, 1, 1), (3, 1, 2), (10, 2, None), (11, 2, 10)]
    assets = spark.createDataFrame([(1,), (3,), (3,), (11,)], "directory_id long")
    rows = lambda more: spark.createDataFrame([r for r in good if r[0] not in {m[0] for m in more}] + more, "id long, library_id long, parent_id long")
    counts = {r["id"]: tuple(r)[1:] for r in M.rollup(rows([]), assets).collect()}
    assert counts == {1: (1, 3, 1), 2: (0, 2, 1), 3: (2, 2, 0), 10: (0, 1, 1), 11: (1, 1, 0)}
    for more, said in (([(2, 1, 3)], "cycle: 2"), ([(3, 1, 99)], "orphan: 1"), ([(4, 1, None)], "second_root: 1"), ([(4, 1, 10)], "other_library: 1"), ([(1, 1, 3)], "no_root: 1"), ([(5, 1, 5)], "cycle: 1")):
        with pytest.raises(M.BadTree, match=said):
            M.rollup(rows(more), assets)


def test_empty(spark):
    none = spark.createDataFrame([], "id long, library_id long, parent_id long")
    assets = spark.createDataFrame([], "directory_id long")
    for df in (M.depths(none), M.descendants(none, none), M.ancestors(none), M.subtree_sums(none.withColumn("v", F.lit(1)), "v"), M.problems(none), M.rollup(none, assets)):
        assert df.isEmpty()
