"""Near-duplicate vectors by cosine, found on one flat robust-pruned graph that is built in overlapping shards.

Centres are fitted on a bounded sample, thinned first so that no crowd of near copies draws more than one of them. A point
belongs to the cluster of its nearest centre, and to all whose border is so near that a step of a link's length in any
direction may well cross it; so clusters overlap where points lie between them. A cluster is a shard, or several by a hash
where it is large, so that a shard is bounded whatever the rows. Each shard builds a graph of its own (greedy search proposes, relaxed
pruning keeps diverse edges). The adjacency lists that a point has from its shards are united into one list: the flat
graph. A search starts from the medoid of each shard that the point belongs to, walks greedily towards the point, and
from the first points in range on expands along all edges for as long as it finds more in range. Where an expansion would
look at more edges than the shard has points, the points are compared instead, so that a crowd costs no more than that.

Every link is verified by its cosine in double precision. A pair that shares several clusters counts in the least of them
only, so links are counted where they are found and never sent as pairs: a shard gives a count for each point and a
spanning forest of its links. Recall is audited against brute force on a bounded set of probes, half of them points with
links; where it falls short, the search is done again with twice the reach, up to all clusters.

Equal vectors are one point with a weight. Vectors that are null, zero, or hold null or non-finite components link with
nothing, nor do rows with a null id. Vectors of another dimension are compared among themselves. Repeated rows give a row
each and count once; an id with several vectors counts once for each. Columns beside the two named are not looked at,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import pruned_graph
from shelfmark.llm.common import rekeyed, table, written
from shelfmark.llm.components import components
from shelfmark.llm.pruned_graph import search


@dataclass(frozen=True)
class Params:
    """least: cosine of a link. sample: points that centres are fitted on at most; centers: of them at most. shard_rows: wanted points of a cluster, if each belongs to `shares`; shard_most: points of a shard at most, about. reach: how near a border is, in deviations of such a step along one axis. probes: points that recall is audited on at most, in two halves."""

    least: float = 0.95
    sample: int = 16_384
    centers: int = 4096
    shard_rows: int = 4096
    shard_most: int = 16_384
    shares: int = 3
    reach: float = 1.0
    degree: int = 24
    build_beam: int = 40
    beam: int = 24
    relax: float = 1.2
    block: int = 256
    probes: int = 512
    recall: float = 0.98


def usable() -> Column:
    """Of rows (vec_id, embedding): whether they take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever the magnitude of their components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def points(vectors: DataFrame) -> DataFrame:
    """(node, h1, h2, dim, weight, id, embedding) of the distinct usable vectors; weight: ids that have it, id: the least."""
    keyed = vectors.select("vec_id", "embedding", *_hashes())
    ids = keyed.select("vec_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("id"))
    one = keyed.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    return written(one.join(ids, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.size("embedding").alias("dim"), "weight", "id", "embedding"), "points")


def _hashes():
    return F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")


def fitted_centers(sample: np.ndarray, k: int, p: Params) -> np.ndarray:
    """k centres or fewer for unit vectors: of the sample only points count that are not in range of an earlier one."""
    kept = np.ones(len(sample), bool)
    for a in range(0, len(sample), 256):  # a point goes if an earlier one of its block, or any that stayed before, is in range
        part = sample[a : a + 256]
        before = sample[:a][kept[:a]]
        if len(before):
            kept[a : a + 256] &= (part @ before.T).max(axis=1) < p.least
        kept[a : a + 256] &= np.tril(part @ part.T, -1).max(axis=1, initial=-1) < p.least
    thin = sample[kept]
    centers = thin[: max(1, min(k, len(thin)))].copy()
    for _ in range(8 if len(centers) < 1024 else 2):
        nearest = np.concatenate([np.argmax(thin[a : a + 1024] @ centers.T, axis=1) for a in range(0, len(thin), 1024)])
        for d in range(centers.shape[1]):
            centers[:, d] = np.bincount(nearest, thin[:, d], len(centers))
        length = np.sqrt(np.einsum("ij,ij->i", centers, centers))
        empty = length < 1e-9
        centers[empty], length[empty] = thin[np.flatnonzero(empty) % len(thin)], 1.0
        centers /= length[:, None]
    return centers


def centers_of(every: DataFrame, p: Params) -> dict[int, np.ndarray]:
    """Centres by dimension, for the dimensions of the sample: points with the least hashes."""
    rows = every.select("dim", "embedding", "h1", "h2").orderBy("h1", "h2").limit(p.sample).toPandas()
    out: dict[int, np.ndarray] = {}
    if len(rows):
        total = every.count()
        for dim, part in rows.groupby("dim"):
            wanted = -(-total * len(part) * p.shares // (len(rows) * p.shard_rows))
            out[int(dim)] = fitted_centers(unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)), int(min(p.centers, wanted)), p)
    return out


def _dealt(centers: dict[int, np.ndarray], p: Params):
    schema = "node long, dim int, weight long, vector binary, clusters array<int>"
    step = p.reach * np.sqrt(2 - 2 * p.least)

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            flat, at = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims.astype(np.int64))])
            vectors, clusters = [b""] * len(dims), [[0]] * len(dims)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for a in range(0, len(own), 1024):
                    rows = own[a : a + 1024]
                    x = unit(flat[at[rows][:, None] + np.arange(dim)])
                    near = np.ones((len(rows), 1), bool)
                    if (some := centers.get(int(dim))) is not None:
                        score = x @ some.T
                        best = np.argmax(score, axis=1)
                        apart = np.sqrt(np.maximum(2 - 2 * some[best] @ some.T, 0))
                        near = score[np.arange(len(rows)), best][:, None] - score <= step / np.sqrt(dim) * apart
                    for r, v, c in zip(rows, x, near, strict=True):
                        vectors[r], clusters[r] = v.tobytes(), np.flatnonzero(c).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(vectors, pa.binary()), pa.array(clusters, pa.list_(pa.int32()))], names=["node", "dim", "weight", "vector", "clusters"])

    return run, schema


def members(every: DataFrame, centers: dict[int, np.ndarray], p: Params) -> DataFrame:
    """(dim, cluster, chunk, chunks, node, weight, vector, clusters): a row for each cluster that a point belongs to."""
    run, schema = _dealt(centers, p)
    dealt = written(every.select("node", "dim", "weight", "embedding").mapInArrow(run, schema).select("*", F.explode("clusters").alias("cluster")), "dealt")
    chunks = dealt.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / p.shard_most).cast("int").alias("chunks"))
    return dealt.join(chunks, ["dim", "cluster"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _vectors(frame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["vector"])).reshape(len(frame), -1)


def _graph(p: Params):
    built = pruned_graph.Params(degree=p.degree, build_beam=p.build_beam, relax=p.relax)

    def run(frame):
        import pandas as pd

        x, node = _vectors(frame), frame["node"].to_numpy()
        edges, _ = pruned_graph.build(x, built)
        return pd.DataFrame({"node": node, "near": [node[e[e >= 0]] for e in edges]})

    return run


def flat_graph(dealt: DataFrame, p: Params) -> DataFrame:
    """(node, near): the lists that a point has from its shards, united."""
    one = ["dim", "cluster", "chunk"]
    shards = 4 * dealt.select(*one).distinct().count() or 1  # a number of our own: small shards are long work, and must not be put together
    graphs = dealt.select(*one, "node", "vector").repartition(min(shards, 20_000), *one).groupBy(*one).applyInPandas(_graph(p), "node long, near array<long>")
    return written(graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "flat")


def in_range(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, own: np.ndarray | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs of a cosine of p.least or more that a search from the medoid finds, by query. own: the queries' places among the points, if they are points."""
    n, q = len(x), len(queries)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    width = min(p.beam, n)
    found, _ = search(x, edges, entry, queries, width) if n > width else (np.broadcast_to(np.arange(n), (q, n)), None)
    seen = np.zeros((q, n + 1), bool)
    hit = np.zeros((q, n + 1), bool)
    seen[:, n] = True

    def look(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs not seen before that are in range."""
        new = ~seen[rows, at]
        key = np.unique(rows[new] * (n + 1) + at[new])
        rows, at = key // (n + 1), key % (n + 1)
        seen[rows, at] = True
        near = np.empty(len(rows), bool)
        for a in range(0, len(rows), 1 << 16):
            near[a : a + (1 << 16)] = np.einsum("ij,ij->i", queries[rows[a : a + (1 << 16)]], x[at[a : a + (1 << 16)]]) >= p.least
        hit[rows[near], at[near]] = True
        return rows[near], at[near]

    start = np.where(found < 0, n, found)
    if own is not None:
        start = np.hstack([start, own[:, None], np.where(edges[own] < 0, n, edges[own])])
    rows, at = look(np.repeat(np.arange(q), start.shape[1]), start.ravel())
    reach = np.vstack([np.where(edges < 0, n, edges), np.full((1, edges.shape[1]), n)])
    visited = np.zeros(q, np.int64)
    while len(rows):
        visited += np.bincount(rows, minlength=q) * edges.shape[1]
        crowd = visited > n
        for a in np.flatnonzero(crowd & (visited < 1 << 62)):
            hit[a, :n] = x @ queries[a] >= p.least
        visited[crowd] = 1 << 62
        rows, at = rows[~crowd[rows]], at[~crowd[rows]]
        more = [look(np.repeat(rows[a : a + 4096], edges.shape[1]), reach[at[a : a + 4096]].ravel()) for a in range(0, len(rows), 4096)]
        rows, at = (np.concatenate([m[k] for m in more]) if more else np.zeros(0, np.int64) for k in (0, 1))
    return np.nonzero(hit[:, :n])


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that join parts that were apart; label, the least place of each part, is kept up."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while True:
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        if not apart.any():
            return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1))
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        tops, first = np.unique(high, return_index=True)
        label[tops] = low[first]
        out.append((a[first], b[first]))
        while (label[label] != label).any():
            label[:] = label[label]


def _links(p: Params):
    def run(key, graph, asked):
        import pandas as pd

        out = []
        if len(graph):
            cluster, here = int(key[1]), int(key[2]) == int(key[3])
            order = np.argsort(graph["node"].to_numpy())
            graph = graph.iloc[order]
            x, node, weight = _vectors(graph), graph["node"].to_numpy(), graph["weight"].to_numpy()
            near = np.concatenate([np.zeros(0, np.int64), *graph["near"]]).astype(np.int64)
            count = np.array([len(v) for v in graph["near"]])
            at = np.searchsorted(node, near)
            held = (at < len(node)) & (node[np.minimum(at, len(node) - 1)] == near)  # of the flat graph, what leads to points of this shard
            edges = np.full((len(node), int(count.max(initial=1))), -1)
            edges[np.repeat(np.arange(len(node)), count)[held], (np.arange(len(near)) - np.repeat(np.cumsum(count) - count, count))[held]] = at[held]
            mine = _clusters(graph["clusters"])
            frame = graph if here else asked
            whose, theirs = frame["node"].to_numpy(), mine if here else _clusters(frame["clusters"])
            label = np.arange(len(node) + (0 if here else len(frame)))
            for a in range(0, len(frame), p.block):
                rows = np.arange(a, min(a + p.block, len(frame)))
                own = rows if here else None
                i, j = in_range(x, edges, x[rows] if here else _vectors(frame.iloc[rows]), own, p)
                i = i + a
                if here:
                    i, j = i[i != j], j[i != j]
                first = np.ones(len(i), bool)
                for b in range(0, len(i), 1 << 18):
                    s = slice(b, b + (1 << 18))
                    l, r = theirs[i[s]], mine[j[s]]
                    first[s] = ~((l[:, :, None] == r[:, None, :]) & (l < cluster)[:, :, None]).any(axis=(1, 2))
                n = np.bincount(i[first] - a, weight[j[first]], len(rows)).astype(np.int64)
                some = np.flatnonzero(n)
                out.append(pd.DataFrame({"a": whose[rows[some]], "b": np.full(len(some), -1), "n": n[some]}))
                l, r = forest(label, i if here else i + len(node), j)
                ends = node if here else np.concatenate([node, whose])
                out.append(pd.DataFrame({"a": ends[l], "b": ends[r], "n": np.zeros(len(l), np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})

    return run


def _clusters(column) -> np.ndarray:
    """[rows, most] clusters of each row; repeated where there are fewer."""
    wide = max((len(c) for c in column), default=1)
    return np.stack([np.resize(np.asarray(c, np.int64), wide) for c in column]) if len(column) else np.zeros((0, wide), np.int64)


def found_links(dealt: DataFrame, flat: DataFrame, p: Params) -> DataFrame:
    """(a, b, n): b = -1 with a count n of a's links in a shard, or a link (a, b) of a shard's spanning forest."""
    cols = ["node", "weight", "vector", "clusters"]
    graphs = dealt.join(flat, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = dealt.filter("chunks > 1").withColumnRenamed("chunk", "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("chunk <> part")
    one = ["dim", "cluster", "chunk", "part"]
    tasks = min(20_000, 4 * (dealt.groupBy("dim", "cluster").agg(F.max("chunks").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 1))
    renewed = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  new columns: both sides come from one table
    left = graphs.select(*renewed(*one, *cols, "near")).repartition(tasks, *one).groupBy(*one)
    right = asked.select(*renewed(*one, *cols)).repartition(tasks, *one).groupBy(*one)
    return left.cogroup(right).applyInPandas(_links(p), "a long, b long, n long")


def exact_links(every: DataFrame, probes: DataFrame, p: Params) -> DataFrame:
    """(node, n): links of the probes by brute force against all points; probes (node, embedding) are few."""
    import pandas as pd

    rows = probes.select("node", "embedding").toPandas()
    nodes, asked = rows["node"].to_numpy(np.int64), [unit(np.asarray(e, np.float64)[None, :])[0] for e in rows["embedding"]]
    by_dim = {d: np.flatnonzero([len(a) == d for a in asked]) for d in {len(a) for a in asked}}
    by_dim = {d: (at, np.stack([asked[k] for k in at])) for d, at in by_dim.items()}

    def run(batches):
        total = np.zeros(len(nodes), np.int64)
        for frame in batches:
            for dim, part in frame.groupby("dim"):
                if int(dim) in by_dim:
                    at, q = by_dim[int(dim)]
                    near = unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)) @ q.T >= p.least
                    near &= part["node"].to_numpy()[:, None] != nodes[at][None, :]
                    total[at] += part["weight"].to_numpy() @ near
        yield pd.DataFrame({"node": nodes, "n": total})

    return every.select("node", "dim", "weight", "embedding").mapInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audited_recall(every: DataFrame, counts: DataFrame, p: Params) -> float:
    """The part of the links of a bounded set of probes that was found: half of the probes have links, half are any points."""
    order = F.xxhash64(F.lit(7), "h1", "h2")
    linked = every.join(counts.select("node"), "node", "left_semi").orderBy(order).limit(p.probes // 2)
    probes = linked.unionByName(every.orderBy(order).limit(p.probes // 2)).select("node", "embedding").dropDuplicates(["node"])
    exact = exact_links(every, probes, p).join(counts.select("node", F.col("n").alias("found")), "node", "left")
    found, there = exact.agg(F.sum(F.least("n", F.coalesce("found", F.lit(0)))), F.sum("n")).first()
    return found / there if there else 1.0


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", p: Params = Params()) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of vectors."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    use, rest = rows.filter(usable()), rows.filter(~usable())
    every = points(use)
    centers = centers_of(every, p)
    while True:
        dealt = members(every, centers, p)
        found = written(found_links(dealt, flat_graph(dealt, p), p), "found")
        counts = written(found.filter("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts")
        if p.reach > 64 or max(map(len, centers.values()), default=1) == 1 or audited_recall(every, counts, p) >= p.recall:
            break
        p = replace(p, reach=2 * p.reach)
    labels = written(components(found.filter("b <> -1").select("a", "b")), "labels")
    own = every.select("node", "h1", "h2", "weight", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(counts, "node", "left")
    least = own.groupBy("label").agg(F.min("id").alias("component_id"))
    named = own.join(least, "label").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    with_links = rekeyed(use.select("vec_id", *_hashes()), "h1").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = with_links.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_flat_graph(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reached AS (SELECT a AS start, a AS node FROM links UNION SELECT reached.start, links.b FROM reached JOIN links ON links.a = reached.node),
least AS (SELECT start, min(node) AS component_id FROM reached GROUP BY start),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id IS NOT NULL AND coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.start = vec_id
"""
