"""Nearest neighbours by largest inner product, with robust-pruned directed graphs.

Distinct vectors are dealt over shards of bounded size by a hash. A shard's graph is built in batches: greedy searches
over the graph so far propose neighbours, relaxed distance pruning keeps diverse ones, and reverse edges are pruned
again where a node has too many. A coordinate that lifts all vectors to one length turns the largest inner product into
the least distance. Lengths that differ much make that hard to search, so each shard finds its own beam: doubled until a
bounded sample of its vectors has the wanted recall against the shard's exact answers.

A shard's graph stays where it is, and the queries are sent to it: once for each shard, the graph once for every `part`
queries. Shards grow with the rows from `shard_rows` to `shard_most`, so that a query meets about `shards` of them until
these are as large as a task may hold. The best of all shards are kept. Nothing that grows with the rows is broadcast or
collected; equal vectors are one point that knows its smallest ids.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of
another dimension are searched among themselves. Repeated rows count once. Where an id has several vectors, a pair of ids
has the best of their products, once; rows of the query's own id are never found. Ties go to the smaller id. Columns
beside the two named are not looked at; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table, written


@dataclass(frozen=True)
class Params:
    """degree: edges of a node at most. beam: candidates that a search keeps at least. relax: how much farther a kept neighbour may be than one that already leads there. recall: wanted of a shard's `probes`."""

    k: int = 20
    shard_rows: int = 4096
    shard_most: int = 65_536
    shards: int = 64
    query_rows: int = 1024
    part: int = 65_536
    probes: int = 64
    recall: float = 0.97
    degree: int = 32
    build_beam: int = 64
    beam: int = 96
    relax: float = 1.2


def search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances [queries, beam] found from the entry, nearest first; -1 where there are fewer. edges: -1 for none."""
    q, n = len(queries), len(points)
    norms = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, entry] = seen[:, n] = True
    ids = np.full((q, beam), n)
    dist = np.full((q, beam), np.inf)
    ids[:, 0] = entry
    dist[:, 0] = own + norms[entry] - 2 * queries @ points[entry]
    open_ = np.zeros((q, beam), bool)
    open_[:, 0] = True
    reach = np.vstack([np.where(edges < 0, n, edges), np.full((1, edges.shape[1]), n)])
    while open_.any():
        pick = np.argsort(np.where(open_, dist, np.inf), axis=1)[:, :wide]
        chosen = np.where(open_[rows, pick], ids[rows, pick], n)
        open_[rows, pick] = False
        near = np.sort(reach[chosen].reshape(q, -1), axis=1)
        new = ~seen[rows, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows, near] = True
        r, c = np.nonzero(new)
        far = np.full(near.shape, np.inf)
        at = near[r, c]
        far[r, c] = own[r] + norms[at] - 2 * np.einsum("ij,ij->i", queries[r], points[at])
        near = np.where(new, near, n)
        dist, ids, open_ = np.hstack([dist, far]), np.hstack([ids, near]), np.hstack([open_, new])
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        dist, ids, open_ = dist[rows, best], ids[rows, best], open_[rows, best]
    order = np.argsort(dist, axis=1, kind="stable")
    dist, ids = dist[rows, order], ids[rows, order]
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse neighbours [len(of), degree] of the nodes: the nearest candidate, less all that it is `relax` times nearer to, and so on."""
    c = np.sort(candidates, axis=1)
    bad = (c < 0) | (c == of[:, None])
    bad[:, 1:] |= c[:, 1:] == c[:, :-1]
    x = points[np.where(bad, 0, c)]
    to = ((x - points[of][:, None, :]) ** 2).sum(axis=2)
    to[bad] = np.inf
    order = np.argsort(to, axis=1)
    rows = np.arange(len(of))[:, None]
    c, x, to = c[rows, order], x[rows, order], to[rows, order]
    norm = (x**2).sum(axis=2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
    out, one = np.full((len(of), degree), -1), np.arange(len(of))
    alive = np.isfinite(to)
    for k in range(degree):
        if not alive.any():
            break
        first = np.argmax(alive, axis=1)
        some = alive[one, first]
        out[some, k] = c[one, first][some]
        alive &= ~((relax**2 * between[one, first] <= to) & some[:, None])
        alive[one, first] = False
    return out


def build(points: np.ndarray, p: Params) -> tuple[np.ndarray, int]:
    """Edges [n, degree] and the entry, the point nearest to the mean."""
    n = len(points)
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    edges = np.full((n, p.degree), -1)
    done = 1
    for sweep in range(2):  # the second time over the whole graph
        done = 1 if not sweep else 0
        while done < n:
            batch = order[done : done + (min(512, max(16, done)) if not sweep else 512)]
            found, _ = search(points, edges, entry, points[batch], p.build_beam)
            peers = np.broadcast_to(batch[: p.degree], (len(batch), min(len(batch), p.degree)))  # a batch's members don't see each other
            edges[batch] = prune(points, batch, np.hstack([found, edges[batch], peers]), p.degree, p.relax)
            source, target = np.repeat(batch, p.degree), edges[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, start, count = np.unique(target, return_index=True, return_counts=True)
            for a in range(0, len(nodes), 512):
                for c in range(0, int(count[a : a + 512].max()), 4 * p.degree):  # some nodes are pointed to by very many
                    more = np.flatnonzero(count[a : a + 512] > c) + a
                    width = min(int(count[more].max()) - c, 4 * p.degree)
                    at = start[more][:, None] + c + np.arange(width)
                    back = np.where(at < (start[more] + count[more])[:, None], source[np.minimum(at, len(source) - 1)], -1)
                    edges[nodes[more]] = prune(points, nodes[more], np.hstack([edges[nodes[more]], back]), p.degree, p.relax)
            done += len(batch)
    return edges, entry


def lifted(x: np.ndarray) -> np.ndarray:
    length = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(length.max() - length, 0))[:, None]])


def fitted_beam(x: np.ndarray, edges: np.ndarray, entry: int, p: Params) -> int:
    """The beam with which the vectors of a sample find enough of their exact neighbours among x."""
    probes = x[np.random.default_rng(len(x)).permutation(len(x))[: p.probes]]
    k, beam = min(p.k, len(x)), max(p.beam, p.k + 2)
    exact = probes @ x.T
    least = -np.partition(-exact, k - 1, axis=1)[:, k - 1 :k]
    while beam < len(x):
        found, _ = search(lifted(x), edges, entry, _flat(probes), beam)
        good = (np.take_along_axis(exact, np.maximum(found, 0), 1) >= least) & (found >= 0)
        if np.minimum(good.sum(axis=1), k).mean() >= p.recall * k:
            break
        beam *= 2
    return min(beam, max(len(x), p.k + 2))


def _flat(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def _index(p: Params):
    def run(frame):
        import pandas as pd

        x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        edges, entry = build(lifted(x), p)
        ids = np.concatenate(frame["ids"].to_numpy()).astype(np.int64)
        counts = np.array([len(i) for i in frame["ids"]], np.int64)
        one = {"dim": x.shape[1], "shard": int(frame["shard"].iloc[0]), "vectors": x.tobytes(), "edges": edges.astype(np.int32).tobytes(), "entry": entry, "beam": fitted_beam(x, edges, entry, p), "ids": ids.tobytes(), "counts": counts.tobytes()}
        return pd.DataFrame({k: [v] for k, v in one.items()})

    return run


def _search(p: Params):
    def run(graph, asked):
        import pandas as pd

        out = []
        if len(graph) and len(asked):
            g = graph.iloc[0]
            x = np.frombuffer(g["vectors"]).reshape(-1, int(g["dim"]))
            edges = np.frombuffer(g["edges"], np.int32).reshape(len(x), -1).astype(np.int64)
            ids, counts = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["counts"], np.int64)
            at, points = np.concatenate([[0], np.cumsum(counts)]), lifted(x)
            every, whose = np.stack(asked["embedding"].to_numpy()).astype(np.float64), asked["vec_id"].to_numpy(np.int64)
            for a in range(0, len(every), p.query_rows):
                q, q_ids = every[a : a + p.query_rows], whose[a : a + p.query_rows]
                found, _ = search(points, edges, int(g["entry"]), _flat(q), int(g["beam"]))
                i, j = np.nonzero(found >= 0)
                node = found[i, j]
                score = (x[node] * q[i]).sum(axis=1)
                n = counts[node]
                vec = ids[np.repeat(at[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                row, score = np.repeat(i, n), np.repeat(score, n)
                other = vec != q_ids[row]
                row, vec, score = row[other], vec[other], score[other]
                order = np.lexsort((vec, -score, row))
                row, vec, score = row[order], vec[order], score[order]
                _, start, count = np.unique(row, return_index=True, return_counts=True)
                best = np.arange(len(row)) - np.repeat(start, count) < p.k
                out.append(pd.DataFrame({"query_id": q_ids[row[best]], "vec_id": vec[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0))


def index(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per shard of usable vectors (vec_id, embedding): its vectors, ids, graph and entry."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    points = vectors.distinct().withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= p.k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    points = written(points.withColumn("dim", F.size("embedding")), "points")
    rows = F.greatest(F.lit(p.shard_rows), F.least(F.lit(p.shard_most), F.ceil(F.count("*") / p.shards)))
    shards = points.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("shards"))
    dealt = points.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))
    schema = "dim int, shard int, vectors binary, edges binary, entry int, beam int, ids binary, counts binary"
    tasks = 4 * (shards.agg(F.sum("shards")).first()[0] or 1)  # a number of our own: small shards are long work, and must not be put together
    return written(dealt.select("dim", "shard", "embedding", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(_index(p), schema), "graphs")


def nearest(queries: DataFrame, graphs: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) of usable queries (vec_id, embedding)."""
    q = queries.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))
    parts = q.groupBy("dim").agg(F.ceil(F.count("*") / p.part).cast("int").alias("parts"))
    last = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = q.join(parts, "dim").join(last, "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int"))
    sent = sent.select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "part", "vec_id", "embedding")
    copies = graphs.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    tasks = min(4 * (copies.select("dim").count() or 1), 20_000)
    one = ["dim", "shard", "part"]
    left, right = (df.repartition(tasks, *one).groupBy(*one) for df in (copies, sent))
    found = left.cogroup(right).applyInPandas(_search(p), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op8_pruned_graph(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 20 = 0"), index(vectors))
