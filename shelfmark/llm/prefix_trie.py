"""The trie of conversation prefixes, by a mergesort that knows common prefixes.

A conversation is the sequence of its turns' digests. Equal sequences become one with their count, least id and the hash
of their ids. The distinct ones are sorted in two passes with Spark's shuffle between them. First, tasks sort batches into
runs, in which every sequence carries its LCP: the number of turns that it shares with the one before. Then the key range
is cut by quantiles into parts of bounded size, and each part merges the pieces of its runs with a loser tree that compares
LCPs first and turns only behind them, so that turns once found equal are not compared again.

The merged stream keeps a stack of open nodes, the path of the last sequence. A sequence closes what lies below its LCP
and opens the rest of its own path; a closed node has met all its members and is emitted, its sums go to its parent. Nodes
on the first or last path of a part may have members in other parts. They are kept aside with what they have, and closed by
merging the paths of `fan` parts at a time, by the same stack, until one is left. No part, path or stack holds more than a
range, and the paths of `fan` parts.

Turns stand by number, null first; equal numbers by role, then by the digest of the text. Null roles and texts are empty.
Repeated rows are turns of their own. Rows with a null conversation are left out. Texts may be of any length; one
conversation is one row of digests, so it may have some ten million turns. The ids of the conversations that end at a
node are streamed in order through its hash, one node after the other. Other columns are not looked at, whatever their
names. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import crc_sql, rekeyed, table, written

WIDE = 16  # bytes of a turn's digest


@dataclass(frozen=True)
class Params:
    """group, heads: a conversation begins with up to heads - 1 turns of the first of its group of ids. range_bytes: of sequences in a part of the merge, about. fan: parts whose border paths meet in one task."""

    group: int = 5
    heads: int = 9
    range_bytes: int = 8 << 20
    fan: int = 64


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation an array of (digest, size), in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDE)
    one = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    in_order = F.sort_array(F.collect_list("one"))
    return rows.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, p: Params = Params()) -> DataFrame:
    """(conv_id, turns) with the first h turns from the first conversation of the id's group, the rest from the conversation itself."""
    own = written(sequences(turns), "sequences")
    heads = own.select(F.col("conv_id").alias("first"), F.slice("turns", 1, p.heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % p.heads).cast("int")
    from_first = F.when(F.col("head").isNotNull() & (h > 0), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", 1, 0))
    from_own = F.slice("turns", h + 1, F.size("turns"))
    return own.withColumn("first", F.col("conv_id") - F.col("conv_id") % p.group).join(heads, "first", "left").select("conv_id", F.concat(from_first, from_own).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, least and hash of the ids of each key; rows come sorted by key and id, and are hashed as they come."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    now, n, least, state = None, 0, 0, None
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, a = [], 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if keys[a] != now:
                if now is not None:
                    out.append((now, n, least, state.hexdigest()))
                now, n, least, state = keys[a], 0, ids[a], hashlib.sha256()
            state.update(((b"," if n else b"") + ",".join(map(str, ids[a:b])).encode()))
            n, a = n + b - a, b
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 4, schema, strict=True)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((now, n, least, state.hexdigest()), schema, strict=True)], schema=schema)


def distinct(conversations: DataFrame) -> DataFrame:
    """(seq, sizes, n, least, ends) of the distinct sequences: digests one after the other, sizes of the texts, members and the hash of their ids."""
    hexed = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = conversations.select("conv_id", F.unhex(hexed).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    keyed = written(rows.withColumn("key", F.substring(F.unhex(F.sha2("seq", 256)), 1, WIDE)), "conversations")
    ends = keyed.select("key", "conv_id").distinct().repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key binary, n long, least long, ends string")
    one = keyed.groupBy("key").agg(F.first(F.struct("seq", "sizes")).alias("s"))
    return one.join(ends, "key").select("s.seq", "s.sizes", "n", "least", "ends")


def common(a: bytes, b: bytes, start: int) -> int:
    """Number of turns that a and b share; the first `start` are known to be equal."""
    most = min(len(a), len(b)) // WIDE
    step = 1
    while start < most:
        end = min(start + step, most)
        if a[start * WIDE : end * WIDE] == b[start * WIDE : end * WIDE]:
            start, step = end, 2 * step
        elif end == start + 1:
            break
        else:
            step = 1
    return start


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch sorted, with run, place and LCP."""
    from pyspark import TaskContext

    run = TaskContext.get().partitionId() << 32
    for batch in batches:
        seqs = batch.column(0).to_pylist()
        order = sorted(range(len(seqs)), key=seqs.__getitem__)
        lcps = [0, *(common(seqs[i], seqs[j], 0) for i, j in zip(order, order[1:], strict=False))][: len(seqs)]
        mine = [pa.array([run] * len(seqs), pa.int64()), pa.array(range(len(seqs)), pa.int64()), pa.array(lcps, pa.int64())]
        yield pa.RecordBatch.from_arrays([*mine, *batch.take(pa.array(order, pa.int64())).columns], names=["run", "place", "lcp", *batch.schema.names])
        run += 1


def merged(runs: list[list[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """The sequences of sorted runs of (seq, LCP with the one before in the run, load) in one order, with LCPs in that order: a loser tree.

    Every waiting head keeps the LCP that it has with the last winner. Of two heads the one with more in common with it
    is less; only if they have the same in common are they compared, from there on.
    """
    runs = [r for r in runs if r]
    if not runs:
        return
    size = 1 << (len(runs) - 1).bit_length()
    at, lcp = [0] * len(runs), [0] * len(runs)
    heads: list[bytes | None] = [r[0][0] for r in runs]

    def less(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; -1 is a run without a head."""
        if a < 0 or b < 0 or heads[a] is None or heads[b] is None:
            return (a, b) if b < 0 or (a >= 0 and heads[b] is None) else (b, a)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = heads[a], heads[b]
        n = common(x, y, lcp[a])
        first, last = (a, b) if x[n * WIDE : (n + 1) * WIDE] <= y[n * WIDE : (n + 1) * WIDE] else (b, a)
        lcp[last] = n
        return first, last

    losers = [-1] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size if node - size < len(runs) else -1
        first, losers[node] = less(play(2 * node), play(2 * node + 1))
        return first

    top = play(1)
    while heads[top] is not None:
        own = runs[top]
        yield own[at[top]][0], lcp[top], own[at[top]][2]
        at[top] += 1
        if at[top] < len(own):
            heads[top], lcp[top], _ = own[at[top]]
        else:
            heads[top] = None
        node = (top + size) // 2
        while node:
            top, losers[node] = less(top, losers[node])
            node //= 2


class Node:
    """An open node: what it has met so far. first: it is on the first path of its part, and may have begun before it."""

    __slots__ = ("children", "depth", "ends", "first", "key", "least", "leaves", "n", "parent", "saved", "size")

    def __init__(self, key: bytes, parent: bytes | None, depth: int, size: int, first: bool):
        self.key, self.parent, self.depth, self.size, self.first = key, parent, depth, size, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends = None, None

    def add(self, n: int, least: int | None, ends: str | None = None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        self.least = least if self.least is None or (least is not None and least < self.least) else self.least
        self.ends = ends or self.ends


COLUMNS = "part long, place long, open boolean, first boolean, node binary, parent binary, depth long, size long, n long, least long, ends string, children long, leaves long, saved long"
_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in COLUMNS.split(", ")])


class Path:
    """The stack of open nodes. Finished nodes go to `out`; those that may go on in another part are kept for the end."""

    def __init__(self, part: int):
        self.part, self.stack, self.out, self.border = part, [], [], []

    def close(self, depth: int) -> None:
        """Closes what lies at `depth` or below."""
        while len(self.stack) > depth:
            x = self.stack.pop()
            if x.first:
                continue
            x.leaves = x.leaves or 1
            x.saved += (x.n - 1) * x.size
            if self.stack:
                self.stack[-1].add(x.n, x.least, None, 1, x.leaves, x.saved)
            self.out.append(self.row(x, -1, False))

    def open(self, x: Node) -> Node:
        self.stack.append(x)
        self.border.append(x)
        return x

    def end(self, last: bool) -> None:
        """The part is over; if it is the last there is, so are all its nodes."""
        if last:
            self.close(0)
        open_ = {id(x) for x in self.stack}
        self.out += [self.row(x, k, True) for k, x in enumerate(x for x in self.border if x.first or id(x) in open_)]

    def trim(self) -> None:
        """Forgets closed nodes."""
        open_ = {id(x) for x in self.stack}
        self.border = [x for x in self.border if x.first or id(x) in open_]

    def row(self, x: Node, place: int, open_: bool) -> tuple:
        return (self.part, place, open_, x.first, x.key, x.parent, x.depth, x.size, x.n, x.least, x.ends, x.children, x.leaves, x.saved)

    def batches(self, at_least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= at_least:
            self.trim()
            rows, self.out = self.out, []
            for a in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 8192], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def child_key(parent: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(parent + digest, digest_size=WIDE).digest()


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one part: its runs are merged, and the stack follows the stream. Rows come sorted by run and place."""
    from pyspark import TaskContext

    runs, now = [], None
    for batch in batches:
        run, _, lcp, *rest = (c.to_pylist() for c in batch.columns)
        for r, c, seq, *load in zip(run, lcp, *rest, strict=True):
            if r != now:
                runs.append([])
                now, c = r, 0  # the one before it is in another part
            runs[-1].append((seq, c, load))
    path = Path(TaskContext.get().partitionId())
    for seq, lcp, (sizes, n, least, ends) in merged(runs):
        first = not path.stack
        if first:
            path.open(Node(b"", None, 0, 0, True))
        path.close(lcp + 1)
        for d in range(lcp, len(sizes)):
            above = path.stack[-1].key
            path.open(Node(child_key(above, seq[d * WIDE : (d + 1) * WIDE]), above, d + 1, sizes[d], first))
        path.stack[-1].add(n, least, ends)
        yield from path.batches(8192)
    path.end(False)
    yield from path.batches(1)


def _combine(last: bool):
    """Nodes of groups of parts: their border paths, sorted by part and place, run through one stack."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first_part = None, None
        for batch in batches:
            for group, part, _, _, first, key, parent, depth, size, n, least, ends, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is None or path.part != group:
                    if path is not None:
                        path.end(last)
                        yield from path.batches(1)
                    path, first_part = Path(group), part
                if depth >= len(path.stack) or path.stack[depth].key != key:  # else the node goes on, and what is open below it may, too
                    path.close(depth)
                    path.open(Node(key, parent, depth, size, first and part == first_part and not last))
                path.stack[depth].add(n, least, ends, children, leaves, saved)
            if path is not None:
                yield from path.batches(8192)
        if path is not None:
            path.end(last)
            yield from path.batches(1)

    return run


def nodes(seqs: DataFrame, p: Params = Params()) -> DataFrame:
    """(node, parent, depth, n, least, ends, children, leaves, saved): a row for each node of the trie of the distinct sequences `seqs`."""
    runs = written(seqs.select("seq", "sizes", "n", "least", "ends").mapInArrow(_runs, "run long, place long, lcp long, seq binary, sizes array<long>, n long, least long, ends string"), "runs")
    total = runs.agg(F.sum(F.octet_length("seq") + 8 * F.size("sizes") + 120)).first()[0] or 0
    parts = max(1, -(-total // p.range_bytes))
    found = written(runs.repartitionByRange(parts, "seq").sortWithinPartitions("run", "place").mapInArrow(_merge, COLUMNS), "nodes")
    done, border = found.filter("not open"), found.filter("open")
    while True:
        many = (border.agg(F.max("part")).first()[0] or 0) + 1
        last = many <= p.fan
        groups = border.select(F.floor(F.col("part") / p.fan).cast("long").alias("group"), *border.columns)
        met = groups.repartition(-(-many // p.fan), "group").sortWithinPartitions("group", "part", "place")
        met = met.mapInArrow(_combine(last), COLUMNS)
        found = written(met, "nodes")
        done, border = done.unionByName(found.filter("not open")), found.filter("open")
        if last:
            return done.select("node", "parent", "depth", "n", "least", "ends", "children", "leaves", "saved")


def trie(turns: DataFrame, p: Params = Params()) -> DataFrame:
    """The nodes of rebuilt conversations as the query returns them."""
    every = nodes(distinct(rebuilt(turns, p)), p)
    above = every.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    out = every.join(above, "parent", "left")
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: Nodes by their whole paths, sums over all descendants.
OP13_SQL = f"""
WITH own AS (
    SELECT conv_id, list(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns,
        list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS sizes
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
cut AS (SELECT *, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM own),
rebuilt AS (
    SELECT cut.conv_id, coalesce(f.turns[:h], []) || cut.turns[h + 1:] AS turns, coalesce(f.sizes[:h], []) || cut.sizes[h + 1:] AS sizes
    FROM cut LEFT JOIN own f ON f.conv_id = cut.conv_id - cut.conv_id % 5
),
paths AS (SELECT conv_id, d, len(turns) AS n, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, sha256(array_to_string(turns[:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(turns[:d - 1], ',')) END AS parent, list_transform(range(d + 1), lambda k: sha256(array_to_string(turns[:k], ','))) AS line
          FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, d, any_value(parent) AS parent, any_value(line) AS line, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM paths GROUP BY node, d),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT unnest(line) AS node, saved, c.n_children IS NULL AS leaf FROM nodes LEFT JOIN children c USING (node)),
sums AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM below GROUP BY node)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes up ON up.node = x.parent LEFT JOIN children c ON c.node = x.node JOIN sums s ON s.node = x.node
"""
