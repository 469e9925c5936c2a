"""Forests that are known by parents alone, by pointer doubling.

After k rounds a node knows what lies on the 2^k steps above it, so a chain of any depth takes the logarithm of its length
in rounds, each a join of the pointers with themselves. A pointer that has come to a root rests there and isn't joined
again. Nodes that never come to rest reach a cycle: a round in which none came to rest shows them, as a tree would have
had one. Every round is a staged table, so a lost executor costs one round.

nodes(id, parent_id) have unique ids; a null parent makes a root. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.staging import staged


class BadTree(ValueError):
    """Parents that don't make one tree a library."""


def _renewed(df: DataFrame, key: str) -> DataFrame:
    """df with the key as a new expression, so that a join on it deals df anew and may split crowded keys."""
    return df.withColumn(key, F.bitwise_not(F.bitwise_not(F.col(key))))


def pointers(nodes: DataFrame) -> DataFrame:
    """(id, up, steps, rests, orphan): a node's parent one step up; roots, and orphans, whose parent isn't there, rest at themselves."""
    there = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    met = _renewed(nodes.select("id", F.col("parent_id").cast("long").alias("parent_id")), "parent_id").join(there, "parent_id", "left")
    rests = F.col("there").isNull()
    return met.select("id", F.when(rests, F.col("id")).otherwise(F.col("parent_id")).alias("up"), (~rests).cast("long").alias("steps"), rests.alias("rests"), (rests & F.col("parent_id").isNotNull()).alias("orphan"))


def _doubled(now: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Pointers twice as long. extra: columns by name, of a row and, as up_<name>, of the row that it points to."""
    names = list(extra or {})
    above = now.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("steps").alias("up_steps"), F.col("rests").alias("up_rests"), *[F.col(c).alias(f"up_{c}") for c in names])
    moving = _renewed(now.filter("not rests"), "up").join(above, "up")
    rest = [c for c in now.columns if c not in {"up", "steps", "rests", *names}]
    moved = moving.select(*rest, F.col("up_up").alias("up"), (F.col("steps") + F.col("up_steps")).alias("steps"), F.col("up_rests").alias("rests"), *[e.alias(c) for c, e in (extra or {}).items()])
    return now.filter("rests").unionByName(moved)


def depths(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, state) of every node: tree, orphan (it or what it hangs from has a parent that isn't there), cycle or below_cycle. In and below cycles root and depth are null."""
    now = staged(pointers(nodes), "pointers")
    left = now.filter("not rests").count()
    while left:
        now = staged(_doubled(now), "pointers")
        still = now.filter("not rests").count()
        if still == left:
            break
        left = still
    orphans = now.filter("orphan and up = id").select(F.col("id").alias("up"), F.lit(True).alias("lost"))
    settled = now.filter("rests").join(orphans, "up", "left").select("id", F.col("up").alias("root"), F.col("steps").alias("depth"), F.when(F.col("lost"), "orphan").otherwise("tree").alias("state"))
    if not left:
        return settled
    return settled.unionByName(_cyclic(now.filter("not rests").select("id"), nodes, left))


def _cyclic(loose: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """Which of the nodes that never come to a root are in cycles: those that others still point to when all pointers are as long as there are nodes."""
    step = staged(nodes.select("id", F.col("parent_id").cast("long").alias("up")).join(loose, "id", "left_semi"), "loose")
    reach = 1
    while reach < many:
        step = staged(_renewed(step, "up").join(step.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "loose")
        reach *= 2
    inside = step.select(F.col("up").alias("id")).distinct().withColumn("inside", F.lit(True))
    state = F.when(F.col("inside"), "cycle").otherwise("below_cycle")
    none = F.lit(None).cast("long")
    return loose.join(inside, "id", "left").select("id", none.alias("root"), none.alias("depth"), state.alias("state"))


def descendants(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(id) of the nodes of tops(id) and of all below them, each once, in cycles too."""
    start = tops.select("id").distinct().withColumn("hit", F.lit(True))
    now = staged(pointers(nodes).join(start, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "hits")
    left, many, reach = now.filter("not rests").count(), None, 1
    while left:
        many = many or now.count()
        # pointers start one step up: what a row has seen is itself, and all below the row that it points to
        now = staged(_doubled(now, {"hit": F.col("hit") | F.col("up_hit")}), "hits")
        left, reach = now.filter("not rests and not hit").count(), 2 * reach
        if reach > many:
            break
    at_rest = now.join(start.select(F.col("id").alias("up"), F.lit(True).alias("top")), "up", "left")  # a pointer at rest hasn't looked at the root itself
    return at_rest.filter("hit or top").select("id")


def ancestors(nodes: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, ancestor, distance) of every node and all above it, at most `longest` steps; the table of a deep chain is the square of its depth. Cycles must not be there."""
    up = nodes.filter("parent_id is not null").select("id", F.col("parent_id").cast("long").alias("up"))
    step = staged(up, "steps")
    pairs, reach = step.select("id", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("distance")), 1
    while not step.isEmpty() and (longest is None or reach < longest):
        # step leads 2^k up, pairs know all within 2^k: what a step leads to knows the next 2^k
        seen = pairs.select(F.col("id").alias("up"), "ancestor", (F.col("distance") + reach).alias("distance"))
        more = _renewed(step, "up").join(seen, "up").select("id", "ancestor", "distance")
        pairs = staged(pairs.unionByName(more), "pairs")
        step = staged(_renewed(step, "up").join(step.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "steps")
        reach *= 2
    return pairs if longest is None else pairs.filter(F.col("distance") <= longest)


def subtree_sums(nodes: DataFrame, value: str) -> DataFrame:
    """(id, total) of nodes(id, parent_id, value): the sum of each node's value and all below it.

    A node sends what it has to where its pointer leads: after k rounds it holds the sums of the 2^k levels from itself on.
    Sums are added up within tasks before they are shuffled, so a node with very many children is no crowd.
    """
    own = nodes.select("id", F.coalesce(F.col(value), F.lit(0)).cast("long").alias("total"))
    step = staged(nodes.filter("parent_id is not null").select("id", F.col("parent_id").cast("long").alias("up")), "steps")
    total = staged(own, "sums")
    while not step.isEmpty():
        sent = step.join(total, "id").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("more"))
        total = staged(total.join(sent, "id", "left").select("id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "sums")
        step = staged(_renewed(step, "up").join(step.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "steps")
    return total


def problems(directories: DataFrame) -> DataFrame:
    """(problem, id) of directories(id, library_id, parent_id) that keep a library from being one tree: cycles and what hangs from them, orphans, a second root, a parent of another library, a library without a root."""
    state = depths(directories).filter("state <> 'tree'").select(F.col("state").alias("problem"), "id")
    roots = directories.filter("parent_id is null").groupBy("library_id").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    second = directories.filter("parent_id is null").join(roots.filter("n > 1"), "library_id").filter("id <> least").select(F.lit("second_root").alias("problem"), "id")
    without = directories.join(roots, "library_id", "left_anti").groupBy("library_id").agg(F.min("id").alias("id")).select(F.lit("no_root").alias("problem"), "id")
    parent = directories.select(F.col("id").alias("parent_id"), F.col("library_id").alias("above"))
    foreign = _renewed(directories.filter("parent_id is not null"), "parent_id").join(parent, "parent_id").filter("above <> library_id").select(F.lit("other_library").alias("problem"), "id")
    return state.unionByName(second).unionByName(without).unionByName(foreign)


def rollup(directories: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, direct_count, recursive_count, child_count) of every directory by parents alone, whatever the depth. Raises BadTree where parents don't make one tree a library: nothing is counted then."""
    directories = staged(directories.select("id", "library_id", "parent_id"), "directories")
    bad = problems(directories).groupBy("problem").count().collect()  # a row a kind of problem
    if bad:
        raise BadTree(", ".join(f"{r['problem']}: {r['count']}" for r in sorted(bad)))
    direct = assets.groupBy(F.col("directory_id").alias("id")).agg(F.count("*").alias("direct"))
    sized = staged(directories.select("id", "parent_id").join(direct, "id", "left"), "sized")
    children = sized.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children")).filter("id is not null")
    out = sized.join(subtree_sums(sized, "direct"), "id").join(children, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("direct", "direct_count"), ("total", "recursive_count"), ("children", "child_count"))])
