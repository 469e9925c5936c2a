"""Trees of directories with parents and materialised paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.operators import forest


def subtree(directories: DataFrame, root: int) -> DataFrame:
    """A directory and all below it, in its library, by path; one row of it is all that is broadcast."""
    top = directories.filter(F.col("id") == root).select(F.col("library_id").alias("l"), F.col("relative_path").alias("p"))
    below = (F.col("p") == "") | (F.col("relative_path") == F.col("p")) | F.col("relative_path").startswith(F.concat("p", F.lit("/")))
    return directories.join(F.broadcast(top), (F.col("library_id") == F.col("l")) & below).drop("l", "p")


def ancestor_pairs(directories: DataFrame) -> DataFrame:
    """(id, library_id, ancestor_path, depth) of every directory, itself included."""
    return directories.select("id", "library_id", "relative_path", F.posexplode(X.path_ancestors(F.col("relative_path"))).alias("depth", "ancestor_path"))


def overlaps(directories: DataFrame) -> DataFrame:
    """(a, b): pairs of directories of a library of which a holds b or has its path. a's path is an ancestor path of b, so an equality join finds them."""
    inner = ancestor_pairs(directories).select("library_id", F.col("id").alias("b"), F.col("ancestor_path").alias("relative_path"))
    return directories.select("library_id", F.col("id").alias("a"), "relative_path").join(inner, ["library_id", "relative_path"]).filter("a <> b").select("a", "b")


def lineage(directories: DataFrame, node: int) -> DataFrame:
    """Root to node."""
    up = ancestor_pairs(directories.filter(F.col("id") == node)).select("library_id", F.col("ancestor_path").alias("relative_path"), "depth")
    return directories.join(up, ["library_id", "relative_path"]).select("depth", "id", "library_id", "name", "relative_path")


def breadcrumbs(directories: DataFrame, libraries: DataFrame) -> DataFrame:
    """For every directory the names from the root, which is called after its library, joined by ' > '."""
    up = ancestor_pairs(directories)
    named = directories.join(libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name")), "library_id")
    named = named.select("library_id", F.col("relative_path").alias("ancestor_path"), F.when(F.col("relative_path") == "", F.col("library_name")).otherwise(F.col("name")).alias("label"))
    joined = up.join(named, ["library_id", "ancestor_path"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "label"))).alias("x"))
    return joined.select("id", F.array_join(F.transform("x", lambda r: r["label"]), " > ").alias("breadcrumbs"), F.size("x").cast("long").alias("depth"))


def rollup_counts(directories: DataFrame, assets: DataFrame) -> DataFrame:
    """Direct and recursive asset counts, and child counts, of every directory. Assets are summed by directory before paths are exploded."""
    direct = assets.groupBy(F.col("directory_id").alias("id")).agg(F.count("*").alias("direct"))
    sized = directories.select("id", "library_id", "relative_path").join(direct, "id")
    up = sized.select("library_id", "direct", F.explode(X.path_ancestors(F.col("relative_path"))).alias("relative_path"))
    total = up.groupBy("library_id", "relative_path").agg(F.sum("direct").alias("total"))
    children = directories.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children")).filter("id is not null")
    out = directories.join(direct, "id", "left").join(total, ["library_id", "relative_path"], "left").join(children, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("direct", "direct_count"), ("total", "recursive_count"), ("children", "child_count"))])


def incremental_rollup(directories: DataFrame, counts: DataFrame, changes: DataFrame) -> DataFrame:
    """counts(id, direct_count, recursive_count) after changes(id, delta) of direct counts: only ancestors of changed directories move."""
    moved = directories.select("id", "library_id", "relative_path").join(changes, "id")
    up = moved.select("library_id", "delta", F.explode(X.path_ancestors(F.col("relative_path"))).alias("relative_path")).groupBy("library_id", "relative_path").agg(F.sum("delta").alias("up"))
    here = directories.select("id", "library_id", "relative_path").join(up, ["library_id", "relative_path"]).select("id", "up")
    out = counts.join(here, "id", "left").join(changes, "id", "left")
    return out.select("id", (F.col("direct_count") + F.coalesce("delta", F.lit(0))).alias("direct_count"), (F.col("recursive_count") + F.coalesce("up", F.lit(0))).alias("recursive_count"))


def has_children(directories: DataFrame) -> DataFrame:
    parents = directories.select(F.col("parent_id").alias("id")).filter("id is not null").distinct().withColumn("has_children", F.lit(True))
    return directories.select("id").join(parents, "id", "left").select("id", F.coalesce("has_children", F.lit(False)).alias("has_children"))


def integrity(directories: DataFrame, assets: DataFrame) -> DataFrame:
    """(problem, id) of rows whose parent is missing or of another library."""
    parent = directories.select(F.col("id").alias("pid"), F.col("library_id").alias("pl"))
    d = directories.filter("parent_id is not null").join(parent, F.col("parent_id") == F.col("pid"), "left").filter("pid is null or pl <> library_id").select(F.lit("directory").alias("problem"), "id")
    a = assets.join(parent, F.col("directory_id") == F.col("pid"), "left").filter("pid is null or pl <> library_id").select(F.lit("asset").alias("problem"), "id")
    return d.unionByName(a)


def generations(directories: DataFrame, assets: DataFrame, libraries: DataFrame) -> DataFrame:
    """(problem, id): rows of a current generation under a stale parent, and rows of a generation to come."""
    now = libraries.select(F.col("id").alias("library_id"), "current_generation")
    parent = directories.select(F.col("id").alias("directory_id"), F.col("last_seen_generation").alias("pg"))
    stale = assets.join(parent, "directory_id").join(now, "library_id").filter("last_seen_generation = current_generation and pg < current_generation").select(F.lit("stale_parent").alias("problem"), "id")
    ahead = assets.join(now, "library_id").filter("last_seen_generation > current_generation").select(F.lit("future").alias("problem"), "id")
    return stale.unionByName(ahead)


def topology(directories: DataFrame) -> DataFrame:
    """(problem, id) where parents and paths disagree. With one root per library of path '' and these all empty, a library is one tree."""
    parent = directories.select(F.col("id").alias("pid"), F.col("library_id").alias("pl"), F.col("relative_path").alias("pp"))
    met = directories.join(parent, F.col("parent_id") == F.col("pid"), "left")
    wrong = met.filter(F.col("parent_id").isNotNull() & (F.col("pid").isNull() | (F.col("pl") != F.col("library_id")) | (F.col("pp") != X.parent_path(F.col("relative_path")))))
    return wrong.select(F.lit("path").alias("problem"), "id").unionByName(directories.filter("parent_id is null and relative_path <> ''").select(F.lit("root").alias("problem"), "id"))


def roots(directories: DataFrame) -> DataFrame:
    """Per library the number of parentless rows and of those that aren't the root."""
    return directories.filter("parent_id is null").groupBy("library_id").agg(F.count("*").alias("roots"), F.count_if(F.col("relative_path") != "").alias("malformed"))


def ancestors_by_parent(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(id, ancestor, distance) of nodes(id, parent_id) that have no paths, `most` steps at most."""
    return forest.ancestors(nodes, most)
