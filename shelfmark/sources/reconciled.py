"""Reconciles committed: a batch of directories as they are now replaces what the catalogue has of them, in one step.

Assets lie in slots by their directory, counts in slots by their own directory. A commit reads and writes the slots that its
directories lie in, and those of the counts above them; the manifest takes all other slots over as they are. Rows, counts,
the queue and the revisions of libraries appear together, or, if another commit was first, not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import commits, ingest, tree
from shelfmark.sources.snapshots import Snapshots
from shelfmark.staging import staged


class Reconciled:
    """assets(id, library_id, directory_id, relative_path, ...), counts(id, direct_count, recursive_count) of directories, jobs(key, library_id, status, requested_revision, claimed_revision, attempts, available_at_ms) with a directory's id as key, libraries(id, content_revision)."""

    def __init__(self, spark: SparkSession, folder: str, slots: int = 64):
        self.store, self.slots = Snapshots(spark, folder), slots

    def _slot(self, directory: str):
        return F.pmod(F.xxhash64(F.col(directory).cast("long")), F.lit(self.slots)).cast("int")

    def _laid(self, rows: DataFrame, directory: str) -> DataFrame:
        """The rows with their slot, a slot's beside one another; a large slot is as many tasks as its size asks for."""
        return rows.withColumn("slot", self._slot(directory)).hint("rebalance", F.col("slot"))

    def create(self, assets: DataFrame, directories: DataFrame, jobs: DataFrame, libraries: DataFrame) -> int:
        counts = tree.rollup_counts(directories, assets).select("id", "direct_count", "recursive_count")
        tables = {"assets": self._laid(assets, "directory_id"), "counts": self._laid(counts, "id"), "directories": directories, "jobs": jobs, "libraries": libraries.select("id", F.lit(0).cast("long").alias("content_revision"))}
        top = assets.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        every = set(range(self.slots))
        return self.store.publish(tables, self.store.revision(), touched={"assets": every, "counts": every}, notes={"next_id": top + 1})

    def commit(self, listing: DataFrame, generation: int, now_ms: int) -> DataFrame:
        """Commits the running jobs with what a listing found in their directories, and returns their outcomes; listing rows of other directories are passed over."""
        now = self.store.manifest()
        jobs = self.store.read("jobs")
        running = staged(jobs.filter("status = 'running'"), "running")
        inside = running.select(F.col("key").alias("directory_id"))
        slots = {r[0] for r in running.select(self._slot("key")).distinct().collect()}  # at most as many as there are
        columns = [f["name"] for f in now["schemas"]["assets"]["fields"]]
        # whole rows are joined with the directories once: what they are asked for, and what stays beside them in their slots
        old = staged(self.store.slots("assets", slots).join(inside.distinct().withColumn("asked", F.lit(True)), "directory_id", "left").withColumn("asked", F.col("asked").isNotNull()), "old", "asked")
        before, rest = old.filter("asked").select(columns), old.filter("not asked").select(columns)
        key = ["library_id", "relative_path"]
        found = staged(listing.dropna(subset=key).join(inside, "directory_id", "left_semi"), "found")
        derived = [c for c in columns if c not in ingest.MERGED]
        told = staged(ingest.compared(before, found, generation, tuple(derived)), "told")
        came = staged(ingest.identified(told.filter("id is null"), now["notes"]["next_id"]).select(columns), "came")
        after = told.filter("listed and id is not null").select(columns).unionByName(came)  # what the listing lacks is gone
        changes = told.filter("change is not null").select(F.explode("places").alias("directory_id"), "change")
        outcomes = staged(commits.committed_reconciles(running, changes, now_ms), "outcomes")

        delta = after.groupBy(F.col("directory_id").alias("id")).agg(F.count("*").alias("delta")).unionByName(before.groupBy(F.col("directory_id").alias("id")).agg((-F.count("*")).alias("delta")))
        delta = staged(delta.groupBy("id").agg(F.sum("delta").alias("delta")).filter("delta <> 0"), "delta")
        directories = self.store.read("directories")
        above = tree.ancestor_pairs(directories.join(delta.select("id"), "id", "left_semi")).select("library_id", F.col("ancestor_path").alias("relative_path")).distinct()
        moved = {r[0] for r in directories.join(above, key).select(self._slot("id")).distinct().collect()}
        counts = tree.incremental_rollup(directories, self.store.slots("counts", moved), delta)

        waiting = outcomes.filter("outcome = 'queued'").select("key", "available_at_ms")
        again = running.drop("available_at_ms").join(waiting, "key").withColumns({"status": F.lit("queued"), "attempts": F.lit(0).cast(dict(jobs.dtypes)["attempts"]), "claimed_revision": F.lit(None).cast(dict(jobs.dtypes)["claimed_revision"])})
        steps = outcomes.groupBy(F.col("library_id").alias("id")).agg(F.sum("content_increment").alias("more"))
        libraries = self.store.read("libraries").join(steps, "id", "left").select("id", (F.col("content_revision") + F.coalesce("more", F.lit(0))).alias("content_revision"))
        top = came.agg(F.max("id")).first()[0] or 0
        tables = {
            "assets": self._laid(rest.unionByName(after), "directory_id"), "counts": self._laid(counts, "id"),
            "jobs": jobs.filter("status <> 'running'").unionByName(again.select(jobs.columns)), "libraries": libraries,
        }
        self.store.publish(tables, now["revision"], full=False, touched={"assets": slots, "counts": moved}, notes={"next_id": max(top + 1, now["notes"]["next_id"])})
        return outcomes
