"""Guarded writes as joins of a table with a batch of commands: what each command comes to, and the rows afterwards.

A command takes effect only where the row still is what the command expects (a fingerprint, a revision, a status). Where
commands of a batch are one and the same for a row, the one with the least `seq` counts; commands that follow one another on
a row are folded in their order by command_log. Empty tables and batches give what they imply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.functions import scalar as X

#: Phases of a scan, in order.
PHASES = ("checking_root", "walking", "finalizing")
#: What ends a job for good or lets it be tried again: problem -> (outcome, code).
RESULTS = {
    "source_changed": ("stale", None),
    "storyboard_not_eligible": ("stale", None),
    "invalid_media": ("permanent", "invalid_media"),
    "unsupported_media": ("permanent", "unsupported_media"),
    "source_too_large": ("permanent", "media_processing_failed"),
    "storyboard_budget_exhausted": ("permanent", "timeout"),
    "deadline_exceeded": ("retry", "timeout"),
    "processing_timed_out": ("retry", "timeout"),
    "source_unavailable": ("retry", "source_unavailable"),
    "publish_failed": ("retry", "cache_unavailable"),
    "cache_capacity": ("retry", "cache_unavailable"),
}


def first_of_each(commands: DataFrame, *keys: str) -> DataFrame:
    return commands.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in commands.columns if c not in keys]), "seq").alias("x")).select(*keys, "x.*")


def job_result(problem: Column) -> tuple[Column, Column, Column]:
    """(outcome, code, delay in ms) of a job that met a problem, null for none."""
    known = F.create_map(*[x for k, (o, c) in RESULTS.items() for x in (F.lit(k), F.struct(F.lit(o).alias("outcome"), F.lit(c).cast("string").alias("code")))])
    found = F.when(problem.isNull(), F.struct(F.lit("succeeded").alias("outcome"), F.lit(None).cast("string").alias("code")))
    found = found.otherwise(F.coalesce(known[problem], F.struct(F.lit("retry").alias("outcome"), F.lit("media_processing_failed").alias("code"))))
    return found["outcome"], found["code"], F.when(found["outcome"] == "retry", F.lit(5_000))


def ready_outcomes(assets: DataFrame, ready: DataFrame) -> DataFrame:
    """ready(seq, asset_id, variant, source_fingerprint, byte_size, frame_count, at_ms) with the library and an outcome: committed, invalid or source_changed."""
    of = assets.select(F.col("id").alias("asset_id"), "library_id", F.col("source_fingerprint").alias("now"), "kind", "probe_status", "duration_ms")
    fits = F.col("now") == F.col("source_fingerprint")
    eligible = (F.col("kind") == "video") & (F.col("probe_status") == "ready") & (F.col("duration_ms") >= S.STORYBOARD_LEAST_MS)
    planned = F.col("frame_count").eqNullSafe(X.storyboard_frames(F.col("duration_ms")))
    board = F.col("variant") == "storyboard"
    outcome = F.when(F.col("byte_size") <= 0, "invalid").when(~F.coalesce(fits & (~board | eligible), F.lit(False)), "source_changed").when(board & ~planned, "invalid").otherwise("committed")
    return first_of_each(ready, "asset_id", "variant").join(of, "asset_id", "left").withColumn("outcome", outcome)


def with_ready(thumbnails: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(asset_id, variant, library_id, status, error_code, byte_size, last_accessed_at_ms, source_fingerprint, frame_count) with the committed ones put in."""
    new = outcomes.filter("outcome = 'committed'").select(
        "asset_id", "variant", "library_id", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error_code"), F.col("byte_size").cast("long").alias("byte_size"),
        F.col("at_ms").cast("long").alias("last_accessed_at_ms"), "source_fingerprint", F.col("frame_count").cast("int").alias("frame_count"),
    )
    old = thumbnails.select(*new.columns).join(new, ["asset_id", "variant"], "left_anti")
    return old.unionByName(new)


def with_failures(assets: DataFrame, thumbnails: DataFrame, failures: DataFrame) -> DataFrame:
    """thumbnails after failures(seq, asset_id, variant, source_fingerprint, error_code) of assets that still have the fingerprint: failed rows keep nothing of a file."""
    of = assets.select(F.col("id").alias("asset_id"), "library_id", "source_fingerprint")
    hit = first_of_each(failures, "asset_id", "variant").join(of, ["asset_id", "source_fingerprint"])
    columns = ["asset_id", "variant", "library_id", "status", "error_code", "byte_size", "last_accessed_at_ms", "source_fingerprint", "frame_count"]
    kinds = dict(thumbnails.dtypes)
    gone = {c: F.lit(None).cast(kinds[c]) for c in ("byte_size", "last_accessed_at_ms", "frame_count")}
    new = hit.withColumns({"status": F.lit("failed"), **gone}).select(columns)
    return thumbnails.select(columns).join(new, ["asset_id", "variant"], "left_anti").unionByName(new)


def touched(thumbnails: DataFrame, touches: DataFrame) -> DataFrame:
    """thumbnails(..., cache_path) with the access time of touches(asset_id, variant, source_fingerprint, cache_path, at_ms): only ready rows of that fingerprint and path, at the latest."""
    one = ["asset_id", "variant", "source_fingerprint", "cache_path"]
    latest = touches.groupBy(*one).agg(F.max("at_ms").alias("at_ms"))
    out = thumbnails.join(latest, one, "left")
    hit = (F.col("status") == "ready") & F.col("at_ms").isNotNull()
    return out.withColumn("last_accessed_at_ms", F.when(hit, F.col("at_ms")).otherwise(F.col("last_accessed_at_ms"))).select(thumbnails.columns)


def replays(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, key_hash, outcome, result_id) of requests(seq, key_hash, request_hash) on records(key_hash, request_hash, result_id).

    A key that is on record replays its result if the request is the same, else conflicts. Of a new key the first request
    is created, with its seq as result; the others of the batch replay it or conflict.
    """
    kept = records.select("key_hash", F.col("request_hash").alias("known"), "result_id", F.lit(True).alias("recorded"))
    fresh = requests.join(records, "key_hash", "left_anti").groupBy("key_hash").agg(F.min_by(F.struct("request_hash", "seq"), "seq").alias("x"))
    both = kept.unionByName(fresh.select("key_hash", F.col("x.request_hash").alias("known"), F.col("x.seq").alias("result_id"), F.lit(False).alias("recorded")))
    met = requests.join(both, "key_hash")
    same = F.col("request_hash") == F.col("known")
    outcome = F.when(~same, "conflict").when(~F.col("recorded") & (F.col("seq") == F.col("result_id")), "created").otherwise("replayed")
    return met.select("seq", "key_hash", outcome.alias("outcome"), F.when(same, F.col("result_id")).alias("result_id"))


def discovered(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows(id, status, error_code, revision, updated_at_ms) after states(id, status, error_code, at_ms): revision and time move only where the pair does, nulls compared as values."""
    new = states.select("id", F.col("status").alias("to"), F.col("error_code").alias("why"), "at_ms", F.lit(True).alias("told"))
    met = rows.join(new, "id", "left")
    moved = F.coalesce(F.col("told") & ~(F.col("status").eqNullSafe(F.col("to")) & F.col("error_code").eqNullSafe(F.col("why"))), F.lit(False))
    take = lambda a, b: F.when(moved, F.col(b)).otherwise(F.col(a)).alias(a)
    return met.select("id", take("status", "to"), take("error_code", "why"), (F.col("revision") + moved.cast("long")).alias("revision"), take("updated_at_ms", "at_ms"))


def idle(removals: DataFrame, runs: DataFrame) -> DataFrame:
    """Removals of libraries without an active scan."""
    return removals.join(runs.filter(F.col("status").isin("queued", "running")).select("library_id"), "library_id", "left_anti")


def next_removal(removals: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """The oldest queued or running removal that may go on, as it is once claimed."""
    first = idle(removals.filter(F.col("status").isin("queued", "running")), runs).orderBy("created_at_ms", "id").limit(1)
    return first.select("id", "library_id", F.lit("running").alias("status"), F.coalesce("started_at_ms", F.lit(now_ms)).cast("long").alias("started_at_ms"), (F.col("revision") + (F.col("status") == "queued").cast("long")).alias("revision"))


def failed_removals(removals: DataFrame, failures: DataFrame, now_ms: int) -> DataFrame:
    """(id, status, error_code, finished_at_ms, revision) of the removals after failures(seq, id, code); only running ones fail."""
    met = removals.join(first_of_each(failures, "id"), "id", "left")
    hit = F.coalesce((F.col("status") == "running") & F.col("code").isNotNull(), F.lit(False))
    return met.select("id", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("code")).alias("error_code"), F.when(hit, F.lit(now_ms)).cast("long").alias("finished_at_ms"), (F.col("revision") + hit.cast("long")).alias("revision"))


def without_removed(removals: DataFrame, runs: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (each with library_id) without the rows of libraries whose running removal may go on: one anti join each, in place of batches."""
    gone = idle(removals.filter("status = 'running'"), runs).select("library_id").distinct()
    return {name: df.join(gone, "library_id", "left_anti") for name, df in tables.items()}


def recovered_reconciles(jobs: DataFrame, now_ms: int) -> DataFrame:
    """(id, status, error_code, available_at_ms) of running reconciles whose lease is over: again after a growing wait, or failed for good."""
    again = F.col("attempts") < S.RECONCILE_ATTEMPTS
    late = jobs.filter((F.col("status") == "running") & (F.col("lease_expires_at_ms") <= now_ms))
    return late.select("id", F.when(again, "queued").otherwise("failed").alias("status"), F.when(~again, "interrupted").alias("error_code"), F.when(again, now_ms + X.reconcile_delay_ms(F.col("attempts"))).alias("available_at_ms"))


def committed_reconciles(jobs: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """(key, library_id, added, removed, changed, outcome, available_at_ms, content_increment) of running jobs(key, library_id, requested_revision, claimed_revision).

    changes(directory_id, change) is what the walk of the directory found. A job whose request has moved on since it was
    claimed is queued again, with no attempts; the others are done. The content's revision moves where anything changed.
    """
    kinds = ("new", "removed", "changed")
    found = changes.groupBy(F.col("directory_id").alias("key")).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    met = jobs.filter("status = 'running'").join(found, "key", "left").fillna(0, kinds)
    later = F.col("requested_revision") != F.col("claimed_revision")
    any_ = F.col("new") + F.col("removed") + F.col("changed") > 0
    return met.select("key", "library_id", F.col("new").alias("added"), "removed", "changed", F.when(later, "queued").otherwise("done").alias("outcome"), F.when(later, F.lit(now_ms + S.QUIET_MS)).cast("long").alias("available_at_ms"), any_.cast("int").alias("content_increment"))


def merged_directories(directories: DataFrame, found: DataFrame, generation: int) -> DataFrame:
    """(id, library_id, parent_id, relative_path, name, last_seen_generation) after found(library_id, relative_path).

    A path keeps its id; a new one follows the largest, in the order of library, parent and path, numbered in two levels. A
    path is taken only if every directory above it was found as well, up to the root: a walk names the parents first.
    """
    key = ["library_id", "relative_path"]
    paths = found.select(*key).distinct()
    above = paths.select("library_id", F.col("relative_path").alias("path"), F.explode(X.path_ancestors(F.col("relative_path"))).alias("relative_path"))
    whole = above.join(paths.withColumn("there", F.lit(True)), key, "left").groupBy("library_id", F.col("path").alias("relative_path")).agg(F.count_if(F.col("there").isNull()).alias("gaps"))
    held = whole.filter("gaps = 0").select(*key, F.when(F.col("relative_path") != "", X.parent_path(F.col("relative_path"))).alias("parent_path"))
    met = directories.select(*key, "id", "last_seen_generation").join(held.withColumn("found", F.lit(True)), key, "full")
    fresh = met.filter("id is null").withColumn("parent_path", F.coalesce("parent_path", F.lit("")))
    sizes = fresh.groupBy("library_id", "parent_path").count()
    upto = Window.partitionBy("library_id").orderBy("parent_path").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("start", F.coalesce(F.sum("count").over(upto), F.lit(0))).select("library_id", "parent_path", "start")
    libraries = sizes.groupBy("library_id").agg(F.sum("count").alias("n"))  # one row a library
    libraries = libraries.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("library_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("library_id", "base")
    place = F.row_number().over(Window.partitionBy("library_id", "parent_path").orderBy("relative_path"))
    top = directories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = fresh.withColumn("place", place).join(before, ["library_id", "parent_path"]).join(libraries, "library_id").crossJoin(F.broadcast(top))  # one row
    ids = ids.select(*key, (F.col("top") + F.col("base") + F.col("start") + F.col("place")).cast("long").alias("new_id"))
    out = met.join(ids, key, "left").select(F.coalesce("id", "new_id").alias("id"), *key, F.when(F.col("found"), F.lit(generation)).otherwise(F.col("last_seen_generation")).cast("long").alias("last_seen_generation"))
    parents = out.select("library_id", F.col("relative_path").alias("parent_path"), F.col("id").alias("parent_id"))
    out = out.withColumn("parent_path", F.when(F.col("relative_path") != "", X.parent_path(F.col("relative_path")))).join(parents, ["library_id", "parent_path"], "left")
    return out.select("id", "library_id", "parent_id", "relative_path", X.basename(F.col("relative_path")).alias("name"), "last_seen_generation")


def moved(assets: DataFrame, merged: DataFrame, listing: DataFrame) -> DataFrame:
    """(library_id, old_id, new_id): files that went from one path to another. By path they are a removed and a new asset, which one fingerprint in one directory tells to be the same file. Of files that are alike the first by path goes with the first, the second with the second; one that has no counterpart is none that moved."""
    paths = listing.select("library_id", "relative_path")
    gone = assets.join(paths, ["library_id", "relative_path"], "left_anti")
    came = merged.join(paths, ["library_id", "relative_path"], "left_semi").join(assets.select("id"), "id", "left_anti")
    return paired(gone, came)


def paired(gone: DataFrame, came: DataFrame) -> DataFrame:
    """moved, of the rows that went and those that came, each (id, library_id, directory_id, relative_path, source_fingerprint)."""
    key = ["library_id", "directory_id", "source_fingerprint"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("relative_path")).alias("place")
    old, new = gone.select(*key, F.col("id").alias("old_id"), place), came.select(*key, F.col("id").alias("new_id"), place)
    return old.join(new, [*key, "place"]).select("library_id", "old_id", "new_id")


def evicted(thumbnails: DataFrame, evictions: DataFrame) -> DataFrame:
    """thumbnails(asset_id, variant, status, cache_path, byte_size, ...) without the ready rows that evictions(asset_id, variant, cache_path, byte_size) name: a row whose path or size has changed since stays."""
    one = ["asset_id", "variant", "cache_path", "byte_size"]
    gone = evictions.select(*one, F.lit("ready").alias("status")).distinct()
    return thumbnails.join(gone, [*one, "status"], "left_anti").select(thumbnails.columns)


def missing_files(thumbnails: DataFrame, jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """(asset_id, variant, action): ready rows whose file is not in the cache's listing(cache_path, byte_size) with their size are dropped, and their job is queued again."""
    lost = thumbnails.filter("status = 'ready'").join(listing.select("cache_path", "byte_size").distinct(), ["cache_path", "byte_size"], "left_anti").select("asset_id", "variant")
    return lost.withColumn("action", F.lit("drop_row")).unionByName(jobs.select("asset_id", "variant").join(lost, ["asset_id", "variant"], "left_semi").withColumn("action", F.lit("requeue")))


def cleanup_batches(thumbnails: DataFrame, size: int = 64, parts: int = 256) -> DataFrame:
    """(batch, rows, bytes, bytes_so_far) of the eviction of all ready rows, least recently used first.

    Rows are numbered in two levels, over parts of the access times with about equally many rows.
    """
    ready = thumbnails.filter("status = 'ready'").select("asset_id", "variant", "last_accessed_at_ms", "byte_size")
    cuts = ready.agg(F.percentile_approx("last_accessed_at_ms", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("cuts"))
    laid = ready.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("last_accessed_at_ms")))).drop("cuts")  # one row
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("part", "start")
    place = F.row_number().over(Window.partitionBy("part").orderBy("last_accessed_at_ms", "asset_id", "variant"))
    batch = laid.withColumn("place", place).join(F.broadcast(before), "part").withColumn("batch", F.floor((F.col("start") + F.col("place") - 1) / size))
    sums = batch.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("byte_size").alias("bytes"))
    # a batch is one row of 64: their running sum goes by 4,096 of them at a time
    sums = sums.withColumn("chunk", F.floor(F.col("batch") / 4096))
    chunks = sums.groupBy("chunk").agg(F.sum("bytes").alias("b")).withColumn("base", F.coalesce(F.sum("b").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("chunk", "base")
    running = F.sum("bytes").over(Window.partitionBy("chunk").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("running", running).join(chunks, "chunk").select("batch", "rows", "bytes", (F.col("base") + F.col("running")).alias("bytes_so_far"))


def live_sessions(sessions: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """(session_id, user_id, name) of sessions that are neither revoked nor over, of users that are enabled and have not changed their revision since."""
    live = sessions.filter(F.col("revoked_at_ms").isNull() & (F.col("expires_at_ms") > now_ms))
    who = users.filter("enabled").select(F.col("id").alias("user_id"), "name", "session_revision")
    return live.join(who, ["user_id", "session_revision"]).select("session_id", "user_id", "name")


def counted(directories: DataFrame, counts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """directories with the counts(id, ...) of a rollup put in; `moved` where any differs from what was there."""
    new = counts.select("id", *[F.col(c).alias(f"new_{c}") for c in columns])
    met = directories.join(new, "id", "left")
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | (F.coalesce(f"new_{c}", F.lit(0)) != F.col(c))
    return met.select("id", *[F.coalesce(f"new_{c}", F.lit(0)).cast("long").alias(c) for c in columns], differs.alias("moved"))


def empty_keys(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """The next rows without a derived key, by id."""
    return rows.filter((F.col("id") > after) & ((F.col("search_name_key") == "") | F.col("search_name_key").isNull())).orderBy("id").limit(limit).select("id", X.search_text_key(F.col("name")).alias("search_name_key"))
