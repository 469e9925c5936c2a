"""The durable job queue as batch transitions: admission, fair claims, recovery, retries, requeueing, progress. now_ms is always an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.functions import scalar as X
#: Job ids of this many in a row are numbered together.
SPAN = 65_536


def eligible(jobs: DataFrame, now_ms: int) -> DataFrame:
    return jobs.filter((F.col("status") == "queued") & (F.col("available_at_ms") <= now_ms))


def fair_least(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Per library its best priority among eligible jobs, and the first job of it."""
    return eligible(jobs, now_ms).groupBy("library_id").agg(F.min(F.struct("priority", "id")).alias("x")).select("library_id", "x.priority", F.col("x.id").alias("job_id"))


def next_claim(jobs: DataFrame, served: DataFrame, now_ms: int) -> DataFrame:
    """The job to claim next, or none. Grids go before storyboards, one storyboard runs at a time, and libraries take turns: served(library_id, priority, last_sequence)."""
    running = jobs.filter("variant = 'storyboard' and status = 'running'").select(F.lit(100).alias("priority")).limit(1)
    ready = eligible(jobs, now_ms).join(F.broadcast(running), "priority", "left_anti")  # one row at most
    best = ready.groupBy("priority", "library_id").agg(F.min("id").alias("job_id"))
    rank = best.join(served, ["library_id", "priority"], "left")
    return rank.orderBy("priority", F.coalesce("last_sequence", F.lit(0)), "job_id").limit(1).select("job_id", "library_id", "priority")


def claim_order(jobs: DataFrame, served: DataFrame, now_ms: int, priority: int = 0) -> DataFrame:
    """(job_id, library_id, turn, seat): the order in which a fixed set of jobs of one priority is claimed, round by round over libraries.

    Turns are counted by spans of ids and within them, so that a library with most of the jobs is not one task's.
    """
    ready = eligible(jobs, now_ms).filter(F.col("priority") == priority).select("id", "library_id", F.floor(F.col("id") / SPAN).alias("span"))
    upto = Window.partitionBy("library_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = ready.groupBy("library_id", "span").count().select("library_id", "span", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    inner = ready.withColumn("n", F.row_number().over(Window.partitionBy("library_id", "span").orderBy("id")))
    rounds = inner.join(spans, ["library_id", "span"]).select("id", "library_id", (F.col("before") + F.col("n")).alias("turn"))
    first = ready.groupBy("library_id").agg(F.min("id").alias("first")).join(served.filter(F.col("priority") == priority), "library_id", "left")
    place = first.withColumn("seat", F.row_number().over(Window.orderBy(F.coalesce("last_sequence", F.lit(0)), "first"))).select("library_id", "seat")
    return rounds.join(place, "library_id").select(F.col("id").alias("job_id"), "library_id", "turn", "seat")


def recovered(rows: DataFrame, now_ms: int, most: int, failed: str = "failed") -> DataFrame:
    """(id, status, error_code) of running rows whose lease is over: queued again, or ended after the last attempt."""
    over = rows.filter((F.col("status") == "running") & (F.col("lease_expires_at_ms") <= now_ms))
    again = F.col("attempts") < most
    return over.select("id", F.when(again, "queued").otherwise(failed).alias("status"), F.when(~again, "interrupted").alias("error_code"))


def finished(jobs: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """(id, status, error_code, available_at_ms, dropped) after results(id, outcome, code, attempt, fingerprint); results of another attempt or source count for nothing."""
    met = jobs.filter("status = 'running'").join(results, "id").filter((F.col("attempt") == F.col("attempts")) & (F.col("fingerprint") == F.col("source_fingerprint")))
    retry = (F.col("outcome") == "retry") & (F.col("attempts") < S.MEDIA_ATTEMPTS)
    status = F.when(F.col("outcome") == "succeeded", "succeeded").when(retry, "queued").when(F.col("outcome") == "stale", "stale").otherwise("failed")
    return met.select("id", status.alias("status"), F.when(status.isin("failed", "queued"), F.col("code")).alias("error_code"), F.when(retry, now_ms + X.retry_delay_ms(F.col("attempts"))).alias("available_at_ms"), (F.col("outcome") == "stale").alias("dropped"))


def storyboard_admissions(assets: DataFrame, thumbnails: DataFrame, jobs: DataFrame, limit: int = 128) -> DataFrame:
    """Videos of some length with a current ready grid and no storyboard job, the first ones by id."""
    grid = thumbnails.filter("variant = 'grid' and status = 'ready'").select(F.col("asset_id").alias("id"), "source_fingerprint")
    have = jobs.filter("variant = 'storyboard'").select(F.col("asset_id").alias("id"))
    fit = assets.filter((F.col("kind") == "video") & (F.col("probe_status") == "ready") & (F.col("duration_ms") >= S.STORYBOARD_LEAST_MS))
    return fit.join(grid, ["id", "source_fingerprint"], "left_semi").join(have, "id", "left_anti").orderBy("id").limit(limit).select(F.col("id").alias("asset_id"), "library_id", "source_fingerprint")


def outdated(jobs: DataFrame, version: int, limit: int = 256) -> DataFrame:
    """The first jobs of another transform version, which start again."""
    return jobs.filter(F.col("transform_version") != version).orderBy("id").limit(limit)


def outdated_effects(jobs: DataFrame, thumbnails: DataFrame, version: int, limit: int = 256) -> DataFrame:
    """(asset_id, variant, action) of starting outdated jobs again."""
    old = outdated(jobs, version, limit).select("asset_id", "variant")
    t = thumbnails.join(old, ["asset_id", "variant"], "left_semi")
    frames = [
        old.withColumn("action", F.lit("requeue")),
        old.filter("variant = 'grid'").withColumn("action", F.lit("reset_metadata")),
        t.filter("status = 'ready'").select("asset_id", "variant", F.lit("delete_file").alias("action")),
        t.select("asset_id", "variant", F.lit("drop_row").alias("action")),
    ]
    return reduce(DataFrame.unionByName, frames)


def missing_derivatives(jobs: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Succeeded jobs without a ready derivative of their variant and fingerprint."""
    have = thumbnails.filter("status = 'ready'").select("asset_id", "variant", "source_fingerprint")
    return jobs.filter("status = 'succeeded'").join(have, ["asset_id", "variant", "source_fingerprint"], "left_anti")


def requeued(jobs: DataFrame, after: int = 0, limit: int = 256) -> DataFrame:
    return jobs.filter(F.col("id") > after).orderBy("id").limit(limit).select("id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"))


def progress(assets: DataFrame, jobs: DataFrame, libraries: DataFrame) -> DataFrame:
    """Per library the jobs by variant and state, and videos that may still get a storyboard."""
    sums = [F.count_if((F.col("variant") == v) & (F.col("status") == s)).alias(f"{v}_{s}") for v in ("grid", "storyboard") for s in ("queued", "running", "succeeded", "failed")]
    counted = jobs.groupBy("library_id").agg(*sums)
    waiting = pending_eligibility(assets, jobs).groupBy("library_id").agg(F.count("*").alias("pending_eligibility"))
    out = libraries.select(F.col("id").alias("library_id")).join(counted, "library_id", "left").join(waiting, "library_id", "left")
    return out.select("library_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "library_id"])


def pending_eligibility(assets: DataFrame, jobs: DataFrame) -> DataFrame:
    grid = jobs.filter("variant = 'grid'").select(F.col("asset_id").alias("id"), "status")
    have = jobs.filter("variant = 'storyboard'").select(F.col("asset_id").alias("id"), F.lit(True).alias("boarded"))
    met = assets.filter("kind = 'video'").select("id", "library_id", "probe_status", "duration_ms").join(grid, "id").join(have, "id", "left")
    soon = (F.col("status") == "succeeded") & (F.col("probe_status") == "ready") & (F.col("duration_ms") >= S.STORYBOARD_LEAST_MS) & F.col("boarded").isNull()
    return met.filter(F.col("status").isin("queued", "running") | soon)


def scan_admission(libraries: DataFrame, runs: DataFrame, removing: DataFrame, capacity: int = 256) -> DataFrame:
    """(library_id, decision, generation): joined to an active scan, refused, or queued with the next generation."""
    active = runs.filter(F.col("status").isin("queued", "running"))
    mine = active.groupBy("library_id").agg(F.max("id").alias("active_run"))
    total = active.agg(F.count("*").alias("active"))
    gen = runs.groupBy("library_id").agg(F.max("generation").alias("g"))
    out = libraries.select(F.col("id").alias("library_id")).join(removing.withColumn("removing", F.lit(True)), "library_id", "left").join(mine, "library_id", "left").join(gen, "library_id", "left").join(F.broadcast(total))
    decision = F.when(F.col("removing"), "conflict").when(F.col("active_run").isNotNull(), "coalesced").when(F.col("active") >= capacity, "full").otherwise("queued")
    return out.select("library_id", decision.alias("decision"), F.when(decision == "queued", F.coalesce("g", F.lit(0)) + 1).cast("long").alias("generation"))


def scan_cancellation(runs: DataFrame) -> DataFrame:
    """(id, status, cancel_requested, outcome) if every scan were asked to stop."""
    queued, running = F.col("status") == "queued", F.col("status") == "running"
    return runs.select("id", F.when(queued, "cancelled").otherwise(F.col("status")).alias("status"), (F.col("cancel_requested") | running).alias("cancel_requested"), F.when(queued, "cancelled").when(running & ~F.col("cancel_requested"), "flagged").when(running, "already_flagged").otherwise("not_active").alias("outcome"))


def abort_effect(runs: DataFrame, libraries: DataFrame) -> DataFrame:
    """(id, library_id, error_code, library_status) that scans leave that end without an index of their own; libraries(id, current_generation).

    A failed or interrupted one leaves the library in error, one whose root is away leaves it offline; a cancelled one
    leaves it as it was, ready if it has ever been indexed. Codes are those of scans.
    """
    known = libraries.select(F.col("id").alias("library_id"), "current_generation")
    ended = runs.filter(F.col("status").isin("failed", "interrupted", "cancelled", "offline")).join(known, "library_id")
    was = F.when(F.col("current_generation") > 0, "ready").otherwise("pending")
    effect = F.when(F.col("status") == "cancelled", was).when(F.col("status") == "offline", "offline").otherwise("error")
    code = F.when(F.col("status") != "cancelled", X.error_code(F.col("error_code"), S.SCAN_ERRORS))
    return ended.select("id", "library_id", code.alias("error_code"), effect.alias("library_status"))


def coalesced(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One job per key: when it was first and last asked for, and its revision."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), F.count("*").alias("requested_revision"))


def enqueued(jobs: DataFrame, events: DataFrame, quiet_ms: int, cap_ms: int) -> DataFrame:
    """jobs(key, status, requested_revision, created_ms, attempts) after one more request per row of events(key, at_ms)."""
    met = jobs.join(events, "key", "full")
    asked, fresh = F.col("at_ms").isNotNull(), F.col("status").isNull()
    again = asked & (fresh | F.col("status").isin("failed", "succeeded"))
    created = F.when(again, F.col("at_ms")).otherwise(F.col("created_ms"))
    wait = asked & (F.coalesce("status", F.lit("queued")) != "running")
    return met.select(
        "key", F.when(again, "queued").otherwise(F.col("status")).alias("status"), (F.coalesce("requested_revision", F.lit(0)) + asked.cast("long")).alias("requested_revision"),
        created.alias("created_ms"), F.when(wait, F.least(F.col("at_ms") + quiet_ms, created + cap_ms)).alias("available_ms"), F.when(again, 0).otherwise(F.col("attempts")).cast("long").alias("attempts"),
    )


def reconcile_failed(jobs: DataFrame, now_ms: int) -> DataFrame:
    """(id, status, available_at_ms) of running jobs that fail: again after a growing wait, or for good."""
    again = F.col("attempts") < S.RECONCILE_ATTEMPTS
    return jobs.filter("status = 'running'").select("id", F.when(again, "queued").otherwise("failed").alias("status"), F.when(again, now_ms + X.reconcile_delay_ms(F.col("attempts"))).alias("available_at_ms"))
