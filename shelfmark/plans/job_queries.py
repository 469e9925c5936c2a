"""Queries on ingest, the job queue and operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.functions import scalar as X
from shelfmark.operators import browse as B
from shelfmark.operators import ingest as I
from shelfmark.operators import jobs as J
from shelfmark.operators import operations as O

NOW = 2_000_000
#: Claims so far, by library, as SQL values.
_SERVED = "SELECT CAST(column1 AS BIGINT) AS library_id, 0 AS priority, CAST(column2 AS BIGINT) AS last_sequence FROM VALUES (1, 7), (2, 3), (4, 9) t(column1, column2)"
_SERVED_SQL = "(SELECT CAST(l AS BIGINT) AS library_id, 0 AS priority, s AS last_sequence FROM (VALUES (1, 7), (2, 3), (4, 9)) t(l, s))"
_GEN = "row_number() OVER (PARTITION BY library_id ORDER BY id)"


def _served(c):
    return c.spark.sql(_SERVED)


def _runs(c):
    from pyspark.sql import Window

    return c.scan_runs.withColumn("generation", F.row_number().over(Window.partitionBy("library_id").orderBy("id")))


def _merged(c):
    return I.merge(c.assets, c.listing, 3)


_MERGE = f"""
m AS (SELECT coalesce(n.library_id, o.library_id) AS library_id, coalesce(n.relative_path, o.relative_path) AS relative_path, coalesce(n.directory_id, o.directory_id) AS directory_id, coalesce(n.name, o.name) AS name, coalesce(n.kind, o.kind) AS kind, coalesce(n.size_bytes, o.size_bytes) AS size_bytes,
  coalesce(n.source_fingerprint, o.source_fingerprint) AS source_fingerprint, o.id AS old_id, o.id IS NOT NULL AND (n.relative_path IS NULL OR n.source_fingerprint = o.source_fingerprint) AS same, CASE WHEN n.relative_path IS NULL THEN o.last_seen_generation ELSE 3 END AS last_seen_generation, o.width, o.height, o.duration_ms, o.probe_status
  FROM assets o FULL JOIN listing n ON o.library_id = n.library_id AND o.relative_path = n.relative_path),
merged AS (SELECT CASE WHEN old_id IS NULL THEN (SELECT max(id) FROM assets) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY library_id, directory_id, relative_path) ELSE old_id END AS id, library_id, relative_path, directory_id, name, kind, size_bytes, source_fingerprint, last_seen_generation, CASE WHEN same THEN width END AS width, CASE WHEN same THEN height END AS height, CASE WHEN same THEN duration_ms END AS duration_ms, CASE WHEN same THEN probe_status ELSE 'pending' END AS probe_status FROM m)
"""
_MERGE_FIELDS = ["id", "library_id", "relative_path", "directory_id", "name", "kind", "size_bytes", "source_fingerprint", "last_seen_generation", "width", "height", "duration_ms", "probe_status"]
_ELIGIBLE = f"status = 'queued' AND available_at_ms <= {NOW}"
_CHANGED = "(SELECT a.* FROM assets a JOIN listing n ON a.library_id = n.library_id AND a.relative_path = n.relative_path WHERE a.source_fingerprint <> n.source_fingerprint)"
_PENDING = "(SELECT a.id, a.library_id FROM assets a JOIN media_jobs g ON g.asset_id = a.id AND g.variant = 'grid' WHERE a.kind = 'video' AND (g.status IN ('queued', 'running') OR (g.status = 'succeeded' AND a.probe_status = 'ready' AND a.duration_ms >= 2000 AND NOT EXISTS (SELECT 1 FROM media_jobs s WHERE s.asset_id = a.id AND s.variant = 'storyboard'))))"
_DIFF = "SELECT coalesce(o.library_id, n.library_id) AS library_id, coalesce(o.relative_path, n.relative_path) AS relative_path, CASE WHEN o.id IS NULL THEN 'new' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM assets o FULL JOIN listing n ON o.library_id = n.library_id AND o.relative_path = n.relative_path WHERE o.id IS NULL OR n.name IS NULL OR o.source_fingerprint <> n.source_fingerprint"
_ADMIT = "FROM assets a JOIN thumbnails g ON g.asset_id = a.id AND g.variant = 'grid' AND g.status = 'ready' AND g.source_fingerprint = a.source_fingerprint WHERE a.kind = 'video' AND a.probe_status = 'ready' AND a.duration_ms >= 2000 AND NOT EXISTS (SELECT 1 FROM media_jobs e WHERE e.asset_id = a.id AND e.variant = 'storyboard') ORDER BY a.id LIMIT 128"
_MISSING = "FROM media_jobs j WHERE status = 'succeeded' AND NOT EXISTS (SELECT 1 FROM thumbnails t WHERE t.asset_id = j.asset_id AND t.variant = j.variant AND t.status = 'ready' AND t.source_fingerprint = j.source_fingerprint)"
_OUTDATED = "(SELECT asset_id, variant, id FROM media_jobs WHERE transform_version <> 1 ORDER BY id LIMIT 256)"


def _results(c):
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("succeeded", "retry", "permanent", "stale")]), (F.col("id") % 4 + 1).cast("int"))
    return c.media_jobs.select("id", outcome.alias("outcome"), F.lit("timeout").alias("code"), F.when(F.col("id") % 9 == 0, 9).otherwise(F.col("attempts")).alias("attempt"), F.col("source_fingerprint").alias("fingerprint"))


def _reconcile_jobs(c):
    k = F.col("id") - 1
    status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "failed")]), (k % 3 + 1).cast("int"))
    return c.directories.filter("id >= 10000000").select(F.col("id").alias("key"), "id", status.alias("status"), (F.col("id") % 5 + 1).alias("requested_revision"), (F.col("id") % 1000).alias("created_ms"), (F.col("id") % 5 + 1).alias("attempts"))


_RECONCILE = "(SELECT id AS key, id, list_extract(['queued', 'running', 'failed'], CAST((id - 1) % 3 + 1 AS INT)) AS status, id % 5 + 1 AS requested_revision, id % 1000 AS created_ms, id % 5 + 1 AS attempts FROM directories WHERE id >= 10000000)"

_CODES = ", ".join(f"'{x}'" for x in S.SCAN_ERRORS)
_ENDED = f"(SELECT id, library_id, CASE WHEN status = 'failed' AND id % 3 = 0 THEN 'offline' ELSE status END AS status, list_extract([{_CODES}, 'no_such_code', NULL], CAST(id % {len(S.SCAN_ERRORS) + 2} + 1 AS INT)) AS error_code FROM scan_runs)"


def _ended(c):
    """Scans as they ended, with any of the codes and one that there isn't; some had their root away."""
    code = F.element_at(F.array(*[F.lit(x) for x in (*S.SCAN_ERRORS, "no_such_code", None)]), (F.col("id") % (len(S.SCAN_ERRORS) + 2) + 1).cast("int"))
    return c.scan_runs.select("id", "library_id", F.when((F.col("status") == "failed") & (F.col("id") % 3 == 0), "offline").otherwise(F.col("status")).alias("status"), code.alias("error_code"))


def _caches(c):
    """Quotas and free bytes that are asked about."""
    return c.thumbnails.select((F.col("asset_id") % 97 * 500_000).alias("quota_bytes"), (F.col("asset_id") % 89 * 12_345_678).alias("available_bytes")).distinct()


ENTRIES = [
    ("catalog_diff", lambda c: I.difference(c.assets, c.listing), _DIFF),
    ("catalog_upsert_batch", lambda c: _merged(c).select(*_MERGE_FIELDS), f", {_MERGE} SELECT {', '.join(_MERGE_FIELDS)} FROM merged"),
    ("upsert_asset", lambda c: _merged(c).filter("last_seen_generation = 3").select(*_MERGE_FIELDS), f", {_MERGE} SELECT {', '.join(_MERGE_FIELDS)} FROM merged WHERE last_seen_generation = 3"),
    ("stale_sweep", lambda c: I.sweep(c.assets, c.listing).select("id", "relative_path"), "SELECT id, relative_path FROM assets WHERE (id - 1) % 17 = 0"),
    ("stale_generation", lambda c: I.stale(c.assets, 2).select("id"), "SELECT id FROM assets WHERE last_seen_generation < 2"),
    (
        "invalidate_derivatives",
        lambda c: I.invalidated(c.assets, c.listing, c.thumbnails, c.media_jobs),
        f"SELECT asset_id, variant, 'delete_file' AS action FROM thumbnails WHERE status = 'ready' AND asset_id IN (SELECT id FROM {_CHANGED}) UNION ALL SELECT asset_id, variant, "
        f"'drop_row' FROM thumbnails WHERE asset_id IN (SELECT id FROM {_CHANGED}) UNION ALL SELECT asset_id, variant, 'drop_job' FROM media_jobs WHERE variant = 'storyboard' AND "
        f"asset_id IN (SELECT id FROM {_CHANGED})",
    ),
    (
        "admit_grid_jobs",
        lambda c: I.admitted_grid_jobs(c.assets, c.media_jobs, 1),
        "SELECT id AS asset_id, library_id, source_fingerprint FROM assets a WHERE NOT EXISTS (SELECT 1 FROM media_jobs j WHERE j.asset_id = a.id AND j.variant = 'grid' AND "
        "j.transform_version = 1 AND j.source_fingerprint = a.source_fingerprint)",
    ),
    ("admit_storyboard_jobs", lambda c: J.storyboard_admissions(c.assets, c.thumbnails, c.media_jobs), f"SELECT a.id AS asset_id, a.library_id, a.source_fingerprint {_ADMIT}"),
    (
        "anti_storyboard_admission",
        lambda c: c.assets.filter("kind = 'video'").select(F.col("id").alias("asset_id")).join(c.media_jobs.filter("variant = 'storyboard'"), "asset_id", "left_anti"),
        "SELECT id AS asset_id FROM assets WHERE kind = 'video' AND id NOT IN (SELECT asset_id FROM media_jobs WHERE variant = 'storyboard')",
    ),
    (
        "transform_reconcile",
        lambda c: J.outdated_effects(c.media_jobs, c.thumbnails, 1),
        f"SELECT asset_id, variant, 'requeue' AS action FROM {_OUTDATED} UNION ALL SELECT asset_id, variant, 'reset_metadata' FROM {_OUTDATED} WHERE variant = 'grid' UNION ALL "
        f"SELECT t.asset_id, t.variant, 'delete_file' FROM thumbnails t JOIN {_OUTDATED} o ON o.asset_id = t.asset_id AND o.variant = t.variant WHERE t.status = 'ready' UNION ALL "
        f"SELECT t.asset_id, t.variant, 'drop_row' FROM thumbnails t JOIN {_OUTDATED} o ON o.asset_id = t.asset_id AND o.variant = t.variant",
    ),
    ("anti_missing_derivative", lambda c: J.missing_derivatives(c.media_jobs, c.thumbnails).select("id", "asset_id", "variant"), f"SELECT id, asset_id, variant {_MISSING}"),
    (
        "requeue_missing",
        lambda c: J.requeued(J.missing_derivatives(c.media_jobs, c.thumbnails), after=100),
        f"SELECT id, 'queued' AS status, 0 AS attempts {_MISSING} AND id > 100 ORDER BY id LIMIT 256",
    ),
    ("requeue_all", lambda c: J.requeued(c.media_jobs.filter("library_id = 2"), limit=64), "SELECT id, 'queued' AS status, 0 AS attempts FROM media_jobs WHERE library_id = 2 ORDER BY id LIMIT 64"),
    (
        "fair_min_per_library",
        lambda c: J.fair_least(c.media_jobs, NOW),
        f"SELECT library_id, priority, min(id) AS job_id FROM media_jobs j WHERE {_ELIGIBLE} AND priority = (SELECT min(priority) FROM media_jobs x WHERE x.library_id = "
        f"j.library_id AND {_ELIGIBLE.replace('status', 'x.status').replace('available_at_ms', 'x.available_at_ms')}) GROUP BY 1, 2",
    ),
    (
        "claim_media_job",
        lambda c: J.next_claim(c.media_jobs, _served(c), NOW),
        f"SELECT b.job_id, b.library_id, b.priority FROM (SELECT library_id, priority, min(id) AS job_id FROM media_jobs WHERE {_ELIGIBLE} AND NOT (variant = 'storyboard' AND "
        f"EXISTS (SELECT 1 FROM media_jobs r WHERE r.variant = 'storyboard' AND r.status = 'running')) GROUP BY 1, 2) b LEFT JOIN {_SERVED_SQL} s ON s.library_id = b.library_id "
        "AND s.priority = b.priority ORDER BY b.priority, coalesce(last_sequence, 0), job_id LIMIT 1",
    ),
    (
        "fair_claim_order",
        lambda c: J.claim_order(c.media_jobs, _served(c), NOW),
        "SELECT e.id AS job_id, e.library_id, row_number() OVER (PARTITION BY e.library_id ORDER BY e.id) AS turn, p.seat FROM media_jobs e JOIN (SELECT f.library_id, "
        f"row_number() OVER (ORDER BY coalesce(last_sequence, 0), f.first) AS seat FROM (SELECT library_id, min(id) AS first FROM media_jobs WHERE {_ELIGIBLE} AND priority = 0 "
        f"GROUP BY 1) f LEFT JOIN {_SERVED_SQL} s ON s.library_id = f.library_id) p ON p.library_id = e.library_id WHERE {_ELIGIBLE} AND priority = 0",
    ),
    (
        "claim_scan",
        lambda c: c.scan_runs.filter("status = 'queued'").orderBy("created_at_ms", "id").limit(1).select("id", "library_id"),
        "SELECT id, library_id FROM scan_runs WHERE status = 'queued' ORDER BY created_at_ms, id LIMIT 1",
    ),
    (
        "claim_reconcile",
        lambda c: _claimable(c).orderBy("created_ms", "key").limit(1).select("key", "library_id"),
        f"SELECT r.key, d.library_id FROM {_RECONCILE} r JOIN directories d ON d.id = r.key WHERE r.status = 'queued' AND d.library_id NOT IN (SELECT library_id FROM scan_runs "
        "WHERE status = 'running' AND library_id <= 2) ORDER BY created_ms, key LIMIT 1",
    ),
    (
        "anti_no_active_scan",
        lambda c: _claimable(c).groupBy("library_id").agg(F.count("*").alias("n")),
        f"SELECT d.library_id, count(*) AS n FROM {_RECONCILE} r JOIN directories d ON d.id = r.key WHERE r.status = 'queued' AND d.library_id NOT IN (SELECT library_id FROM "
        "scan_runs WHERE status = 'running' AND library_id <= 2) GROUP BY 1",
    ),
    (
        "recover_expired",
        lambda c: J.recovered(c.media_jobs, 3_000_000, 3),
        "SELECT id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts >= 3 THEN 'interrupted' END AS error_code FROM media_jobs WHERE status = "
        "'running' AND lease_expires_at_ms <= 3000000",
    ),
    (
        "recover_expired_scans",
        lambda c: J.recovered(c.scan_runs, 2_000_000, 3, "interrupted"),
        "SELECT id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'interrupted' END AS status, CASE WHEN attempts >= 3 THEN 'interrupted' END AS error_code FROM scan_runs WHERE "
        "status = 'running' AND lease_expires_at_ms <= 2000000",
    ),
    (
        "retry_backoff",
        lambda c: c.media_jobs.filter("attempts > 0").select("id", X.retry_delay_ms(F.col("attempts")).alias("media_ms"), X.reconcile_delay_ms(F.col("attempts") + 2).alias("reconcile_ms")),
        "SELECT id, 5000 * (1 << (attempts - 1)) AS media_ms, 1000 * (1 << (least(greatest(attempts + 2, 1), 5) - 1)) AS reconcile_ms FROM media_jobs WHERE attempts > 0",
    ),
    (
        "finish_job",
        lambda c: J.finished(c.media_jobs, _results(c), NOW),
        "SELECT id, CASE WHEN o = 'succeeded' THEN 'succeeded' WHEN o = 'retry' AND attempts < 3 THEN 'queued' WHEN o = 'stale' THEN 'stale' ELSE 'failed' END AS status, CASE "
        f"WHEN o IN ('retry', 'permanent') THEN 'timeout' END AS error_code, CASE WHEN o = 'retry' AND attempts < 3 THEN {NOW} + 5000 * (1 << (attempts - 1)) END AS "
        "available_at_ms, o = 'stale' AS dropped FROM (SELECT *, list_extract(['succeeded', 'retry', 'permanent', 'stale'], CAST(id % 4 + 1 AS INT)) AS o FROM media_jobs WHERE "
        "status = 'running' AND (id % 9 <> 0 OR attempts = 9))",
    ),
    (
        "fail_job_projection",
        lambda c: c.media_jobs.filter("status = 'failed' and variant = 'grid'").join(c.assets.select(F.col("id").alias("asset_id"), "probe_status"), "asset_id").select("asset_id", F.lit("failed").alias("thumbnail_status"), F.when(F.col("probe_status") == "ready", "ready").otherwise("failed").alias("probe_status")),
        "SELECT asset_id, 'failed' AS thumbnail_status, CASE WHEN probe_status = 'ready' THEN 'ready' ELSE 'failed' END AS probe_status FROM media_jobs j JOIN assets a ON a.id = "
        "asset_id WHERE j.status = 'failed' AND variant = 'grid'",
    ),
    (
        "media_progress",
        lambda c: J.progress(c.assets, c.media_jobs, c.libraries),
        "SELECT l.id AS library_id, " + ", ".join(f"count(j.id) FILTER (j.variant = '{v}' AND j.status = '{s}') AS {v}_{s}" for v in ("grid", "storyboard") for s in ("queued", "running", "succeeded", "failed")) + f", (SELECT count(*) FROM {_PENDING} p WHERE p.library_id = l.id) AS pending_eligibility FROM libraries l LEFT JOIN media_jobs j ON j.library_id = l.id GROUP BY l.id",
    ),
    ("pending_eligibility", lambda c: J.pending_eligibility(c.assets, c.media_jobs).groupBy("library_id").agg(F.count("*").alias("n")), f"SELECT library_id, count(*) AS n FROM {_PENDING} GROUP BY 1"),
    (
        "enqueue_reconcile",
        lambda c: J.enqueued(_reconcile_jobs(c).drop("id"), c.directories.filter("id >= 10000000 and id % 2 = 0").select(F.col("id").alias("key"), (F.col("id") % 1000 + 400).alias("at_ms")), 750, 5000),
        "SELECT key, CASE WHEN key % 2 = 0 AND status = 'failed' THEN 'queued' ELSE status END AS status, requested_revision + CASE WHEN key % 2 = 0 THEN 1 ELSE 0 END AS "
        "requested_revision, CASE WHEN key % 2 = 0 AND status = 'failed' THEN key % 1000 + 400 ELSE created_ms END AS created_ms, CASE WHEN key % 2 = 0 AND status <> 'running' "
        "THEN least(key % 1000 + 1150, CASE WHEN status = 'failed' THEN key % 1000 + 400 ELSE created_ms END + 5000) END AS available_ms, CASE WHEN key % 2 = 0 AND status = "
        f"'failed' THEN 0 ELSE attempts END AS attempts FROM {_RECONCILE}",
    ),
    (
        "reconcile_fail",
        lambda c: J.reconcile_failed(_reconcile_jobs(c), NOW),
        f"SELECT id, CASE WHEN attempts < 5 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts < 5 THEN {NOW} + 1000 * (1 << (attempts - 1)) END AS available_at_ms FROM "
        f"{_RECONCILE} WHERE status = 'running'",
    ),
    (
        "coalesce",
        lambda c: J.coalesced(c.system_events.withColumn("bin", F.col("id") % 5), ["bin", "module"], "created_at_ms"),
        "SELECT id % 5 AS bin, module, min(created_at_ms) AS first_ms, max(created_at_ms) AS last_ms, count(*) AS requested_revision FROM system_events GROUP BY 1, 2",
    ),
    (
        "scan_admission",
        lambda c: J.scan_admission(c.libraries, _runs(c), c.libraries.filter("id = 3").select(F.col("id").alias("library_id"))),
        "SELECT library_id, decision, CASE WHEN decision = 'queued' THEN g + 1 END AS generation FROM (SELECT l.id AS library_id, coalesce(max(generation), 0) AS g, CASE WHEN "
        "l.id = 3 THEN 'conflict' WHEN count(*) FILTER (r.status IN ('queued', 'running')) > 0 THEN 'coalesced' WHEN (SELECT count(*) FROM scan_runs WHERE status IN ('queued', "
        f"'running')) >= 256 THEN 'full' ELSE 'queued' END AS decision FROM libraries l LEFT JOIN (SELECT *, {_GEN} AS generation FROM scan_runs) r ON r.library_id = l.id GROUP BY "
        "l.id)",
    ),
    (
        "next_generation",
        lambda c: c.libraries.select(F.col("id").alias("library_id")).join(_runs(c).groupBy("library_id").agg(F.max("generation").alias("g")), "library_id", "left").select("library_id", (F.coalesce("g", F.lit(0)) + 1).alias("generation")),
        "SELECT l.id AS library_id, count(r.id) + 1 AS generation FROM libraries l LEFT JOIN scan_runs r ON r.library_id = l.id GROUP BY 1",
    ),
    (
        "active_scan_count",
        lambda c: c.scan_runs.filter("status in ('queued', 'running')").agg(F.count("*").alias("active"), (F.count("*") >= 256).alias("full")),
        "SELECT count(*) AS active, count(*) >= 256 AS full FROM scan_runs WHERE status IN ('queued', 'running')",
    ),
    (
        "scan_cancel",
        lambda c: J.scan_cancellation(c.scan_runs),
        "SELECT id, CASE WHEN status = 'queued' THEN 'cancelled' ELSE status END AS status, cancel_requested OR status = 'running' AS cancel_requested, CASE WHEN status = "
        "'queued' THEN 'cancelled' WHEN status = 'running' AND NOT cancel_requested THEN 'flagged' WHEN status = 'running' THEN 'already_flagged' ELSE 'not_active' END AS outcome "
        "FROM scan_runs",
    ),
    (
        "scan_abort",
        lambda c: J.abort_effect(_ended(c), c.libraries.withColumn("current_generation", F.col("id") % 2 * 2)),
        f"SELECT r.id, library_id, CASE WHEN r.status <> 'cancelled' THEN CASE WHEN r.error_code IN ({_CODES}) THEN r.error_code ELSE 'internal_error' END END AS error_code, CASE "
        "r.status WHEN 'cancelled' THEN CASE WHEN library_id % 2 = 1 THEN 'ready' ELSE 'pending' END WHEN 'offline' THEN 'offline' ELSE 'error' END AS library_status FROM "
        f"{_ENDED} r WHERE r.status IN ('failed', 'interrupted', 'cancelled', 'offline')",
    ),
    (
        "derivation_input",
        lambda c: c.assets.join(c.libraries.select(F.col("id").alias("library_id"), "root_rel_path"), "library_id").join(c.thumbnails.filter("variant = 'grid' and status = 'ready'").select(F.col("asset_id").alias("id"), "source_fingerprint", F.lit(True).alias("g")), ["id", "source_fingerprint"], "left").select("id", "root_rel_path", "relative_path", F.coalesce("g", F.lit(False)).alias("has_grid")),
        "SELECT a.id, root_rel_path, relative_path, EXISTS (SELECT 1 FROM thumbnails t WHERE t.asset_id = a.id AND t.variant = 'grid' AND t.status = 'ready' AND "
        "t.source_fingerprint = a.source_fingerprint) AS has_grid FROM assets a JOIN libraries l ON l.id = a.library_id",
    ),
    (
        "append_event",
        lambda c: O.appended(c.system_events, c.system_events.filter("id <= 10").select((F.col("id") + 1_000_000).alias("id"), "level", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("module")).alias("module"), "created_at_ms"), 5000),
        "SELECT * FROM (SELECT * FROM system_events UNION ALL SELECT id + 1000000, level, CASE WHEN id % 2 = 1 THEN module END, created_at_ms FROM system_events WHERE id <= 10) "
        "ORDER BY id DESC LIMIT 5000",
    ),
    (
        "backfill_keys",
        lambda c: c.directories.withColumn("old", F.when(F.col("id") % 2 == 0, F.col("search_name_key")).otherwise("")).select("id", F.when(F.col("old") == "", X.search_text_key(F.col("name"))).otherwise(F.col("old")).alias("search_name_key")),
        "SELECT id, lower(name) AS search_name_key FROM directories",
    ),
    (
        "library_details",
        lambda c: O.library_details(c.libraries, c.scan_runs, c.assets, c.directories),
        "SELECT id AS library_id, name, status, (SELECT max(finished_at_ms) FROM scan_runs r WHERE r.library_id = l.id AND r.status = 'succeeded') AS last_success_ms, (SELECT "
        "max_by(r.id, r.created_at_ms * 1000000 + r.id) FROM scan_runs r WHERE r.library_id = l.id) AS latest_scan_id, (SELECT count(*) FROM assets a WHERE a.library_id = l.id) "
        "AS asset_count, (SELECT count(*) FROM directories d WHERE d.library_id = l.id) AS directory_count FROM libraries l",
    ),
    (
        "latest_scan_per_library",
        lambda c: c.scan_runs.groupBy("library_id").agg(F.max_by(F.struct("id", "status"), F.struct("created_at_ms", "id")).alias("x")).select("library_id", "x.id", "x.status"),
        "SELECT library_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY created_at_ms DESC, id DESC) AS r FROM scan_runs) WHERE r = 1",
    ),
    (
        "due_libraries",
        lambda c: O.due_libraries(c.libraries, c.scan_runs.filter("status not in ('queued', 'running') or library_id = 1"), 5_900_000),
        "SELECT l.id AS library_id FROM libraries l LEFT JOIN (SELECT * FROM scan_runs WHERE status NOT IN ('queued', 'running') OR library_id = 1) r ON r.library_id = l.id GROUP "
        "BY 1 HAVING coalesce(max(created_at_ms), 0) <= 5900000 AND count(*) FILTER (r.status IN ('queued', 'running')) = 0",
    ),
    (
        "scheduler",
        lambda c: O.due_libraries(c.libraries, c.scan_runs.filter("library_id > 2"), 10**12).filter("library_id > 0").orderBy("library_id").limit(64),
        "SELECT id AS library_id FROM libraries l WHERE id <= 2 OR NOT EXISTS (SELECT 1 FROM scan_runs r WHERE r.library_id = l.id AND r.status IN ('queued', 'running'))",
    ),
    (
        "correlated_latest_attempt",
        lambda c: O.failures(c.media_jobs, c.attempts, limit=None),
        "SELECT j.id, asset_id, variant, error_code, t.id AS attempt_id, t.outcome, t.duration_ms FROM media_jobs j LEFT JOIN attempts t ON t.id = (SELECT max(x.id) FROM attempts "
        "x WHERE x.job_id = j.id) WHERE status = 'failed' ORDER BY j.id DESC LIMIT 10001",
    ),
    (
        "keyset_failures",
        lambda c: O.failures(c.media_jobs, c.attempts, before=400, variant="grid"),
        "SELECT j.id, asset_id, variant, error_code, t.id AS attempt_id, t.outcome, t.duration_ms FROM media_jobs j LEFT JOIN attempts t ON t.id = (SELECT max(x.id) FROM attempts "
        "x WHERE x.job_id = j.id) WHERE status = 'failed' AND variant = 'grid' AND j.id < 400 ORDER BY j.id DESC LIMIT 51",
    ),
    (
        "latest_failure_revision",
        lambda c: c.media_jobs.filter("status = 'failed'").orderBy(F.desc("finished_at_ms"), F.desc("id")).limit(1).select("id", "finished_at_ms"),
        "SELECT id, finished_at_ms FROM media_jobs WHERE status = 'failed' ORDER BY finished_at_ms DESC, id DESC LIMIT 1",
    ),
    (
        "attempt_history_top10",
        lambda c: O.newest(c.attempts, "job_id", 10).select("job_id", "id", "outcome", F.col("r").alias("pos")),
        "SELECT job_id, id, outcome, r AS pos FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id DESC) AS r FROM attempts) WHERE r <= 10",
    ),
    (
        "issues_top50",
        lambda c: O.newest(c.attempts.filter("outcome = 'failed'").withColumn("run", F.col("id") % 7), "run", 50).select("run", "id"),
        "SELECT run, id FROM (SELECT id % 7 AS run, id, row_number() OVER (PARTITION BY id % 7 ORDER BY id DESC) AS r FROM attempts WHERE outcome = 'failed') WHERE r <= 50",
    ),
    ("event_log_retention", lambda c: O.retained(c.system_events, 5000), "SELECT * FROM system_events ORDER BY id DESC LIMIT 5000"),
    (
        "bounded_min_of_top_n",
        lambda c: O.retained(c.system_events, 5000).agg(F.min("id").alias("least_id")),
        "SELECT min(id) AS least_id FROM (SELECT id FROM system_events ORDER BY id DESC LIMIT 5000)",
    ),
    ("cache_usage", lambda c: O.cache_usage(c.thumbnails), "SELECT CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS used_bytes FROM thumbnails WHERE status = 'ready'"),
    (
        "cache_summary",
        lambda c: O.cache_summary(c.thumbnails, _caches(c)),
        "SELECT quota_bytes, available_bytes, u AS usage_bytes, CAST(quota_bytes * 90 // 100 AS BIGINT) AS high_watermark_bytes, CAST(quota_bytes * 80 // 100 AS BIGINT) AS "
        "low_watermark_bytes, CAST(536870912 AS BIGINT) AS safe_free_space_bytes, CASE WHEN u > quota_bytes * 90 // 100 AND available_bytes < 536870912 THEN 'quota_and_storage' "
        "WHEN u > quota_bytes * 90 // 100 THEN 'quota' WHEN available_bytes < 536870912 THEN 'storage' ELSE 'normal' END AS pressure FROM (SELECT DISTINCT asset_id % 97 * 500000 "
        "AS quota_bytes, asset_id % 89 * 12345678 AS available_bytes FROM thumbnails), (SELECT CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS u FROM thumbnails WHERE status = "
        "'ready')",
    ),
    (
        "lru_eviction_prefix",
        lambda c: O.eviction(c.thumbnails, 2_000_000),
        "SELECT asset_id, variant, byte_size FROM (SELECT *, coalesce(sum(byte_size) OVER (ORDER BY last_accessed_at_ms, asset_id, variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
        "PRECEDING), 0) AS freed, sum(byte_size) OVER () AS used FROM thumbnails WHERE status = 'ready') WHERE freed < used - 2000000",
    ),
    (
        "lru_topk",
        lambda c: O.least_recent(c.thumbnails, 256).select("asset_id", "variant", "last_accessed_at_ms"),
        "SELECT asset_id, variant, last_accessed_at_ms FROM thumbnails WHERE status = 'ready' ORDER BY last_accessed_at_ms, asset_id, variant LIMIT 256",
    ),
    (
        "fifo_deletions",
        lambda c: B.numbered(c.scan_runs.orderBy("created_at_ms", "id").limit(20), F.col("created_at_ms"), F.col("id")).select("id", "pos"),
        "SELECT id, row_number() OVER (ORDER BY created_at_ms, id) AS pos FROM scan_runs ORDER BY pos LIMIT 20",
    ),
    ("exists_flag", lambda c: c.media_jobs.filter("status = 'running'").agg((F.count("*") > 0).alias("found")), "SELECT count(*) > 0 AS found FROM media_jobs WHERE status = 'running'"),
    ("nearest_rank_percentile", lambda c: O.nearest_rank(c.attempts, "duration_ms", 95), "SELECT quantile_disc(duration_ms, 0.95) AS value FROM attempts"),
]


def _claimable(c):
    """Queued reconciles of libraries without a running scan; library 1 and 2 are taken as scanning where they have one."""
    r = _reconcile_jobs(c).drop("id").filter("status = 'queued'").join(c.directories.select(F.col("id").alias("key"), "library_id"), "key")
    return r.join(c.scan_runs.filter("status = 'running' and library_id <= 2"), "library_id", "left_anti")
