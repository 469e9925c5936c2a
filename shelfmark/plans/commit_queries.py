"""Queries on guarded writes, each with its SQL. The batches of commands are made from the catalogue's tables by rule."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.operators import command_log as L
from shelfmark.operators import commits as C
from shelfmark.operators import ingest as I
from shelfmark.operators import operations as O
from shelfmark.operators import tree as T
from shelfmark.plans.job_queries import _MERGE
from shelfmark.sources.reconciled import Reconciled
from shelfmark.staging import shared_dir

NOW = 2_000_000
_CHOICE = "list_extract([{0}], CAST({1} AS INT))"


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _ready(c):
    """A derivative of every asset's seventh job: some of an old file, some empty, some boards of a wrong plan."""
    k = F.col("id")
    board = k % 2 == 1
    frames = F.when(board & (k % 3 != 0), F.when(F.col("duration_ms") < 5000, 4).otherwise(10)).when(board, 7)
    return c.assets.filter("id % 7 < 4").select(
        k.alias("seq"), k.alias("asset_id"), F.when(board, "storyboard").otherwise("grid").alias("variant"), F.when(k % 11 == 0, "v1:0:0").otherwise(F.col("source_fingerprint")).alias("source_fingerprint"),
        F.when(k % 13 == 0, 0).otherwise(k % 900 + 1).alias("byte_size"), frames.alias("frame_count"), (k + 5_000_000).alias("at_ms"),
    )


_OUTCOMES = """
ready AS (SELECT id AS asset_id, id % 2 = 1 AS board, CASE WHEN id % 11 = 0 THEN 'v1:0:0' ELSE source_fingerprint END AS fp, CASE WHEN id % 13 = 0 THEN 0 ELSE id % 900 + 1 END AS bytes, id + 5000000 AS at_ms,
  CASE WHEN id % 2 = 1 AND id % 3 <> 0 THEN CASE WHEN duration_ms < 5000 THEN 4 ELSE 10 END WHEN id % 2 = 1 THEN 7 END AS frames FROM assets WHERE id % 7 < 4),
outcomes AS (SELECT r.*, a.library_id, CASE WHEN bytes <= 0 THEN 'invalid'
    WHEN fp <> a.source_fingerprint OR (board AND NOT coalesce(a.kind = 'video' AND a.probe_status = 'ready' AND a.duration_ms >= 2000, false)) THEN 'source_changed'
    WHEN board AND frames <> CASE WHEN a.duration_ms < 5000 THEN 4 ELSE 10 END THEN 'invalid' ELSE 'committed' END AS outcome,
    CASE WHEN board THEN 'storyboard' ELSE 'grid' END AS variant FROM ready r JOIN assets a ON a.id = r.asset_id)"""


def _failures(c):
    k = F.col("id")
    return c.assets.filter("id % 5 = 0").select(k.alias("seq"), k.alias("asset_id"), F.lit("grid").alias("variant"), F.when(k % 3 == 0, "v1:0:0").otherwise(F.col("source_fingerprint")).alias("source_fingerprint"), F.lit("invalid_media").alias("error_code"))


def _pathed(c):
    path = X.cache_relative_path(F.col("library_id"), F.col("asset_id"), F.col("variant"), F.col("source_fingerprint"), F.lit(1))
    return c.thumbnails.select("asset_id", "variant", "status", "source_fingerprint", "last_accessed_at_ms", path.alias("cache_path"))


def _sized(c):
    return _pathed(c).join(c.thumbnails.select("asset_id", "variant", "byte_size"), ["asset_id", "variant"])


def _evictions(c):
    """The least recently used rows as they were listed; a part of them has another size by now, or lies elsewhere."""
    k = F.col("asset_id")
    least = O.least_recent(_sized(c), 4096)
    return least.select("asset_id", "variant", F.when(k % 5 == 0, "elsewhere").otherwise(F.col("cache_path")).alias("cache_path"), F.when(k % 7 == 0, F.col("byte_size") + 1).otherwise(F.col("byte_size")).alias("byte_size"))


def _cache_listing(c):
    """The files of the cache: some are gone, some cut short; and some belong to nothing."""
    k = F.col("asset_id")
    files = _sized(c).filter("status = 'ready' and asset_id % 29 <> 0").select("cache_path", F.when(k % 31 == 0, F.col("byte_size") - 1).otherwise(F.col("byte_size")).alias("byte_size"))
    return files.unionByName(files.select(F.concat("cache_path", F.lit(".part")).alias("cache_path"), "byte_size"))


def _touches(c):
    t = _pathed(c).filter("asset_id % 3 = 0")
    path = F.when(F.col("asset_id") % 2 == 0, F.col("cache_path")).otherwise(F.lit("elsewhere"))
    one = t.select("asset_id", "variant", "source_fingerprint", path.alias("cache_path"), (F.col("asset_id") + 9_000_000).alias("at_ms"))
    return one.unionByName(one.withColumn("at_ms", F.col("at_ms") - 5))


def _removals(c):
    k = F.col("id")
    status = _pick(("queued", "running", "running", "failed", "queued"), (k - 1) % 5 + 1)
    return c.libraries.select((k + 100).alias("id"), k.alias("library_id"), status.alias("status"), (F.lit(1000) - 10 * k).alias("created_at_ms"), F.when(status != "queued", 500).alias("started_at_ms"), k.alias("revision"))


_REMOVALS = f"""(SELECT id + 100 AS id, id AS library_id, {_CHOICE.format("'queued', 'running', 'running', 'failed', 'queued'", "(id - 1) % 5 + 1")} AS status, 1000 - 10 * id AS created_at_ms, id AS revision FROM libraries)"""
_SCANNING = "(SELECT library_id FROM scan_runs WHERE status IN ('queued', 'running') AND library_id <= 2)"


def _scanning(c):
    """Runs of the first two libraries; the others are taken as idle."""
    return c.scan_runs.filter("library_id <= 2")


def _after_removal(c):
    tables = {"assets": c.assets, "directories": c.directories, "scan_runs": c.scan_runs, "libraries": c.libraries.withColumn("library_id", F.col("id"))}
    left = C.without_removed(_removals(c), _scanning(c), tables)
    one = [df.select(F.lit(name).alias("kept_in"), F.col("id").cast("long").alias("id")) for name, df in left.items()]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


_LEFT = f"NOT IN (SELECT library_id FROM {_REMOVALS} WHERE status = 'running' AND library_id NOT IN {_SCANNING})"


def _renames(c):
    """A command of every customer on the library of its nation, for a few names in two spellings."""
    k = F.col("c_custkey")
    nation = c.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 1).cast("long").alias("id"))
    name = F.when(k % 3 == 0, F.lower("c_mktsegment")).when(k % 7 == 0, F.concat("c_mktsegment", F.lit(" (old)"))).otherwise(F.col("c_mktsegment"))
    log = c.table("customer").join(nation, "c_nationkey").select(k.alias("seq"), "id", (k % 40).alias("expected_revision"), name.alias("name"))
    return L.renames(c.libraries.withColumn("revision", F.col("id")), _removals(c).filter("library_id = 5"), log)


_RENAMES = """,
asked AS (SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey AS seq, CAST(n_regionkey + 1 AS BIGINT) AS id, c_custkey % 40 AS e, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' (old)' ELSE c_mktsegment END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
told AS (
  SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS outcome, (SELECT list({'id': id, 'name': name, 'revision': id} ORDER BY id) FROM libraries) AS libs
  UNION ALL SELECT place, outcome, CASE WHEN outcome = 'renamed' THEN list_transform(libs, lambda x: CASE WHEN x.id = ask THEN {'id': x.id, 'name': name, 'revision': x.revision + 1} ELSE x END) ELSE libs END FROM (
    SELECT place, libs, ask, name, CASE WHEN own.revision <> e THEN 'precondition_failed' WHEN ask = 5 THEN 'removal_active' WHEN own.name = name THEN 'unchanged' WHEN taken THEN 'name_exists' ELSE 'renamed' END AS outcome FROM (
      SELECT a.place, t.libs, a.id AS ask, a.e, a.name, list_filter(t.libs, lambda x: x.id = a.id)[1] AS own, len(list_filter(t.libs, lambda x: x.id <> a.id AND lower(x.name) = lower(a.name))) > 0 AS taken FROM told t JOIN asked a ON a.place = t.place + 1))),
final AS (SELECT unnest(libs) AS x FROM told WHERE place = (SELECT max(place) FROM told))"""


def _versioned(c):
    return c.directories.select("id", (F.col("id") % 5 + 1).alias("revision"), "name")


def _rows_cas(c):
    k = F.col("id")
    ask = _versioned(c).filter("id % 3 <> 0").select(k.alias("seq"), "id", F.when(k % 2 == 0, F.col("revision")).otherwise(F.col("revision") - 1).alias("expected_revision"), F.concat("name", F.lit(" (2)")).alias("value"))
    told = L.updates(_versioned(c), ask.unionByName(ask.withColumns({"seq": k + 10**9, "value": F.lit("late")})), "name")
    hit = told.filter("seq is not null").groupBy("id").agg(F.bool_or(F.col("outcome") == "applied").alias("applied"))
    return told.filter("seq is null").select("id", "revision", "name").join(hit, "id", "left")


def _cas_log(c):
    """Four commands on each of two directories in three; what they expect is right for some in their turn only."""
    k, j = F.col("id"), F.col("j")
    ask = _versioned(c).filter("id % 3 <> 0").withColumn("j", F.explode(F.array(*[F.lit(x) for x in range(4)])))
    expected = F.col("revision") + F.floor(j * (k % 4) / 3)
    return L.updates(_versioned(c), ask.select((k * 4 + j).alias("seq"), "id", expected.alias("expected_revision"), F.concat("name", F.lit(" v"), j.cast("string")).alias("value")), "name").filter("seq is not null")


def _replays(c):
    key = lambda x: F.sha2(x.cast("string"), 256)
    r, k = c.attempts.filter("id % 4 = 0"), F.col("id")
    requests = r.select(k.alias("seq"), key(F.col("job_id")).alias("key_hash"), key(k % 2).alias("request_hash"))
    records = c.attempts.filter("job_id % 3 = 0").select("job_id").distinct().select(key(F.col("job_id")).alias("key_hash"), key(F.lit(0)).alias("request_hash"), F.col("job_id").alias("result_id"))
    return C.replays(requests, records)


def _phase_runs(c):
    k = F.col("id")
    return c.scan_runs.select("id", "status", _pick(C.PHASES, k % 3 + 1).alias("phase"), (k % 4).alias("revision"), "lease_expires_at_ms")


def _phases(c):
    k = F.col("id")
    to = F.when(k % 5 != 0, _pick(C.PHASES, (k + F.floor(k / 3)) % 3 + 1))
    return L.phases(_phase_runs(c), c.scan_runs.filter("id % 6 <> 0").select(k.alias("seq"), "id", to.alias("phase"), (k + NOW).alias("at_ms")), 60_000)


def _phase_log(c):
    """Every event is a command on one of the runs."""
    runs = c.scan_runs.agg(F.max("id").alias("most"))
    e, k = c.table("events").crossJoin(F.broadcast(runs)), F.col("event_id")  # one row
    to = F.when(k % 4 != 0, _pick(C.PHASES, F.floor(k / 7) % 3 + 1))
    return L.phases(_phase_runs(c), e.select(k.alias("seq"), (F.col("user_id") % F.col("most") + 1).alias("id"), to.alias("phase"), (k + NOW).alias("at_ms")), 60_000)


def _reconciling(c):
    k = F.col("id")
    return c.directories.filter("id >= 10000000").select(
        k.alias("key"), k.alias("id"), "library_id", _pick(("queued", "running", "running"), (k - 1) % 3 + 1).alias("status"), (k % 5 + 1).alias("requested_revision"), (k % 4 + 1).alias("claimed_revision"),
        (k % 7 + 1).alias("attempts"), (k % 100 * 50_000).alias("lease_expires_at_ms"),
    )


_JOBS = f"""(SELECT id AS key, id, library_id, {_CHOICE.format("'queued', 'running', 'running'", "(id - 1) % 3 + 1")} AS status, id % 5 + 1 AS requested_revision, id % 4 + 1 AS claimed_revision, id % 7 + 1 AS attempts, id % 100 * 50000 AS lease_expires_at_ms FROM directories WHERE id >= 10000000)"""


def _changes(c):
    key = ["library_id", "relative_path"]
    where = c.assets.select(*key, "directory_id").unionByName(c.listing.select(*key, "directory_id")).distinct()
    return I.difference(c.assets, c.listing).join(where, key)


_CHANGES = """(SELECT coalesce(n.directory_id, o.directory_id) AS directory_id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM assets o FULL JOIN listing n ON o.library_id = n.library_id AND o.relative_path = n.relative_path WHERE o.id IS NULL OR n.name IS NULL OR o.source_fingerprint <> n.source_fingerprint)"""


def _reconciled(c):
    """The catalogue after the running reconciles are committed with what the listing has of their directories."""
    store = Reconciled(c.spark, f"{shared_dir(c.spark)}/reconciled-{uuid.uuid4().hex}", 16)
    jobs = _reconciling(c).select("key", "library_id", "status", "requested_revision", "claimed_revision", "attempts", F.lit(0).cast("long").alias("available_at_ms"))
    store.create(c.assets, c.directories, jobs, c.libraries)
    store.commit(c.listing, 3, NOW)
    return store.store


def _reconciled_queue(c):
    store = _reconciled(c)
    jobs = store.read("jobs").select(F.lit("job").alias("kind"), F.col("key").alias("id"), F.col("status").alias("state"), F.col("attempts").cast("long").alias("n"))
    return jobs.unionByName(store.read("libraries").select(F.lit("library").alias("kind"), "id", F.lit("content_revision").alias("state"), F.col("content_revision").alias("n")))


_AFTER = f""",
asked AS (SELECT key FROM {_JOBS} WHERE status = 'running'),
here AS (SELECT n.*, o.id AS old_id, o.source_fingerprint = n.source_fingerprint AS same, o.probe_status AS old_status, o.width AS old_width FROM listing n LEFT JOIN assets o USING (library_id, relative_path) WHERE n.directory_id IN (SELECT key FROM asked)),
now AS (
  SELECT id, library_id, directory_id, relative_path, source_fingerprint, probe_status, width, last_seen_generation FROM assets WHERE directory_id NOT IN (SELECT key FROM asked)
  UNION ALL SELECT coalesce(old_id, (SELECT max(id) FROM assets) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY library_id, directory_id, relative_path)), library_id, directory_id, relative_path, source_fingerprint, CASE WHEN coalesce(same, false) THEN old_status ELSE 'pending' END, CASE WHEN same THEN old_width END, 3 FROM here)"""


def _found(c):
    d = c.directories.filter("id < 2000000 or id % 3 <> 0")
    new = c.directories.filter("id >= 10000000 and id % 5 = 0").select("library_id", F.concat("relative_path", F.lit("/new")).alias("relative_path"))
    lost = c.directories.filter("id >= 10000000 and id % 11 = 0").select("library_id", F.explode(F.array(*[F.concat("relative_path", F.lit(x)) for x in ("/gone/a", "/gone/a/b")])).alias("relative_path"))
    return d.select("library_id", "relative_path").unionByName(new).unionByName(lost)  # "gone" itself was not found


_FOUND = """
f AS (SELECT library_id, relative_path FROM directories WHERE id < 2000000 OR id % 3 <> 0 UNION SELECT library_id, relative_path || '/new' FROM directories WHERE id >= 10000000 AND id % 5 = 0
  UNION SELECT library_id, relative_path || '/gone/a' FROM directories WHERE id >= 10000000 AND id % 11 = 0 UNION SELECT library_id, relative_path || '/gone/a/b' FROM directories WHERE id >= 10000000 AND id % 11 = 0),
h AS (SELECT library_id, relative_path, CASE WHEN relative_path <> '' THEN regexp_replace(relative_path, '/?[^/]*$', '') END AS up FROM f),
t AS (SELECT * FROM h WHERE up IS NULL UNION ALL SELECT h.* FROM t JOIN h ON h.library_id = t.library_id AND h.up = t.relative_path),
n AS (SELECT t.*, (SELECT max(id) FROM directories) + row_number() OVER (ORDER BY library_id, up, relative_path) AS id FROM t WHERE (library_id, relative_path) NOT IN (SELECT (library_id, relative_path) FROM directories)),
o AS (SELECT id, library_id, relative_path, CASE WHEN (library_id, relative_path) IN (SELECT (library_id, relative_path) FROM t) THEN 3 ELSE last_seen_generation END AS last_seen_generation FROM directories UNION ALL SELECT id, library_id, relative_path, 3 FROM n)"""


def _discovery(c):
    k = F.col("id")
    rows = c.scan_runs.select("id", "status", F.when(k % 4 == 0, "timeout").alias("error_code"), (k % 3 + 1).alias("revision"), F.col("created_at_ms").alias("updated_at_ms"))
    status = F.when(k % 5 == 0, "queued").otherwise(F.col("status"))
    return C.discovered(rows, c.scan_runs.filter("id % 2 = 0").select("id", status.alias("status"), F.when(k % 8 == 0, "timeout").alias("error_code"), F.lit(NOW).alias("at_ms")))


def _sessions(c):
    k = F.col("id")
    users = c.table("customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 6 != 0).alias("enabled"), (F.col("c_custkey") % 2).alias("session_revision"))
    sessions = c.attempts.select(k.alias("session_id"), F.col("job_id").alias("user_id"), (k % 2).alias("session_revision"), F.when(k % 9 == 0, k).alias("revoked_at_ms"), (k * 100).alias("expires_at_ms"))
    return C.live_sessions(sessions, users, 100_000)


def _counted(c):
    k = F.col("id")
    new = T.rollup_counts(c.directories, c.assets).select("id", "direct_count", "recursive_count")
    old = new.withColumns({"direct_count": F.when(k % 3 == 0, F.lit(0)).otherwise(F.col("direct_count")), "recursive_count": F.when(k % 3 == 0, F.lit(0)).otherwise(F.col("recursive_count"))})
    return C.counted(old, new, ("direct_count", "recursive_count"))


def _problems(c):
    k = F.col("id")
    names = [*C.RESULTS, "something_else"]
    return c.media_jobs.select("id", F.when(k % 14 != 0, _pick(names, k % len(names) + 1)).alias("problem"))


def _results(c):
    outcome, code, delay = C.job_result(F.col("problem"))
    return _problems(c).select("id", outcome.alias("outcome"), code.alias("code"), delay.alias("delay_ms"))


_NAMES = ", ".join(f"'{x}'" for x in [*C.RESULTS, "something_else"])
#: What ends a job, as it is specified: stale, for good, or to be tried again, with its code.
_CLASSES = """(VALUES ('source_changed', 'stale', NULL), ('storyboard_not_eligible', 'stale', NULL), ('invalid_media', 'permanent', 'invalid_media'), ('unsupported_media', 'permanent', 'unsupported_media'),
  ('source_too_large', 'permanent', 'media_processing_failed'), ('storyboard_budget_exhausted', 'permanent', 'timeout'), ('deadline_exceeded', 'retry', 'timeout'), ('processing_timed_out', 'retry', 'timeout'),
  ('source_unavailable', 'retry', 'source_unavailable'), ('publish_failed', 'retry', 'cache_unavailable'), ('cache_capacity', 'retry', 'cache_unavailable')) t(problem, outcome, code)"""
_THUMBS = "SELECT asset_id, variant, library_id, status, error_code, byte_size, last_accessed_at_ms, source_fingerprint, frame_count FROM thumbnails t"
_PATHED = "(SELECT asset_id, variant, status, source_fingerprint, last_accessed_at_ms, byte_size, 'libraries/lib_' || library_id || '/' || substr(h, 1, 2) || '/' || h || '.webp' AS cache_path FROM (SELECT *, sha256(asset_id || chr(0) || variant || chr(0) || source_fingerprint || chr(0) || '1') AS h FROM thumbnails))"

ENTRIES = [
    (
        "commit_ready_outcome",
        lambda c: C.ready_outcomes(c.assets, _ready(c)).select("asset_id", "variant", "outcome"),
        f", {_OUTCOMES} SELECT asset_id, variant, outcome FROM outcomes",
    ),
    (
        "commit_ready",
        lambda c: C.with_ready(c.thumbnails, C.ready_outcomes(c.assets, _ready(c))),
        f""", {_OUTCOMES} {_THUMBS} WHERE (asset_id, variant) NOT IN (SELECT (asset_id, variant) FROM outcomes WHERE outcome = 'committed')
        UNION ALL SELECT asset_id, variant, library_id, 'ready', NULL, bytes, at_ms, fp, frames FROM outcomes WHERE outcome = 'committed'""",
    ),
    (
        "commit_failure",
        lambda c: C.with_failures(c.assets, c.thumbnails, _failures(c)),
        f"""{_THUMBS} WHERE NOT (variant = 'grid' AND asset_id % 5 = 0 AND asset_id % 3 <> 0)
        UNION ALL SELECT id, 'grid', library_id, 'failed', 'invalid_media', NULL, NULL, source_fingerprint, NULL FROM assets WHERE id % 5 = 0 AND id % 3 <> 0""",
    ),
    (
        "thumbnail_touch",
        lambda c: C.touched(_pathed(c), _touches(c)),
        f"SELECT * EXCLUDE (byte_size) REPLACE (CASE WHEN status = 'ready' AND asset_id % 6 = 0 THEN asset_id + 9000000 ELSE last_accessed_at_ms END AS last_accessed_at_ms) FROM {_PATHED}",
    ),
    (
        "rename_if_revision",
        lambda c: _renames(c).filter("seq is not null").select("seq", "id", "outcome"),
        f"{_RENAMES} SELECT seq, id, outcome FROM told JOIN asked USING (place)",
    ),
    (
        "renamed_libraries",
        lambda c: _renames(c).filter("seq is null").select("id", "name", "revision"),
        f"{_RENAMES} SELECT x.id AS id, x.name AS name, x.revision AS revision FROM final",
    ),
    (
        "optimistic_outcomes",
        _cas_log,
        """, begun AS (SELECT id, id % 5 + 1 AS revision, name FROM directories WHERE id % 3 <> 0),
        turn AS (SELECT id, -1 AS j, revision AS r0, revision, name AS n0, name, CAST(NULL AS VARCHAR) AS outcome FROM begun
          UNION ALL SELECT id, j + 1, r0, revision + hit::INT, n0, CASE WHEN hit THEN n0 || ' v' || (j + 1) ELSE name END, CASE WHEN hit THEN 'applied' ELSE 'precondition_failed' END FROM (SELECT *, r0 + (j + 1) * (id % 4) // 3 = revision AS hit FROM turn WHERE j < 3))
        SELECT id * 4 + j AS seq, id, outcome, revision, name FROM turn WHERE j >= 0""",
    ),
    (
        "optimistic_update",
        _rows_cas,
        """SELECT id, id % 5 + 1 + CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN 1 ELSE 0 END AS revision, CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN name || ' (2)' ELSE name END AS name,
        CASE WHEN id % 3 <> 0 THEN id % 2 = 0 END AS applied FROM directories""",
    ),
    (
        "idempotent_create_remove",
        _replays,
        """SELECT seq, sha256(CAST(job_id AS VARCHAR)) AS key_hash, CASE WHEN r <> known THEN 'conflict' WHEN NOT recorded AND seq = result THEN 'created' ELSE 'replayed' END AS outcome, CASE WHEN r = known THEN result END AS result_id
        FROM (SELECT id AS seq, job_id, id % 2 AS r, job_id % 3 = 0 AS recorded, CASE WHEN job_id % 3 = 0 THEN 0 ELSE arg_min(id % 2, id) OVER (PARTITION BY job_id) END AS known,
          CASE WHEN job_id % 3 = 0 THEN job_id ELSE min(id) OVER (PARTITION BY job_id) END AS result FROM attempts WHERE id % 4 = 0)""",
    ),
    (
        "scan_phase",
        lambda c: _phases(c).select("id", "phase", "revision"),
        """SELECT id, list_extract(['checking_root', 'walking', 'finalizing'], CAST(CASE WHEN up THEN b ELSE a END AS INT)) AS phase, id % 4 + up::INT AS revision
        FROM (SELECT *, status = 'running' AND id % 6 <> 0 AND id % 5 <> 0 AND b > a AS up FROM (SELECT id, status, id % 3 + 1 AS a, (id + id // 3) % 3 + 1 AS b FROM scan_runs))""",
    ),
    (
        "lease_touch",
        lambda c: _phases(c).select("id", "lease_expires_at_ms"),
        f"SELECT id, CASE WHEN status = 'running' AND id % 6 <> 0 THEN id + {NOW} + 60000 ELSE lease_expires_at_ms END AS lease_expires_at_ms FROM scan_runs",
    ),
    (
        "scan_phase_log",
        _phase_log,
        f""", turns AS (SELECT user_id % (SELECT max(id) FROM scan_runs) + 1 AS id, event_id AS seq, CASE WHEN event_id % 4 <> 0 THEN event_id // 7 % 3 + 1 ELSE 0 END AS rank FROM events),
        seen AS (SELECT t.id, seq, rank, greatest(r.id % 3 + 1, coalesce(max(rank) OVER (PARTITION BY t.id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM turns t JOIN scan_runs r ON r.id = t.id AND r.status = 'running'),
        ends AS (SELECT id, count(*) FILTER (rank > best) AS ups, max(greatest(rank, best)) AS top, max(seq) AS last FROM seen GROUP BY id)
        SELECT r.id, list_extract(['checking_root', 'walking', 'finalizing'], CAST(coalesce(top, r.id % 3 + 1) AS INT)) AS phase, r.id % 4 + coalesce(ups, 0) AS revision, coalesce(last + {NOW} + 60000, lease_expires_at_ms) AS lease_expires_at_ms FROM scan_runs r LEFT JOIN ends USING (id)""",
    ),
    (
        "discovery_state",
        _discovery,
        f"""SELECT id, CASE WHEN moved THEN s2 ELSE status END AS status, CASE WHEN moved THEN e2 ELSE e1 END AS error_code, id % 3 + 1 + moved::INT AS revision, CASE WHEN moved THEN {NOW} ELSE created_at_ms END AS updated_at_ms
        FROM (SELECT *, id % 2 = 0 AND (status IS DISTINCT FROM s2 OR e1 IS DISTINCT FROM e2) AS moved FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'timeout' END AS e1, CASE WHEN id % 5 = 0 THEN 'queued' ELSE status END AS s2, CASE WHEN id % 8 = 0 THEN 'timeout' END AS e2 FROM scan_runs))""",
    ),
    (
        "claim_removal",
        lambda c: C.next_removal(_removals(c), _scanning(c), NOW),
        f"""SELECT id, library_id, 'running' AS status, CASE WHEN status = 'queued' THEN {NOW} ELSE 500 END AS started_at_ms, revision + (status = 'queued')::INT AS revision
        FROM {_REMOVALS} WHERE status IN ('queued', 'running') AND library_id NOT IN {_SCANNING} ORDER BY created_at_ms, id LIMIT 1""",
    ),
    (
        "removal_fail",
        lambda c: C.failed_removals(_removals(c), _removals(c).filter("library_id <> 2").select(F.col("id").alias("seq"), "id", F.lit("root_unavailable").alias("code")), NOW),
        f"""SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'root_unavailable' END AS error_code, CASE WHEN hit THEN {NOW} END AS finished_at_ms, revision + hit::INT AS revision
        FROM (SELECT *, status = 'running' AND library_id <> 2 AS hit FROM {_REMOVALS})""",
    ),
    (
        "removal_cleanup",
        _after_removal,
        " UNION ALL ".join(f"SELECT '{t}' AS kept_in, id FROM {t} WHERE {'id' if t == 'libraries' else 'library_id'} {_LEFT}" for t in ("assets", "directories", "scan_runs", "libraries")),
    ),
    (
        "anti_no_active_removal",
        lambda c: c.libraries.join(_removals(c).filter(F.col("status").isin("queued", "running")).select(F.col("library_id").alias("id")), "id", "left_anti").select("id", "name"),
        f"SELECT id, name FROM libraries WHERE id NOT IN (SELECT library_id FROM {_REMOVALS} WHERE status IN ('queued', 'running'))",
    ),
    (
        "recover_expired_reconciles",
        lambda c: C.recovered_reconciles(_reconciling(c), NOW),
        f"""SELECT id, CASE WHEN attempts < 5 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts >= 5 THEN 'interrupted' END AS error_code,
        CASE WHEN attempts < 5 THEN {NOW} + 1000 * (1 << (attempts - 1)) END AS available_at_ms FROM {_JOBS} WHERE status = 'running' AND lease_expires_at_ms <= {NOW}""",
    ),
    (
        "commit_reconcile",
        lambda c: C.committed_reconciles(_reconciling(c), _changes(c), NOW),
        f"""SELECT key, library_id, coalesce(a, 0) AS added, coalesce(r, 0) AS removed, coalesce(x, 0) AS changed, CASE WHEN requested_revision <> claimed_revision THEN 'queued' ELSE 'done' END AS outcome,
        CASE WHEN requested_revision <> claimed_revision THEN {NOW} + 750 END AS available_at_ms, CASE WHEN coalesce(a + r + x, 0) > 0 THEN 1 ELSE 0 END AS content_increment
        FROM {_JOBS} j LEFT JOIN (SELECT directory_id, count(*) FILTER (change = 'new') AS a, count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'changed') AS x FROM {_CHANGES} GROUP BY 1) d ON d.directory_id = j.key
        WHERE status = 'running'""",
    ),
    (
        "reconciled_assets",
        lambda c: _reconciled(c).read("assets").select("id", "library_id", "directory_id", "relative_path", "source_fingerprint", "probe_status", "width", "last_seen_generation"),
        f"{_AFTER} SELECT id, library_id, directory_id, relative_path, source_fingerprint, probe_status, width, last_seen_generation FROM now",
    ),
    (
        "reconciled_counts",
        lambda c: _reconciled(c).read("counts"),
        f"""{_AFTER}, up(id, n) AS (SELECT directory_id, count(*) FROM now GROUP BY 1 UNION ALL SELECT d.parent_id, n FROM up JOIN directories d ON d.id = up.id WHERE d.parent_id IS NOT NULL)
        SELECT d.id, (SELECT count(*) FROM now WHERE directory_id = d.id) AS direct_count, CAST(coalesce((SELECT sum(n) FROM up WHERE up.id = d.id), 0) AS BIGINT) AS recursive_count FROM directories d""",
    ),
    (
        "reconciled_queue",
        _reconciled_queue,
        f"""SELECT 'job' AS kind, key AS id, status AS state, CAST(attempts AS BIGINT) AS n FROM {_JOBS} WHERE status <> 'running' UNION ALL SELECT 'job', key, 'queued', 0 FROM {_JOBS} WHERE status = 'running' AND requested_revision <> claimed_revision
        UNION ALL SELECT 'library', l.id, 'content_revision', (SELECT count(*) FROM {_JOBS} j WHERE j.library_id = l.id AND status = 'running' AND key IN (SELECT directory_id FROM {_CHANGES})) FROM libraries l""",
    ),
    (
        "requested_vs_claimed",
        lambda c: C.committed_reconciles(_reconciling(c), _changes(c), NOW).groupBy("library_id", "outcome").agg(F.count("*").alias("n"), F.sum("content_increment").alias("content_increments")),
        f"""SELECT library_id, CASE WHEN requested_revision <> claimed_revision THEN 'queued' ELSE 'done' END AS outcome, count(*) AS n, CAST(count(*) FILTER (key IN (SELECT directory_id FROM {_CHANGES})) AS BIGINT) AS content_increments
        FROM {_JOBS} WHERE status = 'running' GROUP BY 1, 2""",
    ),
    (
        "upsert_directory",
        lambda c: C.merged_directories(c.directories, _found(c), 3),
        f""", {_FOUND} SELECT o.id, o.library_id, p.id AS parent_id, o.relative_path, string_split(o.relative_path, '/')[-1] AS name, o.last_seen_generation
        FROM o LEFT JOIN o p ON p.library_id = o.library_id AND o.relative_path <> '' AND p.relative_path = regexp_replace(o.relative_path, '/?[^/]*$', '')""",
    ),
    (
        "rename_semantics",
        lambda c: C.paired(*I.unmatched(c.assets, c.listing)),
        f""", {_MERGE},
        gone AS (SELECT *, row_number() OVER (PARTITION BY library_id, directory_id, source_fingerprint ORDER BY relative_path) AS place FROM assets WHERE (library_id, relative_path) NOT IN (SELECT (library_id, relative_path) FROM listing)),
        came AS (SELECT *, row_number() OVER (PARTITION BY library_id, directory_id, source_fingerprint ORDER BY relative_path) AS place FROM merged WHERE id NOT IN (SELECT id FROM assets))
        SELECT o.library_id, o.id AS old_id, m.id AS new_id FROM gone o JOIN came m USING (library_id, directory_id, source_fingerprint, place)""",
    ),
    (
        "cache_cleanup",
        lambda c: C.cleanup_batches(c.thumbnails),
        """SELECT batch, count(*) AS rows, CAST(sum(byte_size) AS BIGINT) AS bytes, CAST(sum(sum(byte_size)) OVER (ORDER BY batch) AS BIGINT) AS bytes_so_far
        FROM (SELECT *, (row_number() OVER (ORDER BY last_accessed_at_ms, asset_id, variant) - 1) // 64 AS batch FROM thumbnails WHERE status = 'ready') GROUP BY 1""",
    ),
    (
        "cache_evict_rows",
        lambda c: C.evicted(_sized(c), _evictions(c)).select("asset_id", "variant", "status", "byte_size"),
        f"""SELECT asset_id, variant, status, byte_size FROM {_PATHED} WHERE (asset_id, variant) NOT IN (
          SELECT (asset_id, variant) FROM (SELECT * FROM thumbnails WHERE status = 'ready' ORDER BY last_accessed_at_ms, asset_id, variant LIMIT 4096) WHERE asset_id % 5 <> 0 AND asset_id % 7 <> 0)""",
    ),
    (
        "requeue_missing_file",
        lambda c: C.missing_files(_sized(c), c.media_jobs, _cache_listing(c)),
        f""", lost AS (SELECT asset_id, variant FROM {_PATHED} p WHERE status = 'ready' AND NOT EXISTS (SELECT 1 FROM (SELECT cache_path, byte_size - (asset_id % 31 = 0)::INT AS size FROM {_PATHED} WHERE status = 'ready' AND asset_id % 29 <> 0) f WHERE f.cache_path = p.cache_path AND f.size = p.byte_size))
        SELECT asset_id, variant, 'drop_row' AS action FROM lost UNION ALL SELECT j.asset_id, j.variant, 'requeue' FROM media_jobs j JOIN lost USING (asset_id, variant)""",
    ),
    (
        "join_session_user",
        _sessions,
        """SELECT e.id AS session_id, e.job_id AS user_id, c_name AS name FROM attempts e JOIN customer ON c_custkey + 1 = e.job_id
        WHERE e.id % 9 <> 0 AND e.id * 100 > 100000 AND c_custkey % 6 <> 0 AND e.id % 2 = c_custkey % 2""",
    ),
    (
        "join_update_from",
        _counted,
        """SELECT id, d AS direct_count, r AS recursive_count, id % 3 = 0 AND (d > 0 OR r > 0) AS moved
        FROM (SELECT d.id, (SELECT count(*) FROM assets a WHERE a.directory_id = d.id) AS d, (SELECT count(*) FROM assets a WHERE a.library_id = d.library_id AND (d.relative_path = '' OR starts_with(a.relative_path, d.relative_path || '/'))) AS r FROM directories d)""",
    ),
    (
        "key_backfill_scan",
        lambda c: C.empty_keys(c.directories.withColumn("search_name_key", F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, F.col("search_name_key"))), 2_000_005, 256),
        "SELECT id, lower(name) AS search_name_key FROM directories WHERE id > 2000005 AND id % 3 <> 1 ORDER BY id LIMIT 256",
    ),
    (
        "job_result_class",
        _results,
        f"""SELECT id, CASE WHEN p IS NULL THEN 'succeeded' ELSE coalesce(outcome, 'retry') END AS outcome, CASE WHEN p IS NULL THEN NULL WHEN outcome IS NULL THEN 'media_processing_failed' ELSE code END AS code,
        CASE WHEN p IS NOT NULL AND coalesce(outcome, 'retry') = 'retry' THEN 5000 END AS delay_ms
        FROM (SELECT id, CASE WHEN id % 14 <> 0 THEN {_CHOICE.format(_NAMES, f"id % {len(C.RESULTS) + 1} + 1")} END AS p FROM media_jobs) LEFT JOIN {_CLASSES} ON problem = p""",
    ),
]
