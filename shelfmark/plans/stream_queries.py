"""The batch twins of the streaming operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.streaming import debounce as D
from shelfmark.streaming import fallback as W
from shelfmark.streaming import top as N

QUIET, CAP = 3_600_000, 4 * 3_600_000
_RAW = "SELECT id % 3 + 1 AS library_id, 'd' || id % 7 AS directory, CAST(id AS STRING) AS name, element_at(array('create', 'close_write', 'delete', 'overflow', 'unmounted'), CAST(id % 5 + 1 AS INT)) AS event, id % 2 = 0 AS is_directory FROM {events}"


def _changes(c):
    return c.system_events.select((F.col("id") % 40).cast("string").alias("key"), F.col("created_at_ms").alias("at_ms"))


def _raw(c):
    return c.spark.sql(_RAW, events=c.system_events.select("id"))


_STEPS = f"""
, e AS (SELECT id % 40 AS key, created_at_ms AS t, row_number() OVER (PARTITION BY id % 40 ORDER BY created_at_ms) AS r FROM system_events),
f AS (
  SELECT key, r, t AS created, least(t + {QUIET}, t + {CAP}) AS available, 1 AS n FROM e WHERE r = 1
  UNION ALL
  SELECT e.key, e.r, CASE WHEN e.t > f.available THEN e.t ELSE f.created END, CASE WHEN e.t > f.available THEN e.t + {min(QUIET, CAP)} ELSE least(e.t + {QUIET}, f.created + {CAP}) END, CASE WHEN e.t > f.available THEN 1 ELSE f.n + 1 END
  FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1
)
SELECT CAST(key AS VARCHAR) AS key, created AS created_ms, max(available) AS available_ms, CAST(max(n) AS BIGINT) AS events FROM f GROUP BY 1, 2
"""

def _watched(c):
    """What a watch of three libraries says, and the generations that their scans publish."""
    k = F.col("id")
    kind = F.when(k % 61 == 0, "published").when(k % 97 == 0, "overflow").when(k % 89 == 0, "invalidated").otherwise("dirty")
    return c.system_events.select((k % 3 + 1).alias("library_id"), k.alias("seq"), kind.alias("kind"), F.concat(F.lit("d"), (k % 7).cast("string")).alias("directory"), F.when(k % 61 == 0, F.floor(k / 400)).alias("generation"))


_WATCHED = "(SELECT id % 3 + 1 AS library_id, id AS seq, CASE WHEN id % 61 = 0 THEN 'published' WHEN id % 97 = 0 THEN 'overflow' WHEN id % 89 = 0 THEN 'invalidated' ELSE 'dirty' END AS kind, 'd' || id % 7 AS directory, CASE WHEN id % 61 = 0 THEN id // 400 END AS generation FROM system_events)"
#: One event after the other: the generation, and the fence that a sign of lost track sets.
_STEP = """
turns AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY seq) AS r FROM {0}),
told AS (
  SELECT library_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS now, CAST(-1 AS BIGINT) AS fence, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS directory, CAST(NULL AS VARCHAR) AS code FROM turns WHERE r = 1
  UNION ALL SELECT e.library_id, e.r, CASE WHEN e.kind = 'published' THEN greatest(t.now, e.generation) ELSE t.now END, CASE WHEN e.kind IN ('overflow', 'invalidated') AND t.now >= 1 AND t.now > t.fence THEN t.now ELSE t.fence END, e.seq,
    CASE WHEN e.kind = 'published' OR t.now < 1 OR t.now <= t.fence THEN NULL WHEN e.kind = 'dirty' THEN 'reconcile' ELSE 'full_scan' END, CASE WHEN e.kind = 'dirty' THEN e.directory END, CASE e.kind WHEN 'overflow' THEN 'watch_overflow' WHEN 'invalidated' THEN 'source_unavailable' END
  FROM told t JOIN turns e ON e.library_id = t.library_id AND e.r = t.r + 1)"""
_FALLBACK = f", {_STEP.format(_WATCHED)} SELECT library_id, seq, action, directory, code FROM told WHERE action IS NOT NULL"
_EACH = f"(SELECT library_id, seq, kind, directory, generation FROM {_WATCHED} WHERE kind <> 'overflow' UNION ALL SELECT l.id, w.seq, w.kind, w.directory, w.generation FROM {_WATCHED} w, libraries l WHERE w.kind = 'overflow')"
_FALLBACK_OF_ALL = f", {_STEP.format(_EACH)} SELECT library_id, action, code, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM told WHERE action IS NOT NULL GROUP BY ALL"

ENTRIES = [
    ("debounce", lambda c: D.bursts(_changes(c), QUIET, CAP), _STEPS),
    (
        "watch_source",
        lambda c: D.watch_actions(_raw(c)),
        ", w AS (SELECT id % 3 + 1 AS library_id, 'd' || id % 7 AS d, id % 5 AS e, id % 2 = 0 AS is_directory FROM system_events) SELECT library_id, CASE WHEN e IN (3, 4) THEN '' "
        "ELSE d END AS directory, CASE e WHEN 3 THEN 'overflow' WHEN 4 THEN 'invalidated' ELSE 'dirty' END AS kind FROM w WHERE e <> 0 OR is_directory",
    ),
    ("overflow_fallback", lambda c: W.actions(_watched(c)), _FALLBACK),
    (
        "overflow_of_all",
        lambda c: W.actions(W.of_all(_watched(c).withColumn("library_id", F.when(F.col("kind") != "overflow", F.col("library_id"))), c.libraries)).groupBy("library_id", "action", "code").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")),
        _FALLBACK_OF_ALL,
    ),
    (
        "top_per_key",
        lambda c: N.top(c.system_events.select(F.col("module").alias("key"), (F.col("id") * 7919 % 10_007).alias("score"), "id"), 20),
        "SELECT module AS key, r AS rank, score, id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, id) AS r FROM (SELECT module, id * 7919 % 10007 AS "
        "score, id FROM system_events)) WHERE r <= 20",
    ),
    (
        "event_windows",
        lambda c: D.event_windows(c.table("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n"),
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
]
