"""The catalogue's tables from the general test tables, as DataFrames and as SQL that states the same."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.functions import scalar as X
from shelfmark.sources.snapshots import Snapshots
from shelfmark.staging import shared_dir

_EXT = list(S.FORMATS)


#: Tables that are published, and what a file of each is ordered by.
PUBLISHED = {
    "libraries": ["id"], "directories": ["library_id", "relative_path"], "assets": ["library_id", "directory_path", "natural_name_key", "name", "id"],
    "thumbnails": ["last_accessed_at_ms", "asset_id", "variant"], "media_jobs": ["id"], "scan_runs": ["id"],
}
_IN_USE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def publish(spark: SparkSession, folder: str) -> Snapshots:
    """The folder's catalogue as stored, ordered tables, published as one generation."""
    store = Snapshots(spark, f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    c = Catalogue(spark, folder, {})
    store.publish({name: getattr(c, name) for name in PUBLISHED}, 0, sort=PUBLISHED)
    return store


def use(spark: SparkSession, folder: str, store: Snapshots) -> None:
    """From now on this session's queries on the folder read what the store has published."""
    _IN_USE[spark.sparkContext.applicationId, folder] = {name: store.read(name) for name in PUBLISHED}


class Catalogue:
    """Tables of a folder; each is a plan, read when it is used: what is published for the folder, or else derived."""

    def __init__(self, spark: SparkSession, folder: str, stored: dict[str, DataFrame] | None = None):
        self.spark, self.folder = spark, folder
        # cached properties give way to what is there already
        self.__dict__.update(_IN_USE.get((spark.sparkContext.applicationId, folder), {}) if stored is None else stored)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def libraries(self) -> DataFrame:
        r = self.table("region")
        return r.select(
            (F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("root_rel_path"),
            F.when(F.col("r_regionkey") == 4, "offline").otherwise("ready").alias("status"), F.lit(2).cast("long").alias("current_generation"),
        )

    @cached_property
    def directories(self) -> DataFrame:
        r, n, c = self.table("region"), self.table("nation"), self.table("customer")
        key = lambda base, x: (F.lit(base) + x).cast("long")
        root = r.select(key(1_000_000, F.col("r_regionkey")).alias("id"), (F.col("r_regionkey") + 1).cast("long").alias("library_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("").alias("relative_path"), F.lit("").alias("name"))
        nation = n.select(key(2_000_000, F.col("n_nationkey")).alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("library_id"), key(1_000_000, F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("relative_path"), F.col("n_name").alias("name"))
        leaf = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows at any scale
        leaf = leaf.select(key(10_000_000, F.col("c_custkey")).alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("library_id"), key(2_000_000, F.col("c_nationkey")).alias("parent_id"), F.concat_ws("/", "n_name", "c_name").alias("relative_path"), F.col("c_name").alias("name"))
        both = root.unionByName(nation).unionByName(leaf)
        return both.withColumns({"natural_name_key": X.natural_name_key(F.col("name")), "search_name_key": X.ascii_search_key(F.col("name")), "last_seen_generation": F.lit(2).cast("long")})

    @cached_property
    def assets(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        k = F.col("o_orderkey")
        place = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "n_regionkey")
        a = o.join(place, F.col("o_custkey") == F.col("c_custkey"))
        formats = F.array(*[F.struct(F.lit(e).alias("ext"), *[F.lit(v).alias(f) for f, v in zip(("kind", "format", "mime_type"), S.FORMATS[e], strict=True)]) for e in _EXT])
        a = a.withColumns({"f": F.element_at(formats, (k % len(_EXT) + 1).cast("int")), "probe_status": F.when(k % 13 == 0, "failed").when(k % 17 == 5, "pending").otherwise("ready")})
        a = a.withColumns({"name": F.concat(F.lit("asset "), k.cast("string"), F.lit("."), F.col("f.ext")), "size_bytes": F.round(F.col("o_totalprice") * 100).cast("long"), "mtime_ns": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) * 1000L")})
        ready = F.col("probe_status") == "ready"
        a = a.withColumn("relative_path", F.concat_ws("/", "n_name", "c_name", "name"))
        return a.select(
            (k + 1).alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("library_id"), (F.lit(10_000_000) + F.col("o_custkey")).cast("long").alias("directory_id"), "relative_path", "name",
            F.col("f.kind").alias("kind"), F.col("f.format").alias("format"), F.col("f.mime_type").alias("mime_type"), "size_bytes", "mtime_ns", X.source_fingerprint(F.col("size_bytes"), F.col("mtime_ns")).alias("source_fingerprint"),
            "probe_status", F.when(F.col("probe_status") == "failed", F.when(k % 2 == 0, "invalid_media").otherwise("media_processing_failed")).alias("probe_error_code"),
            F.when(ready, 640 + k % 1280).alias("width"), F.when(ready, 360 + k % 720).alias("height"), F.when(ready & (F.col("f.kind") == "video"), (k * 37) % 20000).alias("duration_ms"),
            F.when(k % 11 == 0, 1).otherwise(2).cast("long").alias("last_seen_generation"), X.ascii_search_key(F.col("name")).alias("search_name_key"), X.ascii_search_key(F.col("relative_path")).alias("search_path_key"),
            X.natural_name_key(F.col("name")).alias("natural_name_key"), X.directory_path(F.col("relative_path"), F.col("name")).alias("directory_path"),
        )

    @cached_property
    def thumbnails(self) -> DataFrame:
        a = self.assets.select("id", "library_id", "kind", "duration_ms", "source_fingerprint", "width", "height", "probe_status")
        k = F.col("id") - 1
        fields = lambda status: [
            F.col("id").alias("asset_id"), "library_id", status.alias("status"), F.when(status == "failed", F.when(k % 2 == 0, "media_processing_failed").otherwise("timeout")).alias("error_code"), F.when(status == "ready", 1000 + k % 5000).alias("byte_size"),
            ((k * 7919) % 1000003).alias("last_accessed_at_ms"), F.when(k % 19 == 1, "v1:0:0").otherwise(F.col("source_fingerprint")).alias("source_fingerprint"),
        ]
        grid = a.filter((k % 10 <= 7) & (F.col("probe_status") == "ready")).select(*fields(F.when(k % 10 < 7, "ready").otherwise("failed")), F.lit("grid").alias("variant"), F.lit(None).cast("int").alias("frame_count"))
        board = a.filter((F.col("kind") == "video") & (F.col("duration_ms") >= 2000) & (k % 3 == 0)).select(*fields(F.lit("ready")), F.lit("storyboard").alias("variant"), X.storyboard_frames(F.col("duration_ms")).alias("frame_count"))
        return grid.unionByName(board)

    @cached_property
    def media_jobs(self) -> DataFrame:
        a = self.assets.select("id", "library_id", "kind", "source_fingerprint")
        k = F.col("id") - 1
        status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "succeeded", "failed", "succeeded", "queued", "succeeded")]), (k % 7 + 1).cast("int"))
        common = lambda variant, key, priority: [
            key.cast("long").alias("id"), F.col("id").alias("asset_id"), "library_id", F.lit(variant).alias("variant"), F.lit(priority).alias("priority"), status.alias("status"), F.when(k % 13 == 0, 2).otherwise(1).alias("transform_version"),
            F.when(status == "queued", 0).otherwise(1 + k % 3).cast("int").alias("attempts"), (k * 1000).alias("available_at_ms"), F.when(status == "running", k * 1000 + 120_000).alias("lease_expires_at_ms"),
            F.when(status.isin("failed", "succeeded"), k * 1000 + 7).alias("finished_at_ms"), F.when(status == "failed", "timeout").alias("error_code"), F.when(k % 23 == 1, "v1:0:0").otherwise(F.col("source_fingerprint")).alias("source_fingerprint"),
        ]
        grid = a.select(*common("grid", k * 2 + 1, 0))
        board = a.filter((F.col("kind") == "video") & (k % 4 == 1)).select(*common("storyboard", k * 2 + 2, 100))
        return grid.unionByName(board)

    @cached_property
    def attempts(self) -> DataFrame:
        e = self.table("events")
        return e.select((F.col("event_id") + 1).alias("id"), (F.col("user_id") + 1).alias("job_id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "retry").otherwise("succeeded").alias("outcome"), (F.col("event_id") % 1000).alias("duration_ms"))

    @cached_property
    def system_events(self) -> DataFrame:
        e = self.table("events")
        return e.select((F.col("event_id") + 1).alias("id"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info").alias("level"), F.col("event_type").alias("module"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("created_at_ms"))

    @cached_property
    def scan_runs(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        k = F.col("s_suppkey")
        status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "succeeded", "failed", "cancelled", "interrupted", "succeeded")]), (k % 7 + 1).cast("int"))
        return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
            (k + 1).alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("library_id"), status.alias("status"), (k * 60000).alias("created_at_ms"), F.when(~status.isin("queued", "running"), k * 60000 + 5000).alias("finished_at_ms"),
            (k % 3 + 1).cast("int").alias("attempts"), F.when(status == "running", k * 60000 + 120_000).alias("lease_expires_at_ms"), (k % 2 == 0).alias("cancel_requested"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """What the next walk of all libraries finds: some assets gone, some changed, some new."""
        a, k = self.assets, F.col("id") - 1
        size = F.when(k % 19 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
        old = a.filter(k % 17 != 0).select("library_id", "directory_id", "relative_path", "name", "kind", "format", "mime_type", size.alias("size_bytes"), "mtime_ns")
        new = a.filter(k % 23 == 0).select("library_id", "directory_id", F.concat("directory_path", F.lit("/new "), "name").alias("relative_path"), F.concat(F.lit("new "), "name").alias("name"), "kind", "format", "mime_type", "size_bytes", "mtime_ns")
        both = old.unionByName(new)
        return both.withColumn("source_fingerprint", X.source_fingerprint(F.col("size_bytes"), F.col("mtime_ns")))


def _natural(x: str) -> str:
    return f"""list_aggregate(list_transform(regexp_extract_all(lower({x}), '[0-9]+|[^0-9]+'), lambda run: CASE WHEN regexp_matches(run, '^[0-9]') THEN '0' || lpad(CAST(length(regexp_replace(run, '^0+(.)', '\\1')) AS VARCHAR), 4, '0') || regexp_replace(run, '^0+(.)', '\\1') ELSE run END), 'string_agg', '')"""


#: The same tables in SQL; queries follow it.
PRELUDE = f"""
WITH RECURSIVE fmt(i, ext, kind, format, mime_type) AS (VALUES {", ".join(f"({i}, '{e}', '{k}', '{f}', '{m}')" for i, (e, (k, f, m)) in enumerate(S.FORMATS.items()))}),
libraries AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name, lower(r_name) AS root_rel_path, CASE WHEN r_regionkey = 4 THEN 'offline' ELSE 'ready' END AS status, CAST(2 AS BIGINT) AS current_generation FROM region),
dirs0 AS (
  SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, CAST(r_regionkey + 1 AS BIGINT) AS library_id, CAST(NULL AS BIGINT) AS parent_id, '' AS relative_path, '' AS name FROM region
  UNION ALL SELECT 2000000 + n_nationkey, n_regionkey + 1, 1000000 + n_regionkey, n_name, n_name FROM nation
  UNION ALL SELECT 10000000 + c_custkey, n_regionkey + 1, 2000000 + c_nationkey, n_name || '/' || c_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
directories AS (SELECT *, coalesce({_natural("name")}, '') AS natural_name_key, lower(name) AS search_name_key, CAST(2 AS BIGINT) AS last_seen_generation FROM dirs0),
assets0 AS (
  SELECT o_orderkey AS k, o_orderkey + 1 AS id, CAST(n_regionkey + 1 AS BIGINT) AS library_id, 10000000 + o_custkey AS directory_id, n_name || '/' || c_name AS directory_path, 'asset ' || o_orderkey || '.' || ext AS name, kind, format, mime_type,
    CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, epoch_us(o_orderdate) * 1000 AS mtime_ns,
    CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 17 = 5 THEN 'pending' ELSE 'ready' END AS probe_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN fmt ON i = o_orderkey % 9),
assets AS (
  SELECT id, library_id, directory_id, directory_path || '/' || name AS relative_path, name, kind, format, mime_type, size_bytes, mtime_ns, 'v1:' || size_bytes || ':' || mtime_ns AS source_fingerprint, probe_status,
    CASE WHEN probe_status = 'failed' THEN CASE WHEN k % 2 = 0 THEN 'invalid_media' ELSE 'media_processing_failed' END END AS probe_error_code,
    CASE WHEN probe_status = 'ready' THEN 640 + k % 1280 END AS width, CASE WHEN probe_status = 'ready' THEN 360 + k % 720 END AS height, CASE WHEN probe_status = 'ready' AND kind = 'video' THEN (k * 37) % 20000 END AS duration_ms,
    CAST(CASE WHEN k % 11 = 0 THEN 1 ELSE 2 END AS BIGINT) AS last_seen_generation, lower(name) AS search_name_key, lower(directory_path || '/' || name) AS search_path_key, {_natural("name")} AS natural_name_key, directory_path
  FROM assets0),
thumbnails0 AS (
  SELECT id AS asset_id, id - 1 AS k, library_id, CASE WHEN (id - 1) % 10 < 7 THEN 'ready' ELSE 'failed' END AS status, 'grid' AS variant, CAST(NULL AS INT) AS frame_count, source_fingerprint AS fp FROM assets WHERE (id - 1) % 10 <= 7 AND probe_status = 'ready'
  UNION ALL SELECT id, id - 1, library_id, 'ready', 'storyboard', CASE WHEN duration_ms < 5000 THEN 4 ELSE 10 END, source_fingerprint FROM assets WHERE kind = 'video' AND duration_ms >= 2000 AND (id - 1) % 3 = 0),
thumbnails AS (SELECT asset_id, library_id, status, CASE WHEN status = 'failed' THEN CASE WHEN k % 2 = 0 THEN 'media_processing_failed' ELSE 'timeout' END END AS error_code, CASE WHEN status = 'ready' THEN 1000 + k % 5000 END AS byte_size, (k * 7919) % 1000003 AS last_accessed_at_ms, CASE WHEN k % 19 = 1 THEN 'v1:0:0' ELSE fp END AS source_fingerprint, variant, frame_count FROM thumbnails0),
jobs0 AS (
  SELECT (id - 1) * 2 + 1 AS id, id AS asset_id, id - 1 AS k, library_id, 'grid' AS variant, 0 AS priority, source_fingerprint AS fp FROM assets
  UNION ALL SELECT (id - 1) * 2 + 2, id, id - 1, library_id, 'storyboard', 100, source_fingerprint FROM assets WHERE kind = 'video' AND (id - 1) % 4 = 1),
jobs1 AS (SELECT *, list_extract(['queued', 'running', 'succeeded', 'failed', 'succeeded', 'queued', 'succeeded'], CAST(k % 7 + 1 AS INT)) AS status FROM jobs0),
media_jobs AS (SELECT id, asset_id, library_id, variant, priority, status, CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END AS transform_version, CAST(CASE WHEN status = 'queued' THEN 0 ELSE 1 + k % 3 END AS INT) AS attempts, k * 1000 AS available_at_ms, CASE WHEN status = 'running' THEN k * 1000 + 120000 END AS lease_expires_at_ms,
  CASE WHEN status IN ('failed', 'succeeded') THEN k * 1000 + 7 END AS finished_at_ms, CASE WHEN status = 'failed' THEN 'timeout' END AS error_code, CASE WHEN k % 23 = 1 THEN 'v1:0:0' ELSE fp END AS source_fingerprint FROM jobs1),
attempts AS (SELECT event_id + 1 AS id, user_id + 1 AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'retry' ELSE 'succeeded' END AS outcome, event_id % 1000 AS duration_ms FROM events),
system_events AS (SELECT event_id + 1 AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS level, event_type AS module, epoch_us(ts) // 1000 AS created_at_ms FROM events),
runs0 AS (SELECT s_suppkey AS k, CAST(n_regionkey + 1 AS BIGINT) AS library_id, list_extract(['queued', 'running', 'succeeded', 'failed', 'cancelled', 'interrupted', 'succeeded'], CAST(s_suppkey % 7 + 1 AS INT)) AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey),
scan_runs AS (SELECT k + 1 AS id, library_id, status, k * 60000 AS created_at_ms, CASE WHEN status NOT IN ('queued', 'running') THEN k * 60000 + 5000 END AS finished_at_ms, CAST(k % 3 + 1 AS INT) AS attempts, CASE WHEN status = 'running' THEN k * 60000 + 120000 END AS lease_expires_at_ms, k % 2 = 0 AS cancel_requested FROM runs0),
listing AS (
  SELECT library_id, directory_id, relative_path, name, kind, format, mime_type, CASE WHEN (id - 1) % 19 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_ns, 'v1:' || CASE WHEN (id - 1) % 19 = 0 THEN size_bytes + 1 ELSE size_bytes END || ':' || mtime_ns AS source_fingerprint FROM assets WHERE (id - 1) % 17 <> 0
  UNION ALL SELECT library_id, directory_id, directory_path || '/new ' || name, 'new ' || name, kind, format, mime_type, size_bytes, mtime_ns, source_fingerprint FROM assets WHERE (id - 1) % 23 = 0)
"""
