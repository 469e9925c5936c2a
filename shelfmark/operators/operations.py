"""Operational analytics: library details, scan history, failures, attempts, events, cache use and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as S


def library_details(libraries: DataFrame, runs: DataFrame, assets: DataFrame, directories: DataFrame) -> DataFrame:
    """Per library its last success, latest scan and sizes; each aggregated before it is joined."""
    success = runs.filter("status = 'succeeded'").groupBy("library_id").agg(F.max("finished_at_ms").alias("last_success_ms"))
    latest = runs.groupBy("library_id").agg(F.max_by("id", F.struct("created_at_ms", "id")).alias("latest_scan_id"))
    n = lambda df, name: df.groupBy("library_id").agg(F.count("*").alias(name))
    out = libraries.select(F.col("id").alias("library_id"), "name", "status")
    for part in (success, latest, n(assets, "asset_count"), n(directories, "directory_count")):
        out = out.join(part, "library_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("asset_count", "directory_count")})


def due_libraries(libraries: DataFrame, runs: DataFrame, cutoff_ms: int) -> DataFrame:
    """Libraries without an active scan whose latest scan was created at or before the cutoff."""
    last = runs.groupBy("library_id").agg(F.max("created_at_ms").alias("last_ms"), F.bool_or(F.col("status").isin("queued", "running")).alias("active"))
    out = libraries.select(F.col("id").alias("library_id")).join(last, "library_id", "left")
    return out.filter((F.coalesce("last_ms", F.lit(0)) <= cutoff_ms) & ~F.coalesce("active", F.lit(False))).select("library_id")


def failures(jobs: DataFrame, attempts: DataFrame, before: int | None = None, limit: int | None = S.DEFAULT_LIMIT, **equal: str) -> DataFrame:
    """Failed jobs with their latest attempt; only the filters that are given are applied. The newest `limit` and one more, or all if it is None."""
    out = jobs.filter("status = 'failed'")
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    if before is not None:
        out = out.filter(F.col("id") < before)
    if limit is not None:
        out = out.orderBy(F.desc("id")).limit(limit + 1)
    latest = attempts.groupBy("job_id").agg(F.max_by(F.struct("outcome", "duration_ms"), "id").alias("a"), F.max("id").alias("attempt_id"))
    return out.join(latest, F.col("id") == F.col("job_id"), "left").select("id", "asset_id", "variant", "error_code", "attempt_id", F.col("a.outcome").alias("outcome"), F.col("a.duration_ms").alias("duration_ms"))


def newest(rows: DataFrame, by: str, keep: int) -> DataFrame:
    """The newest rows of each key; Spark limits each task's rows per key before it shuffles."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("id")))).filter(F.col("r") <= keep)


def cache_usage(thumbnails: DataFrame) -> DataFrame:
    return thumbnails.filter("status = 'ready'").agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("used_bytes"))


def cache_summary(thumbnails: DataFrame, caches: DataFrame) -> DataFrame:
    """caches(quota_bytes, available_bytes, ...) with what is used, the marks, and what is short: quota above the high mark, storage below the reserve, or both. caches has a row for each cache, or each setting that is asked about."""
    used = cache_usage(thumbnails).withColumnRenamed("used_bytes", "usage_bytes")
    high, low = (F.floor(F.col("quota_bytes") * m / 100).cast("long") for m in (S.HIGH_WATER, S.LOW_WATER))
    quota, storage = F.col("usage_bytes") > high, F.col("available_bytes") < S.SAFE_FREE_BYTES
    pressure = F.when(quota & storage, "quota_and_storage").when(quota, "quota").when(storage, "storage").otherwise("normal")
    return caches.crossJoin(F.broadcast(used)).withColumns({"high_watermark_bytes": high, "low_watermark_bytes": low, "safe_free_space_bytes": F.lit(S.SAFE_FREE_BYTES), "pressure": pressure})  # one row


def _place(marks: list[int], value: Column) -> Column:
    """How many of the ascending marks are at most the value, by halving."""
    if not marks:
        return F.lit(0)
    bounds = F.array(*[F.lit(m).cast("long") for m in marks])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(marks).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at))


def eviction(thumbnails: DataFrame, target: int, spans: int = 256) -> DataFrame:
    """The least recently used ready rows whose removal brings the cache to its target, in order of access, asset and variant.

    The running sum is taken in two levels over spans of access time, so that no task orders the whole cache. Accesses
    crowd at the recent end, so the spans are bounded by quantiles: a row of `spans` numbers, fetched once so that both
    levels have the same. Where they lie doesn't change the result. Rows without a time of access are not evicted.
    """
    ready = thumbnails.filter("status = 'ready'").select("asset_id", "variant", "last_accessed_at_ms", "byte_size")
    used = ready.agg(F.sum("byte_size").alias("used"))
    marks = ready.agg(F.percentile_approx("last_accessed_at_ms", [i / spans for i in range(1, spans)], 16 * spans)).first()[0] or []
    laid = ready.filter("last_accessed_at_ms is not null").join(F.broadcast(used)).withColumn("span", _place(sorted(set(marks)), F.col("last_accessed_at_ms")))
    before = laid.groupBy("span").agg(F.sum("byte_size").alias("b")).withColumn("offset", F.coalesce(F.sum("b").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("span", "offset")
    inside = Window.partitionBy("span").orderBy("last_accessed_at_ms", "asset_id", "variant").rowsBetween(Window.unboundedPreceding, -1)
    freed = laid.join(before, "span").withColumn("freed", F.col("offset") + F.coalesce(F.sum("byte_size").over(inside), F.lit(0)))
    return freed.filter(F.col("freed") < F.col("used") - target).select("asset_id", "variant", "byte_size")


def least_recent(thumbnails: DataFrame, limit: int) -> DataFrame:
    return thumbnails.filter("status = 'ready'").orderBy("last_accessed_at_ms", "asset_id", "variant").limit(limit)


def retained(events: DataFrame, keep: int) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(keep)


def appended(events: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """The log after new rows; empty modules are null."""
    return retained(events.unionByName(new.withColumn("module", F.nullif("module", F.lit("")))), keep)


def nearest_rank(rows: DataFrame, value: str, percent: int) -> DataFrame:
    """The value at place ceil(n * percent / 100)."""
    return rows.agg(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})").alias("value"))
