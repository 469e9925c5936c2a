"""Queries on scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.functions import scalar as X

_FOLD = "replace(lower(nfc_normalize({0})), 'ß', 'ss')"
_DIR = "CASE WHEN length(relative_path) = length(name) THEN '' ELSE substr(relative_path, 1, length(relative_path) - length(name) - 1) END"
_EXT = "lower(regexp_extract(relative_path, '\\.([^./]*)$', 1))"



_CODES = ", ".join(f"'{x}'" for x in S.SCAN_ERRORS)
_NAMED = "(SELECT id, CASE id % 9 WHEN 0 THEN '  ' || name || ' ' WHEN 1 THEN chr(160) || name || chr(12288) WHEN 2 THEN repeat(name, 20) WHEN 3 THEN name || chr(7) WHEN 4 THEN '   ' WHEN 5 THEN 'Cafe' || chr(769) || ' ' || id WHEN 6 THEN 'Straße ' || id WHEN 7 THEN name || ' ｆ' ELSE name END AS name FROM assets)"


def _coded(c):
    code = F.element_at(F.array(*[F.lit(x) for x in (*S.SCAN_ERRORS, "view", "", None)]), (F.col("id") % (len(S.SCAN_ERRORS) + 3) + 1).cast("int"))
    return c.system_events.select("id", code.alias("code"))


def _named(c):
    """Names to be checked, in many ways: spaces around, too long, controls, none, marks to be composed, letters to be folded."""
    k, name = F.col("id"), F.col("name")
    kinds = [F.concat(F.lit("  "), name, F.lit(" ")), F.concat(F.lit("\xa0"), name, F.lit("\u3000")), F.repeat(name, 20), F.concat(name, F.lit("\x07")), F.lit("   "), F.concat(F.lit("Cafe\u0301 "), k.cast("string")), F.concat(F.lit("Straße "), k.cast("string")), F.concat(name, F.lit(" ｆ")), name]
    return c.assets.select("id", F.element_at(F.array(*kinds), (k % 9 + 1).cast("int")).alias("name"))


ENTRIES = [
    ("search_text_key", lambda c: c.table("documents").select("doc_id", X.search_text_key(F.col("text")).alias("key")), f"SELECT doc_id, {_FOLD.format('text')} AS key FROM documents"),
    ("search_text_key_urls", lambda c: c.table("pages").select("page_id", X.search_text_key(F.col("url")).alias("key")), f"SELECT page_id, {_FOLD.format('url')} AS key FROM pages"),
    ("natural_name_key", lambda c: c.assets.select("id", "natural_name_key"), "SELECT id, natural_name_key FROM assets"),
    (
        "contains_literal",
        lambda c: c.table("pages").filter(F.col("url").contains("_") | F.col("url").contains("%")).select("page_id"),
        "SELECT page_id FROM pages WHERE contains(url, '_') OR contains(url, '%')",
    ),
    ("directory_path", lambda c: c.assets.select("id", X.directory_path(F.col("relative_path"), F.col("name")).alias("path")), f"SELECT id, {_DIR} AS path FROM assets"),
    (
        "basename_parent_path",
        lambda c: c.directories.select("id", X.basename(F.col("relative_path")).alias("base"), X.parent_path(F.col("relative_path")).alias("parent")),
        "SELECT id, string_split(relative_path, '/')[-1] AS base, regexp_replace(relative_path, '/?[^/]*$', '') AS parent FROM directories",
    ),
    (
        "path_ancestors",
        lambda c: c.directories.select("id", F.explode(X.path_ancestors(F.col("relative_path"))).alias("path")),
        "SELECT id, unnest(CASE WHEN relative_path = '' THEN [''] ELSE list_concat([''], list_transform(range(1, len(string_split(relative_path, '/')) + 1), lambda i: "
        "array_to_string(string_split(relative_path, '/')[1:i], '/'))) END) AS path FROM directories",
    ),
    (
        "classify_path",
        lambda c: c.assets.withColumn("c", X.classify_path(F.upper("relative_path"))).select("id", "c.kind", "c.format", "c.mime"),
        f"SELECT a.id, f.kind, f.format, f.mime_type AS mime FROM assets a LEFT JOIN fmt f ON f.ext = {_EXT}",
    ),
    (
        "is_system_directory",
        lambda c: c.directories.select("id", X.is_system_directory(F.when(F.col("id") % 3 == 0, "@eaDir").otherwise(F.col("name"))).alias("system")),
        "SELECT id, id % 3 = 0 AS system FROM directories",
    ),
    (
        "normalize_path",
        lambda c: c.assets.select("id", X.is_valid_path(F.concat("relative_path", F.when(F.col("id") % 5 == 0, F.lit("/%252e%252e")).otherwise(F.lit("")))).alias("valid")),
        "SELECT id, id % 5 <> 0 AS valid FROM assets",
    ),
    (
        "normalize_path_plain",
        lambda c: c.assets.select("id", X.is_valid_plain_path(F.concat("relative_path", F.when(F.col("id") % 5 == 0, F.lit("/..")).otherwise(F.lit("")))).alias("valid")),
        "SELECT id, id % 5 <> 0 AS valid FROM assets",
    ),
    (
        "source_fingerprint",
        lambda c: c.assets.select("id", X.source_fingerprint(F.col("size_bytes"), F.col("mtime_ns")).alias("fp"), X.fingerprint_valid(F.col("source_fingerprint")).alias("valid")),
        "SELECT id, 'v1:' || size_bytes || ':' || mtime_ns AS fp, true AS valid FROM assets",
    ),
    (
        "cache_relative_path",
        lambda c: c.assets.select("id", X.cache_relative_path(F.col("library_id"), F.col("id"), F.lit("grid"), F.col("source_fingerprint"), F.lit(1)).alias("path")),
        "SELECT id, 'libraries/lib_' || library_id || '/' || substr(h, 1, 2) || '/' || h || '.webp' AS path FROM (SELECT id, library_id, sha256(id || chr(0) || 'grid' || chr(0) "
        "|| source_fingerprint || chr(0) || '1') AS h FROM assets)",
    ),
    (
        "content_etag",
        lambda c: c.assets.select("id", X.content_etag(F.col("id"), F.col("source_fingerprint")).alias("etag")),
        "SELECT id, '\"' || rtrim(translate(to_base64(unhex(sha256('content-v1' || chr(0) || id || chr(0) || source_fingerprint))), '+/', '-_'), '=') || '\"' AS etag FROM assets",
    ),
    (
        "storyboard_plan",
        lambda c: c.assets.filter("duration_ms >= 2000").select("id", F.posexplode(X.storyboard_times(F.col("duration_ms"))).alias("frame", "at_ms")),
        "SELECT id, i - 1 AS frame, (duration_ms // d) * i + ((duration_ms % d) * i) // d AS at_ms FROM (SELECT id, duration_ms, CASE WHEN duration_ms < 5000 THEN 5 ELSE 11 END "
        "AS d FROM assets WHERE duration_ms >= 2000), range(1, 11) r(i) WHERE i < d",
    ),
    (
        "storyboard_cell",
        lambda c: c.assets.filter("width is not null").withColumn("c", X.storyboard_cell(F.col("width"), F.col("height"))).select("id", "c.width", "c.height"),
        "SELECT id, CAST(greatest(1, floor(width * s + 0.5)) AS BIGINT) AS width, CAST(greatest(1, floor(height * s + 0.5)) AS BIGINT) AS height FROM (SELECT id, width, height, "
        "least(CAST(320 AS DOUBLE) / width, CAST(320 AS DOUBLE) / height, CAST(1 AS DOUBLE)) AS s FROM assets WHERE width IS NOT NULL)",
    ),
    (
        "storyboard_timeout",
        lambda c: c.assets.filter("duration_ms >= 2000").select("id", (F.least(F.greatest(F.lit(1), F.ceil(F.col("width") * F.col("height") * X.storyboard_frames(F.col("duration_ms")) / F.lit(20736000))), F.lit(10)) * 30).cast("long").alias("seconds")),
        "SELECT id, CAST(least(greatest(1, ceil(width * height * CASE WHEN duration_ms < 5000 THEN 4 ELSE 10 END / 20736000)), 10) * 30 AS BIGINT) AS seconds FROM assets WHERE duration_ms >= 2000",
    ),
    (
        "validate_size_dimensions",
        lambda c: c.assets.select("id", X.valid_size(F.col("kind"), F.col("size_bytes") * 10).alias("size_ok"), F.coalesce(X.valid_dimensions(F.col("width") * 20, F.col("height") * 20), F.lit(False)).alias("dimensions_ok")),
        f"SELECT id, size_bytes * 10 >= 0 AND size_bytes * 10 <= CASE WHEN kind = 'video' THEN {S.MAX_VIDEO_BYTES} ELSE {S.MAX_IMAGE_BYTES} END AS size_ok, coalesce(width * 20 "
        "BETWEEN 1 AND 32768 AND height * 20 BETWEEN 1 AND 32768 AND width * height * 400 <= 100000000, false) AS dimensions_ok FROM assets",
    ),
    (
        "thumb_etag",
        lambda c: c.assets.select("id", X.thumb_etag(F.col("source_fingerprint"), F.col("relative_path")).alias("etag")),
        "SELECT id, '\"thumb-' || substr(sha256(source_fingerprint || chr(0) || relative_path), 1, 32) || '\"' AS etag FROM assets",
    ),
    (
        "validate_metadata",
        lambda c: c.assets.select("id", X.valid_metadata(F.col("kind"), F.col("width"), F.col("height"), F.col("duration_ms"), F.when(F.col("id") % 5 == 0, "not_applicable").when(F.col("id") % 5 == 1, "playable").when(F.col("id") % 5 == 2, "unknown")).alias("valid")),
        "SELECT id, coalesce(width BETWEEN 1 AND 32768 AND height BETWEEN 1 AND 32768 AND width * height <= 100000000 AND ((kind <> 'video' AND duration_ms IS NULL AND id % 5 = "
        "0) OR (kind = 'video' AND coalesce(duration_ms, 0) >= 0 AND id % 5 IN (1, 2))), false) AS valid FROM assets",
    ),
    (
        "parse_utc_instant",
        lambda c: c.assets.select("id", X.utc_instant_ns(F.concat(F.date_format(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("id") % 2 == 0, ".5").otherwise(""), F.when(F.col("id") % 3 == 0, "+02:00").otherwise("Z"))).alias("ns")),
        "SELECT id, CASE WHEN id % 3 <> 0 THEN mtime_ns // 1000000000 * 1000000000 + CASE WHEN id % 2 = 0 THEN 500000000 ELSE 0 END END AS ns FROM assets",
    ),
    (
        "error_code_normalise",
        lambda c: _coded(c).select("id", X.error_code(F.col("code"), S.SCAN_ERRORS).alias("code")),
        f"SELECT id, CASE WHEN code IN ({_CODES}) THEN code ELSE 'internal_error' END AS code FROM (SELECT id, list_extract([{_CODES}, 'view', '', NULL], CAST(id % "
        f"{len(S.SCAN_ERRORS) + 3} + 1 AS INT)) AS code FROM system_events)",
    ),
    (
        "library_name_key",
        lambda c: _named(c).select("id", X.library_name(F.col("name")).alias("n")).select("id", "n.display", "n.key"),
        "SELECT id, CASE WHEN good THEN shown END AS display, CASE WHEN good THEN key END AS key FROM (SELECT *, shown <> '' AND length(shown) <= 128 AND NOT "
        "regexp_matches(shown, '[\\x00-\\x1f\\x7f]') AS good FROM (SELECT id, shown, replace(replace(lower(shown), 'ß', 'ss'), 'ｆ', 'f') AS key FROM (SELECT id, "
        f"nfc_normalize(regexp_replace(name, '^[ \\t\\x{{00A0}}\\x{{3000}}]+|[ \\t\\x{{00A0}}\\x{{3000}}]+$', '', 'g')) AS shown FROM {_NAMED})))",
    ),
    (
        "coalesce_nullif",
        lambda c: c.system_events.agg(F.sum(F.when(F.nullif(F.col("module"), F.lit("view")).isNull(), 1).otherwise(0)).alias("views"), F.min("id").alias("lo"), F.max("id").alias("hi")),
        "SELECT CAST(sum(CASE WHEN nullif(module, 'view') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS views, min(id) AS lo, max(id) AS hi FROM system_events",
    ),
    (
        "resource_id",
        lambda c: c.assets.select("id", X.resource_id("ast", F.col("id")).alias("rid")).withColumn("back", X.parse_resource_id("ast", F.col("rid"))).withColumn("other", X.parse_resource_id("lib", F.col("rid"))),
        "SELECT id, 'ast_' || id AS rid, id AS back, CAST(NULL AS BIGINT) AS other FROM assets",
    ),
    (
        "semver_newer",
        lambda c: c.scan_runs.select("id", X.semver_newer(F.lit("v1.10.2"), F.concat(F.lit("1."), (F.col("id") % 20).cast("string"), F.lit(".3"))).alias("newer")),
        "SELECT id, id % 20 >= 10 AS newer FROM scan_runs",
    ),
    (
        "byte_range",
        lambda c: c.assets.withColumn("r", X.byte_range(F.concat(F.lit("bytes="), (F.col("id") % 100).cast("string"), F.lit("-"), F.when(F.col("id") % 2 == 0, "500").otherwise("")), F.lit(400))).select("id", "r.start", "r.end"),
        'SELECT id, id % 100 AS start, 399 AS "end" FROM assets',
    ),
    (
        "display_instant",
        lambda c: c.assets.select("id", F.date_format(F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)), "yyyy-MM-dd HH:mm:ss").alias("at")),
        "SELECT id, strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d %H:%M:%S') AS at FROM assets",
    ),
]
