"""Queries on browsing, searching, states and trees, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from shelfmark.functions import scalar as X
from shelfmark.operators import browse as B
from shelfmark.operators import forest as P
from shelfmark.operators import ingest as I
from shelfmark.operators import tree as T
from shelfmark.operators.browse import AssetQuery as Q
from shelfmark.plans.project import PUBLISHED, publish
from shelfmark.sources.clustered import Clustered
from shelfmark.sources.search_index import SearchIndex
from shelfmark.staging import shared_dir, staged

_DAY = 86_400 * 10**9
FROM, BEFORE = 9_000 * _DAY, 9_800 * _DAY
_NAME = "directory_path, natural_name_key, name, relative_path, id"


def _page(q: Q, where: str, order: str):
    fields = ["id", "library_id", "relative_path", "kind", "mtime_ns", "size_bytes", "pos"]
    sql = f"SELECT {', '.join(fields[:-1])}, row_number() OVER (ORDER BY {order}) AS pos FROM assets WHERE {where} ORDER BY pos LIMIT {q.limit + 1}"
    return lambda c: B.numbered_page(c, q).select(*fields), sql


def _facets(q: Q, where: str):
    return lambda c: B.facets(c, q), f"SELECT count(*) AS all_assets, count(*) FILTER (kind <> 'video') AS images, count(*) FILTER (kind = 'video') AS videos FROM assets WHERE {where}"


def _desc(keys: str) -> str:
    return ", ".join(f"{k} DESC" for k in keys.split(", "))


_SUB = "directory_id IN (WITH RECURSIVE s(id) AS (SELECT 2000003 UNION SELECT d.id FROM directories d JOIN s ON d.parent_id = s.id) SELECT id FROM s)"
_LIB = "library_id = (SELECT library_id FROM directories WHERE id = 2000003)"
_STATE = "SELECT a.*, l.name AS library_name, l.status AS library_status, coalesce(g.status, 'pending') AS thumbnail_status, g.error_code AS thumbnail_error_code, g.frame_count AS thumbnail_frame_count, coalesce(s.status, 'pending') AS storyboard_status, s.error_code AS storyboard_error_code, s.frame_count AS storyboard_frame_count, CASE WHEN l.status = 'offline' THEN 'offline' ELSE 'available' END AS availability FROM assets a JOIN libraries l ON l.id = a.library_id LEFT JOIN thumbnails g ON g.asset_id = a.id AND g.variant = 'grid' LEFT JOIN thumbnails s ON s.asset_id = a.id AND s.variant = 'storyboard'"
_ROW = ["id", "library_id", "library_name", "relative_path", "kind", "format", "mime_type", "size_bytes", "mtime_ns", "availability", "probe_status", "width", "height", "duration_ms", "thumbnail_status", "thumbnail_error_code", "storyboard_status", "storyboard_frame_count"]
_PUBLIC = "CASE WHEN {0} = 'media_processing_failed' THEN 'thumbnail_failed' ELSE {0} END"


def _library_of(c, directory: int) -> int:
    """The library of a directory; 0, which is none, where there is no such directory."""
    found = c.directories.filter(F.col("id") == directory).select("library_id").first()
    return found[0] if found else 0


def _recursive(c, **more):
    q = Q(library=_library_of(c, 2000003), directory=2000003, recursive=True, **more)
    return B.numbered_page(c, q).select("id", "library_id", "relative_path", "kind", "mtime_ns", "size_bytes", "pos")


def _keyset(name: str, q: Q, where: str, keys: str):
    """Page two, after the 40th row of page one; values of the position are read once, as a cursor carries them."""
    import dataclasses

    names = [k.strip() for k in keys.split(",")]
    down = q.normal().order == "desc"
    order = _desc(keys) if down else keys

    def run(c):
        first = B.page(c, dataclasses.replace(q, limit=40)).collect()
        after = tuple(first[39][k] for k in names) if len(first) >= 40 else None
        page = B.numbered_page(c, dataclasses.replace(q, after=after)).select("id", "library_id", "relative_path", "kind", "mtime_ns", "size_bytes", "pos")
        return page if after else page.limit(0)  # no second page

    sql = f"SELECT id, library_id, relative_path, kind, mtime_ns, size_bytes, n - 40 AS pos FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM assets WHERE {where}) WHERE n > 40 AND n <= 40 + {q.limit + 1}"
    return name, run, sql


def _stored(c):
    """Publishes the catalogue and counts what readers then see."""
    store = publish(c.spark, c.folder)
    one = [store.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum("asset_id" if t == "thumbnails" else "id").alias("ids")) for t in PUBLISHED]
    return reduce(lambda a, b: a.unionByName(b), one)


_CHANGED_PATHS = "(SELECT id, CASE WHEN id % 37 = 0 THEN search_path_key || '.2' ELSE search_path_key END AS path FROM assets WHERE id % 41 <> 0)"


def _stored_search(c):
    """Builds an index of all paths, changes some rows and drops others, and searches it with the changes and after they are merged."""
    index = SearchIndex(c.spark, f"{shared_dir(c.spark)}/index-{uuid.uuid4().hex}")
    index.build(c.assets.select("id", F.col("search_path_key").alias("text")))
    index.change(c.assets.filter("id % 37 = 0 or id % 41 = 0").select("id", F.when(F.col("id") % 41 != 0, F.concat("search_path_key", F.lit(".2"))).alias("text")))
    found = staged(index.search("customer#00000", "2").select("id"), "found")
    index.merge()
    again = index.search("customer#00000", "2").select("id")
    return found.intersect(again)


def _stored_page(c):
    """The second page of a library's names from a table that is stored in their order."""
    keys = ("library_id", "directory_path", "natural_name_key", "name", "relative_path", "id")
    table = Clustered(c.spark, f"{shared_dir(c.spark)}/assets-{uuid.uuid4().hex}", keys, 1000)
    table.write(c.assets)
    first = table.page(40, prefix=(2,)).collect()
    page = table.page(51, tuple(first[39][k] for k in keys) if len(first) >= 40 else None, (2,))
    return B.numbered(page if len(first) >= 40 else page.limit(0), *map(F.col, keys)).select("id", "library_id", "relative_path", "pos")


#: Stems of names in several scripts: marks, case, width, letters that expand, signs, digits of other scripts.
_STEMS = ("Bild ", "bild ", "BILD 0", "Bild 00", "Ära ", "ara ", "A\u0308ra ", "Straße ", "STRASSE ", "Ｂｉｌｄ ", "Ωμέγα ", "ωμεγα ", "Яблоко ", "яблоко ", "ёлка ", "елка ", "上海 ", "カメラ ", "かめら ", "صورة ", "Bild ٣", "bild_", "bild-", "Œuvre ", "oeuvre ", "ñu ", "nu ", "z ")
_MIXED = f"(SELECT id, list_extract([{', '.join(repr(x) for x in _STEMS)}], CAST(id % {len(_STEMS)} + 1 AS INT)) || CAST(id // 3 % 1200 AS VARCHAR) || CASE WHEN id % 5 = 0 THEN '.jpg' WHEN id % 5 = 1 THEN '.JPG' ELSE '' END AS name FROM assets)"
_RUN = "list_aggregate(list_transform(regexp_extract_all(name, '[0-9٠-٩]+|[^0-9٠-٩]+'), lambda run: CASE WHEN regexp_matches(run, '^[0-9٠-٩]') THEN '0' || lpad(CAST(length(regexp_replace(run, '^[0٠]+(.)', '\\1')) AS VARCHAR), 4, '0') || regexp_replace(run, '^[0٠]+(.)', '\\1') ELSE run END), 'string_agg', '')"
#: Weights of the first level: a full sort key up to its first separator.
_WEIGHTS = f"list_aggregate(list_transform(range(1, 2 * list_position(list_transform(range(1, length(icu_sort_key({_RUN}, 'und')), 2), lambda i: substr(icu_sort_key({_RUN}, 'und'), i, 2)), '01') - 1, 2), lambda i: substr(icu_sort_key({_RUN}, 'und'), i, 2)), 'string_agg', '')"


def _mixed(c):
    k = F.col("id")
    end = F.when(k % 5 == 0, ".jpg").when(k % 5 == 1, ".JPG").otherwise("")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in _STEMS]), (k % len(_STEMS) + 1).cast("int")), (F.floor(k / 3) % 1200).cast("string"), end)
    return c.assets.select("id", name.alias("name")).withColumn("key", X.natural_name_key(F.col("name")))


def _natural_page(c):
    """The page behind the 1500th name; the position is read once, as a cursor carries it."""
    keys = ("key", "name", "id")
    at = _mixed(c).orderBy(*keys).limit(1500).orderBy(*[F.desc(k) for k in keys]).first()
    if at is None:
        return B.numbered(_mixed(c), *map(F.col, keys)).select("id", "name", "pos")
    return B.numbered(_mixed(c).filter(B.after(keys, tuple(at[k] for k in keys), False)).orderBy(*keys).limit(201), *map(F.col, keys)).select("id", "name", "pos")


#: Directories some of whose parents are wrong: missing ones, rings of two and of one's own child, second roots, parents elsewhere.
_TANGLED = "(SELECT id, library_id, CASE WHEN id = 2000006 THEN (SELECT min(id) FROM directories WHERE parent_id = 2000006) WHEN id % 97 = 5 THEN id WHEN id % 89 = 3 THEN id + 900000000 WHEN id % 83 = 7 THEN NULL WHEN id % 79 = 2 THEN 1000001 ELSE parent_id END AS parent_id FROM directories)"


def _tangled(c):
    k = F.col("id")
    child = c.directories.filter("parent_id = 2000006").agg(F.min("id").alias("child"))
    rules = F.when(k == 2_000_006, F.col("child")).when(k % 97 == 5, k).when(k % 89 == 3, k + 900_000_000).when(k % 83 == 7, F.lit(None)).when(k % 79 == 2, F.lit(1_000_001)).otherwise(F.col("parent_id"))
    return c.directories.crossJoin(F.broadcast(child)).select("id", "library_id", rules.cast("long").alias("parent_id"))  # one row


ENTRIES = [
    ("table_scan", lambda c: c.assets, "SELECT * FROM assets"),
    ("table_scan_directories", lambda c: c.directories, "SELECT * FROM directories"),
    ("table_scan_thumbnails", lambda c: c.thumbnails, "SELECT * FROM thumbnails"),
    ("table_scan_media_jobs", lambda c: c.media_jobs, "SELECT * FROM media_jobs"),
    ("table_scan_scan_runs", lambda c: c.scan_runs, "SELECT * FROM scan_runs"),
    ("asset_projection", lambda c: B.with_state(c, c.assets).select(*_ROW), f"SELECT {', '.join(_ROW)} FROM ({_STATE})"),
    ("asset_point_lookup", lambda c: B.with_state(c, c.assets.filter("id = 42")).select(*_ROW), f"SELECT {', '.join(_ROW)} FROM ({_STATE}) WHERE id = 42"),
    (
        "content_asset_lookup",
        lambda c: c.assets.filter("id = 77").join(c.libraries.select(F.col("id").alias("library_id"), "root_rel_path", "status"), "library_id").select("id", "library_id", "root_rel_path", "status", "relative_path", "source_fingerprint"),
        "SELECT a.id, library_id, root_rel_path, status, relative_path, source_fingerprint FROM assets a JOIN libraries l ON l.id = library_id WHERE a.id = 77",
    ),
    (
        "join_asset_library",
        lambda c: c.assets.join(c.libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name")), "library_id").groupBy("library_name").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")),
        "SELECT l.name AS library_name, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM assets JOIN libraries l ON l.id = library_id GROUP BY 1",
    ),
    (
        "join_asset_thumbnails",
        lambda c: B.with_state(c, c.assets).groupBy("thumbnail_status", "storyboard_status").agg(F.count("*").alias("n")),
        f"SELECT thumbnail_status, storyboard_status, count(*) AS n FROM ({_STATE}) GROUP BY 1, 2",
    ),
    ("scope_directory_direct", *_page(Q(library=1, directory=10_000_010, sort="name"), "library_id = 1 AND directory_id = 10000010", _NAME)),
    (
        "scope_directory_recursive",
        lambda c: _recursive(c),
        f"SELECT id, library_id, relative_path, kind, mtime_ns, size_bytes, row_number() OVER (ORDER BY mtime_ns DESC, id DESC) AS pos FROM assets WHERE {_LIB} AND {_SUB} ORDER BY pos LIMIT 51",
    ),
    ("scope_root_recursive", *_page(Q(library=2, directory=1_000_001, recursive=True), "library_id = 2", "mtime_ns DESC, id DESC")),
    (
        "scope_library",
        *_page(Q(library=3, text="asset 1"), "library_id = 3 AND (contains(search_name_key, '1') OR contains(search_path_key, '1')) AND (contains(search_name_key, 'asset') OR contains(search_path_key, 'asset'))", "mtime_ns DESC, id DESC"),
    ),
    ("scope_global", *_page(Q(text="77 JPG"), "contains(search_path_key, '77') AND contains(search_path_key, 'jpg')", "mtime_ns DESC, id DESC")),
    ("unindexed_root_empty", *_page(Q(library=1, directory=0), "false", "id")),
    (
        "search_terms",
        lambda c: c.assets.filter(B.has_terms(("12", "asset 3"), "search_name_key", "search_path_key")).select("id", "relative_path"),
        "SELECT id, relative_path FROM assets WHERE (contains(search_name_key, '12') OR contains(search_path_key, '12')) AND (contains(search_name_key, 'asset 3') OR "
        "contains(search_path_key, 'asset 3'))",
    ),
    (
        "directory_filter",
        lambda c: c.directories.filter((F.col("parent_id") == 2_000_007) & B.has_terms(("1", "customer"), "search_name_key")).select("id", "name"),
        "SELECT id, name FROM directories WHERE parent_id = 2000007 AND contains(search_name_key, '1') AND contains(search_name_key, 'customer')",
    ),
    ("kind_filter", *_page(Q(library=1, kinds=("video", "animated", "video"), sort="size"), "library_id = 1 AND kind IN ('animated', 'video')", "size_bytes DESC, id DESC")),
    (
        "modified_range",
        *_page(Q(library=1, modified_from=FROM, modified_before=BEFORE, sort="modified", order="asc"), f"library_id = 1 AND mtime_ns >= {FROM} AND mtime_ns < {BEFORE}", "mtime_ns, id"),
    ),
    ("optional_filter", lambda c: c.system_events.filter("level = 'warning'").filter("module = 'purchase'"), "SELECT * FROM system_events WHERE level = 'warning' AND module = 'purchase'"),
    ("sort_name_scoped", *_page(Q(library=4, sort="name", order="desc"), "library_id = 4", _desc(_NAME))),
    ("sort_name_global", *_page(Q(text="asset", sort="name"), "true", "library_id, " + _NAME)),
    ("sort_modified", *_page(Q(library=5, sort="modified", order="asc", limit=200), "library_id = 5", "mtime_ns, id")),
    ("sort_size", *_page(Q(library=5, sort="size"), "library_id = 5", "size_bytes DESC, id DESC")),
    _keyset("keyset_name_scoped", Q(library=2, sort="name"), "library_id = 2", _NAME),
    _keyset("keyset_name_global", Q(text="asset", sort="name", order="desc"), "true", "library_id, " + _NAME),
    _keyset("keyset_modified", Q(library=2, sort="modified"), "library_id = 2", "mtime_ns, id"),
    _keyset("keyset_size", Q(library=2, sort="size", order="asc"), "library_id = 2", "size_bytes, id"),
    (
        "limit_plus_one",
        lambda c: B.page(c, Q(library=1, limit=10)).agg(F.count("*").alias("rows"), (F.count("*") > 10).alias("more")),
        "SELECT count(*) AS rows, count(*) > 10 AS more FROM (SELECT 1 FROM assets WHERE library_id = 1 LIMIT 11)",
    ),
    (
        "facet_counts",
        *_facets(Q(library=1, text="asset 1", kinds=("video",), modified_from=FROM), f"library_id = 1 AND contains(search_path_key, 'asset') AND contains(search_path_key, '1') AND mtime_ns >= {FROM}"),
    ),
    ("facet_counts_empty", *_facets(Q(library=1, text="no such name"), "false")),
    (
        "facets_all_libraries",
        lambda c: B.facets_by(c.assets, "library_id"),
        "SELECT library_id, count(*) AS all_assets, count(*) FILTER (kind <> 'video') AS images, count(*) FILTER (kind = 'video') AS videos FROM assets GROUP BY 1",
    ),
    (
        "page_count_consistency",
        lambda c: B.facets_by(c.assets, "library_id").select("library_id", (F.col("images") + F.col("videos") == F.col("all_assets")).alias("consistent")),
        "SELECT library_id, count(*) FILTER (kind <> 'video') + count(*) FILTER (kind = 'video') = count(*) AS consistent FROM assets GROUP BY 1",
    ),
    (
        "state_projection_thumbnail",
        lambda c: B.thumbnail_state(B.with_state(c, c.assets)),
        "SELECT id, CASE WHEN availability = 'offline' THEN 'unavailable' WHEN thumbnail_status IN ('ready', 'failed') THEN thumbnail_status ELSE 'pending' END AS state, CASE "
        f"WHEN availability = 'offline' THEN 'source_offline' WHEN thumbnail_status = 'failed' THEN {_PUBLIC.format('thumbnail_error_code')} END AS code FROM ({_STATE})",
    ),
    (
        "state_projection_storyboard",
        lambda c: B.storyboard_state(B.with_state(c, c.assets)),
        "SELECT id, CASE WHEN kind <> 'video' THEN 'not_applicable' WHEN availability = 'offline' THEN 'unavailable' WHEN duration_ms IS NULL AND probe_status IN ('failed', "
        "'unsupported') AND probe_error_code IS NOT NULL THEN 'failed' WHEN duration_ms IS NULL THEN 'pending' WHEN duration_ms < 2000 THEN 'not_applicable' WHEN "
        "storyboard_status = 'ready' AND storyboard_frame_count IS NOT NULL THEN 'ready' WHEN storyboard_status = 'failed' THEN 'failed' ELSE 'pending' END AS state, CASE WHEN "
        "kind <> 'video' THEN NULL WHEN availability = 'offline' THEN 'source_offline' WHEN duration_ms IS NULL AND probe_status IN ('failed', 'unsupported') AND probe_error_code "
        f"IS NOT NULL THEN {_PUBLIC.format('probe_error_code')} WHEN duration_ms >= 2000 AND storyboard_status = 'failed' THEN {_PUBLIC.format('storyboard_error_code')} END AS "
        f"code FROM ({_STATE})",
    ),
    *[(f"delivery_state_{v}", lambda c, v=v: B.delivery_state(c, v), f"SELECT a.id, CASE WHEN {('false', 'kind <> ' + chr(39) + 'video' + chr(39) + ' OR coalesce(duration_ms < 2000, true)')[v == 'storyboard']} THEN 'not_eligible' WHEN l.status = 'offline' THEN 'offline' WHEN t.status IN ('ready', 'failed') THEN t.status WHEN j.status = 'running' THEN 'running' ELSE 'queued' END AS state FROM assets a JOIN libraries l ON l.id = a.library_id LEFT JOIN thumbnails t ON t.asset_id = a.id AND t.variant = '{v}' LEFT JOIN media_jobs j ON j.asset_id = a.id AND j.variant = '{v}'") for v in ("grid", "storyboard")],
    (
        "asset_invariant_check",
        lambda c: B.violations(B.with_state(c, c.assets)).select("id", "probe_status", "thumbnail_status"),
        f"SELECT id, probe_status, thumbnail_status FROM ({_STATE}) WHERE NOT (CASE probe_status WHEN 'pending' THEN probe_error_code IS NULL WHEN 'ready' THEN coalesce(width >= 1 "
        "AND height >= 1, false) AND probe_error_code IS NULL ELSE probe_error_code IS NOT NULL END AND CASE thumbnail_status WHEN 'pending' THEN thumbnail_error_code IS NULL "
        "WHEN 'ready' THEN probe_status = 'ready' AND thumbnail_error_code IS NULL ELSE thumbnail_error_code IS NOT NULL END)",
    ),
    (
        "fingerprint_match",
        lambda c: c.thumbnails.join(c.assets.select(F.col("id").alias("asset_id"), "size_bytes", "mtime_ns"), "asset_id").select("asset_id", "variant", (F.col("source_fingerprint") == X.source_fingerprint(F.col("size_bytes"), F.col("mtime_ns"))).alias("matches")),
        "SELECT asset_id, variant, t.source_fingerprint = 'v1:' || size_bytes || ':' || mtime_ns AS matches FROM thumbnails t JOIN assets a ON a.id = asset_id",
    ),
    (
        "stored_catalogue",
        _stored,
        " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM {t}" for t in ("libraries", "directories", "assets", "media_jobs", "scan_runs")) + " UNION ALL SELECT 'thumbnails', count(*), CAST(sum(asset_id) AS BIGINT) FROM thumbnails",
    ),
    ("stored_search", _stored_search, f"SELECT id FROM {_CHANGED_PATHS} WHERE contains(path, 'customer#00000') AND contains(path, '2')"),
    (
        "stored_page",
        _stored_page,
        f"SELECT id, library_id, relative_path, n - 40 AS pos FROM (SELECT *, row_number() OVER (ORDER BY {_NAME}) AS n FROM assets WHERE library_id = 2) WHERE n > 40 AND n <= 91",
    ),
    (
        "natural_order",
        lambda c: B.numbered(_mixed(c).orderBy("key", "name", "id").limit(2001), F.col("key"), F.col("name"), F.col("id")).select("id", "name", "pos"),
        f"SELECT id, name, row_number() OVER (ORDER BY {_WEIGHTS}, name, id) AS pos FROM {_MIXED} ORDER BY pos LIMIT 2001",
    ),
    (
        "natural_order_groups",
        lambda c: _mixed(c).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least_id")).select("n", "least_id"),
        f"SELECT count(*) AS n, min(id) AS least_id FROM {_MIXED} GROUP BY {_WEIGHTS}",
    ),
    (
        "keyset_natural",
        _natural_page,
        f"SELECT id, name, n - 1500 AS pos FROM (SELECT id, name, row_number() OVER (ORDER BY {_WEIGHTS}, name, id) AS n FROM {_MIXED}) WHERE n > 1500 AND n <= 1500 + 201",
    ),
    (
        "keyset_directories",
        lambda c: B.numbered(c.directories.filter("parent_id = 2000005").filter(B.after(("natural_name_key", "name", "id"), ("customer#0001", "Customer#1", 0), False)).orderBy("natural_name_key", "name", "id").limit(51), F.col("natural_name_key"), F.col("name"), F.col("id")).select("id", "name", "pos"),
        "SELECT id, name, row_number() OVER (ORDER BY natural_name_key, name, id) AS pos FROM directories WHERE parent_id = 2000005 AND (natural_name_key > 'customer#0001' OR "
        "(natural_name_key = 'customer#0001' AND name > 'Customer#1') OR (natural_name_key = 'customer#0001' AND name = 'Customer#1' AND id > 0)) ORDER BY pos LIMIT 51",
    ),
    (
        "keyset_libraries",
        lambda c: B.numbered(c.libraries.filter(B.after(("name", "id"), ("ASIA", 3), False)).orderBy("name", "id").limit(3), F.col("name"), F.col("id")).select("id", "name", "pos"),
        "SELECT id, name, row_number() OVER (ORDER BY name, id) AS pos FROM libraries WHERE name > 'ASIA' OR (name = 'ASIA' AND id > 3) ORDER BY pos LIMIT 3",
    ),
    (
        "keyset_scans",
        lambda c: B.numbered(c.scan_runs.filter("library_id = 2").filter(B.after(("created_at_ms", "id"), (3_000_000, 51), True)).orderBy(F.desc("created_at_ms"), F.desc("id")).limit(11), F.desc("created_at_ms"), F.desc("id")).select("id", "status", "pos"),
        "SELECT id, status, row_number() OVER (ORDER BY created_at_ms DESC, id DESC) AS pos FROM scan_runs WHERE library_id = 2 AND (created_at_ms < 3000000 OR (created_at_ms = "
        "3000000 AND id < 51)) ORDER BY pos LIMIT 11",
    ),
    (
        "keyset_events",
        lambda c: B.numbered(c.system_events.filter("id < 500").orderBy(F.desc("id")).limit(51), F.desc("id")),
        "SELECT *, row_number() OVER (ORDER BY id DESC) AS pos FROM system_events WHERE id < 500 ORDER BY pos LIMIT 51",
    ),
    ("keyset_id_asc", lambda c: c.libraries.filter("id > 2").orderBy("id").limit(64).select("id", "name"), "SELECT id, name FROM libraries WHERE id > 2 ORDER BY id LIMIT 64"),
    (
        "topk_heap",
        lambda c: c.directories.filter(F.col("name") > "Customer#000000100").orderBy("name", "id").limit(21).select("id", "name"),
        "SELECT id, name FROM directories WHERE name > 'Customer#000000100' ORDER BY name, id LIMIT 21",
    ),
    (
        "fts_scan",
        lambda c: I.scanned_candidates(c.assets, "asset 12").select("id"),
        "SELECT id FROM assets WHERE (SELECT bool_and(contains(search_path_key, g)) FROM (VALUES ('ass'), ('sse'), ('set'), ('et '), ('t 1'), (' 12')) v(g))",
    ),
    (
        "join_fts",
        lambda c: I.scanned_candidates(c.assets, "asset 12").filter(F.col("search_path_key").contains("asset 12")).select("id", "relative_path"),
        "SELECT id, relative_path FROM assets WHERE contains(search_path_key, 'asset 12')",
    ),
    (
        "search_index_check",
        lambda c: I.index_differences(I.trigrams(c.directories.filter("id % 7 <> 0").withColumn("search_path_key", F.lower("relative_path"))), c.directories.withColumn("search_path_key", F.lower("relative_path"))).groupBy("side", "id").agg(F.count("*").alias("grams")),
        "SELECT 'missing' AS side, id, count(DISTINCT substr(lower(relative_path), i, 3)) AS grams FROM directories, range(1, 200) r(i) WHERE id % 7 = 0 AND i <= "
        "length(relative_path) - 2 GROUP BY id",
    ),
    (
        "subtree",
        lambda c: T.subtree(c.directories, 2_000_003).select("id", "relative_path"),
        "SELECT id, relative_path FROM directories WHERE id IN (WITH RECURSIVE s(id) AS (SELECT 2000003 UNION SELECT d.id FROM directories d JOIN s ON d.parent_id = s.id) SELECT id FROM s)",
    ),
    (
        "recursive_union_distinct",
        lambda c: P.descendants(c.directories, c.directories.filter("id = 1000002")).join(c.directories, "id").groupBy("library_id").agg(F.count("*").alias("n")),
        "SELECT library_id, count(*) AS n FROM directories WHERE id IN (WITH RECURSIVE s(id) AS (SELECT 1000002 UNION SELECT d.id FROM directories d JOIN s ON d.parent_id = s.id) "
        "SELECT id FROM s) GROUP BY 1",
    ),
    (
        "recursive_union_all",
        lambda c: T.ancestors_by_parent(_chain(c)),
        "SELECT a.conv_id * 1000 + a.turn AS id, a.conv_id * 1000 + b.turn AS ancestor, a.turn - b.turn AS distance FROM conversations a JOIN conversations b ON a.conv_id = "
        "b.conv_id AND b.turn < a.turn",
    ),
    (
        "parent_states",
        lambda c: P.depths(_tangled(c)),
        f"SELECT * FROM (WITH RECURSIVE w(id, place, steps) AS (SELECT id, id, 0 FROM {_TANGLED} UNION ALL SELECT w.id, n.parent_id, steps + 1 FROM w JOIN {_TANGLED} n ON n.id = "
        f"w.place WHERE n.parent_id IN (SELECT id FROM {_TANGLED}) AND steps < 9), s AS (SELECT id, max(steps) AS far, max_by(place, steps) AS top, bool_or(steps > 0 AND place = "
        "id) AS ring FROM w GROUP BY 1) SELECT s.id, CASE WHEN far < 9 THEN top END AS root, CASE WHEN far < 9 THEN far END AS depth, CASE WHEN ring THEN 'cycle' WHEN far = 9 "
        f"THEN 'below_cycle' WHEN n.parent_id IS NULL THEN 'tree' ELSE 'orphan' END AS state FROM s JOIN {_TANGLED} n ON n.id = s.top)",
    ),
    (
        "tree_problems",
        lambda c: P.problems(_tangled(c)).groupBy("problem", "id").agg(F.count("*").alias("n")),
        f"SELECT * FROM (WITH RECURSIVE w(id, place, steps) AS (SELECT id, id, 0 FROM {_TANGLED} UNION ALL SELECT w.id, n.parent_id, steps + 1 FROM w JOIN {_TANGLED} n ON n.id = "
        f"w.place WHERE n.parent_id IN (SELECT id FROM {_TANGLED}) AND steps < 9), s AS (SELECT id, max(steps) AS far, max_by(place, steps) AS top, bool_or(steps > 0 AND place = "
        "id) AS ring FROM w GROUP BY 1) SELECT problem, id, 1 AS n FROM (SELECT CASE WHEN ring THEN 'cycle' WHEN far = 9 THEN 'below_cycle' ELSE 'orphan' END AS problem, s.id "
        f"FROM s JOIN {_TANGLED} n ON n.id = s.top WHERE far = 9 OR n.parent_id IS NOT NULL UNION ALL SELECT 'second_root', id FROM {_TANGLED} d WHERE parent_id IS NULL AND id > "
        f"(SELECT min(id) FROM {_TANGLED} x WHERE x.library_id = d.library_id AND x.parent_id IS NULL) UNION ALL SELECT 'no_root', min(id) FROM {_TANGLED} GROUP BY library_id "
        f"HAVING count(*) FILTER (parent_id IS NULL) = 0 UNION ALL SELECT 'other_library', d.id FROM {_TANGLED} d JOIN {_TANGLED} p ON p.id = d.parent_id WHERE p.library_id <> "
        "d.library_id))",
    ),
    (
        "lineage",
        lambda c: T.lineage(c.directories, 10_000_033),
        "SELECT CASE WHEN a.relative_path = '' THEN 0 ELSE len(string_split(a.relative_path, '/')) END AS depth, a.id, a.library_id, a.name, a.relative_path FROM directories a "
        "JOIN directories d ON d.library_id = a.library_id AND (a.relative_path = '' OR d.relative_path = a.relative_path OR starts_with(d.relative_path, a.relative_path || '/')) "
        "WHERE d.id = 10000033",
    ),
    (
        "breadcrumbs",
        lambda c: T.breadcrumbs(c.directories, c.libraries),
        "SELECT d.id, l.name || CASE WHEN d.relative_path = '' THEN '' ELSE ' > ' || replace(d.relative_path, '/', ' > ') END AS breadcrumbs, CASE WHEN d.relative_path = '' THEN "
        "1 ELSE 1 + len(string_split(d.relative_path, '/')) END AS depth FROM directories d JOIN libraries l ON l.id = d.library_id",
    ),
    (
        "ancestors",
        lambda c: T.ancestor_pairs(c.directories).filter("ancestor_path <> relative_path").select("id", "ancestor_path", "depth"),
        "SELECT d.id, a.relative_path AS ancestor_path, CASE WHEN a.relative_path = '' THEN 0 ELSE len(string_split(a.relative_path, '/')) END AS depth FROM directories d JOIN "
        "directories a ON a.library_id = d.library_id AND a.relative_path <> d.relative_path AND (a.relative_path = '' OR starts_with(d.relative_path, a.relative_path || '/'))",
    ),
    ("has_children", lambda c: T.has_children(c.directories), "SELECT id, EXISTS (SELECT 1 FROM directories x WHERE x.parent_id = d.id) AS has_children FROM directories d"),
    (
        "semi_exists",
        lambda c: T.has_children(c.directories).groupBy("has_children").agg(F.count("*").alias("n")),
        "SELECT id IN (SELECT parent_id FROM directories WHERE parent_id IS NOT NULL) AS has_children, count(*) AS n FROM directories GROUP BY 1",
    ),
    (
        "rollup_recursive_counts",
        lambda c: P.rollup(c.directories, c.assets),
        "SELECT d.id, (SELECT count(*) FROM assets a WHERE a.directory_id = d.id) AS direct_count, coalesce(r.n, 0) AS recursive_count, (SELECT count(*) FROM directories x WHERE "
        "x.parent_id = d.id) AS child_count FROM directories d LEFT JOIN (WITH RECURSIVE up(id, n) AS (SELECT directory_id, count(*) FROM assets GROUP BY 1 UNION ALL SELECT "
        "d.parent_id, n FROM up JOIN directories d ON d.id = up.id WHERE d.parent_id IS NOT NULL) SELECT id, CAST(sum(n) AS BIGINT) AS n FROM up GROUP BY 1) r ON r.id = d.id",
    ),
    ("direct_counts", lambda c: c.assets.groupBy("directory_id").agg(F.count("*").alias("n")), "SELECT directory_id, count(*) AS n FROM assets GROUP BY 1"),
    (
        "child_counts",
        lambda c: c.directories.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n")),
        "SELECT parent_id, count(*) AS n FROM directories WHERE parent_id IS NOT NULL GROUP BY 1",
    ),
    (
        "incremental_rollup",
        lambda c: T.incremental_rollup(c.directories, T.rollup_counts(c.directories, c.assets).drop("child_count"), c.assets.filter("id % 17 = 1").groupBy(F.col("directory_id").alias("id")).agg((-F.count("*")).alias("delta"))),
        "SELECT d.id, (SELECT count(*) FROM assets a WHERE a.directory_id = d.id AND id % 17 <> 1) AS direct_count, coalesce(r.n, 0) AS recursive_count FROM directories d LEFT "
        "JOIN (WITH RECURSIVE up(id, n) AS (SELECT directory_id, count(*) FROM assets WHERE id % 17 <> 1 GROUP BY 1 UNION ALL SELECT d.parent_id, n FROM up JOIN directories d ON "
        "d.id = up.id WHERE d.parent_id IS NOT NULL) SELECT id, CAST(sum(n) AS BIGINT) AS n FROM up GROUP BY 1) r ON r.id = d.id",
    ),
    (
        "self_join_parent_child",
        lambda c: c.directories.alias("d").join(c.directories.alias("p"), F.col("d.parent_id") == F.col("p.id"), "left").select(F.col("d.id").alias("id"), F.col("p.relative_path").alias("parent_path"), F.coalesce(F.col("p.library_id") == F.col("d.library_id"), F.lit(True)).alias("same_library")),
        "SELECT d.id, p.relative_path AS parent_path, coalesce(p.library_id = d.library_id, true) AS same_library FROM directories d LEFT JOIN directories p ON p.id = d.parent_id",
    ),
    (
        "integrity_relationships",
        lambda c: T.integrity(c.directories.filter("id % 50 <> 3").withColumn("library_id", F.when(F.col("id") % 41 == 0, 1).otherwise(F.col("library_id"))), c.assets),
        "SELECT 'directory' AS problem, d.id FROM (SELECT * REPLACE (CASE WHEN id % 41 = 0 THEN 1 ELSE library_id END AS library_id) FROM directories WHERE id % 50 <> 3) d LEFT "
        "JOIN (SELECT id, CASE WHEN id % 41 = 0 THEN 1 ELSE library_id END AS library_id FROM directories WHERE id % 50 <> 3) p ON p.id = d.parent_id WHERE d.parent_id IS NOT "
        "NULL AND (p.id IS NULL OR p.library_id <> d.library_id) UNION ALL SELECT 'asset', a.id FROM assets a LEFT JOIN (SELECT id, CASE WHEN id % 41 = 0 THEN 1 ELSE library_id "
        "END AS library_id FROM directories WHERE id % 50 <> 3) p ON p.id = a.directory_id WHERE p.id IS NULL OR p.library_id <> a.library_id",
    ),
    (
        "union_all_violations",
        lambda c: T.integrity(c.directories, c.assets).unionByName(T.topology(c.directories)),
        "SELECT 'none' AS problem, id FROM directories WHERE parent_id NOT IN (SELECT id FROM directories)",
    ),
    (
        "integrity_generations",
        lambda c: T.generations(c.directories.withColumn("last_seen_generation", F.when(F.col("id") % 31 == 0, 1).otherwise(2)), c.assets.withColumn("last_seen_generation", F.when(F.col("id") % 97 == 0, 3).otherwise(F.col("last_seen_generation"))), c.libraries),
        "SELECT 'stale_parent' AS problem, id FROM assets WHERE id % 97 <> 0 AND last_seen_generation = 2 AND directory_id % 31 = 0 UNION ALL SELECT 'future', id FROM assets WHERE id % 97 = 0",
    ),
    (
        "topology_roots",
        lambda c: T.roots(c.directories),
        "SELECT library_id, count(*) AS roots, count(*) FILTER (relative_path <> '') AS malformed FROM directories WHERE parent_id IS NULL GROUP BY 1",
    ),
    (
        "malformed_roots",
        lambda c: T.roots(c.directories.withColumn("parent_id", F.when(F.col("id") % 101 != 0, F.col("parent_id")))).agg(F.coalesce(F.sum("roots"), F.lit(0)).alias("roots"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed")),
        "SELECT count(*) AS roots, count(*) FILTER (relative_path <> '') AS malformed FROM directories WHERE parent_id IS NULL OR id % 101 = 0",
    ),
    (
        "theta_root_overlap",
        lambda c: T.overlaps(c.directories.filter("id < 3000000")),
        "SELECT a.id AS a, b.id AS b FROM directories a JOIN directories b ON a.id <> b.id AND a.library_id = b.library_id AND (a.relative_path = '' OR a.relative_path = "
        "b.relative_path OR starts_with(b.relative_path, a.relative_path || '/')) WHERE a.id < 3000000 AND b.id < 3000000",
    ),
    (
        "theta_directory_overlap",
        lambda c: T.overlaps(c.directories),
        "SELECT a.id AS a, b.id AS b FROM directories a JOIN (SELECT id, library_id, unnest(CASE WHEN relative_path = '' THEN [''] ELSE list_concat([''], list_transform(range(1, "
        "len(string_split(relative_path, '/')) + 1), lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/'))) END) AS path FROM directories) b ON a.library_id = "
        "b.library_id AND a.relative_path = b.path AND a.id <> b.id",
    ),
    (
        "prefix_descendants",
        lambda c: c.directories.filter((F.col("relative_path") == "CHINA") | F.col("relative_path").startswith("CHINA/")).select("id", "relative_path"),
        "SELECT id, relative_path FROM directories WHERE relative_path = 'CHINA' OR starts_with(relative_path, 'CHINA/')",
    ),
]


def _chain(c):
    """A second tree, of a node per turn, that has parents only."""
    t = c.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn")
    return t.select("id", F.when(F.col("turn") > 0, F.col("id") - 1).alias("parent_id"))
