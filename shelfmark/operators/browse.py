"""Browsing and searching assets and directories: scope, terms, filters, order, keyset, page and facets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as S
from shelfmark.functions import scalar as X
from shelfmark.operators import tree

KINDS = ("animated", "image", "video")


@dataclass(frozen=True)
class AssetQuery:
    """One request. directory 0 is a library's root that isn't indexed yet; after: the sort keys of the last row seen."""

    library: int | None = None
    directory: int | None = None
    recursive: bool = False
    text: str | None = None
    kinds: tuple[str, ...] = ()
    modified_from: int | None = None
    modified_before: int | None = None
    sort: str | None = None
    order: str | None = None
    limit: int = S.DEFAULT_LIMIT
    after: tuple | None = None

    def normal(self) -> AssetQuery:
        """With defaults filled in; an error where the request has no meaning."""
        if self.library is None and not self.text:
            raise ValueError("a search in all libraries needs text")
        if not set(self.kinds) <= set(KINDS):
            raise ValueError("unknown kind")
        if None not in (self.modified_from, self.modified_before) and self.modified_from >= self.modified_before:
            raise ValueError("empty time range")
        if not 1 <= self.limit <= S.MAX_LIMIT:
            raise ValueError("limit out of range")
        sort = self.sort or ("modified" if self.recursive or self.text else "name")
        order = self.order or ("asc" if sort == "name" else "desc")
        return replace(self, kinds=tuple(sorted(set(self.kinds))), sort=sort, order=order)

    def terms(self) -> tuple[str, ...]:
        return X.normalize_search_terms(self.text) if self.text else ()

    def keys(self) -> tuple[str, ...]:
        """All keys follow one direction."""
        if self.sort == "modified":
            return ("mtime_ns", "id")
        if self.sort == "size":
            return ("size_bytes", "id")
        name = ("directory_path", "natural_name_key", "name", "relative_path", "id")
        return name if self.library is not None else ("library_id", *name)


def after(keys: tuple[str, ...], values: tuple, descending: bool) -> Column:
    """Rows that follow the position, as a disjunction that reaches the scan."""
    ways = []
    for i, k in enumerate(keys):
        step = F.col(k) < F.lit(values[i]) if descending else F.col(k) > F.lit(values[i])
        ways.append(reduce(lambda a, b: a & b, [*[F.col(x) == F.lit(v) for x, v in zip(keys[:i], values[:i], strict=True)], step]))
    return reduce(lambda a, b: a | b, ways)


def has_terms(terms: tuple[str, ...], *columns: str) -> Column:
    """Every term is contained in one of the columns, literally."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(c).contains(t) for c in columns]) for t in terms], F.lit(True))


def scoped(cat, q: AssetQuery) -> DataFrame:
    """Assets of the scope. The root's subtree is its library, without a join."""
    assets = cat.assets
    if q.library is not None:
        assets = assets.filter(F.col("library_id") == q.library)
    if q.directory is None:
        return assets
    if q.directory == 0:
        return assets.limit(0)
    if not q.recursive:
        return assets.filter(F.col("directory_id") == q.directory)
    if is_root(cat, q):
        return assets
    inside = tree.subtree(cat.directories, q.directory).select(F.col("id").alias("directory_id"))
    return assets.join(inside, "directory_id", "left_semi")


def is_root(cat, q: AssetQuery) -> bool:
    row = cat.directories.filter((F.col("id") == q.directory) & (F.col("library_id") == q.library)).select("relative_path").first()
    return row is not None and row[0] == ""


def filtered(cat, q: AssetQuery, kinds: bool = True) -> DataFrame:
    out = scoped(cat, q)
    if terms := q.terms():
        out = out.filter(has_terms(terms, "search_name_key", "search_path_key"))
    if kinds and q.kinds:
        out = out.filter(F.col("kind").isin(*q.kinds))
    if q.modified_from is not None:
        out = out.filter(F.col("mtime_ns") >= q.modified_from)
    if q.modified_before is not None:
        out = out.filter(F.col("mtime_ns") < q.modified_before)
    return out


def page(cat, q: AssetQuery) -> DataFrame:
    """The page and one row more, ordered."""
    q = q.normal()
    out = filtered(cat, q)
    if q.after is not None:
        out = out.filter(after(q.keys(), q.after, q.order == "desc"))
    return out.orderBy(*[F.desc(k) if q.order == "desc" else F.asc(k) for k in q.keys()]).limit(q.limit + 1)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """pos: the place of each of a few rows."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def numbered_page(cat, q: AssetQuery) -> DataFrame:
    q = q.normal()
    return numbered(page(cat, q), *[F.desc(k) if q.order == "desc" else F.asc(k) for k in q.keys()])


def facets(cat, q: AssetQuery) -> DataFrame:
    """Counts under the scope, terms and dates; kinds are not applied."""
    q = q.normal()
    return filtered(cat, q, kinds=False).agg(F.count("*").alias("all_assets"), F.count_if(F.col("kind") != "video").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"))


def facets_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("all_assets"), F.count_if(F.col("kind") != "video").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"))


def with_state(cat, assets: DataFrame) -> DataFrame:
    """Asset rows with their library and both derivatives; no derivative means pending."""
    lib = cat.libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name"), F.col("status").alias("library_status"))
    variant = lambda v, p: cat.thumbnails.filter(F.col("variant") == v).select(F.col("asset_id").alias("id"), F.col("status").alias(f"{p}_status"), F.col("error_code").alias(f"{p}_error_code"), F.col("frame_count").alias(f"{p}_frame_count"))
    out = assets.join(lib, "library_id").join(variant("grid", "thumbnail"), "id", "left").join(variant("storyboard", "storyboard"), "id", "left")
    return out.withColumns({"thumbnail_status": F.coalesce("thumbnail_status", F.lit("pending")), "storyboard_status": F.coalesce("storyboard_status", F.lit("pending")), "availability": F.when(F.col("library_status") == "offline", "offline").otherwise("available")})


def public_code(code: Column) -> Column:
    return F.when(code == "media_processing_failed", "thumbnail_failed").otherwise(code)


def thumbnail_state(rows: DataFrame) -> DataFrame:
    offline, status = F.col("availability") == "offline", F.col("thumbnail_status")
    state = F.when(offline, "unavailable").when(status.isin("ready", "failed"), status).otherwise("pending")
    code = F.when(offline, "source_offline").when(status == "failed", public_code(F.col("thumbnail_error_code")))
    return rows.select("id", state.alias("state"), code.alias("code"))


def storyboard_state(rows: DataFrame) -> DataFrame:
    duration, status = F.col("duration_ms"), F.col("storyboard_status")
    broken = F.col("probe_status").isin("failed", "unsupported") & F.col("probe_error_code").isNotNull()
    ready = (status == "ready") & F.col("storyboard_frame_count").isNotNull()
    ladder = [(F.col("kind") != "video", "not_applicable"), (F.col("availability") == "offline", "unavailable"), (duration.isNull() & broken, "failed"), (duration.isNull(), "pending"), (duration < S.STORYBOARD_LEAST_MS, "not_applicable"), (ready, "ready"), (status == "failed", "failed")]
    state = reduce(lambda w, x: w.when(*x), ladder[1:], F.when(*ladder[0])).otherwise("pending")
    code = F.when(F.col("kind") != "video", None).when(F.col("availability") == "offline", "source_offline").when(duration.isNull() & broken, public_code(F.col("probe_error_code"))).when((duration >= S.STORYBOARD_LEAST_MS) & (status == "failed"), public_code(F.col("storyboard_error_code")))
    return rows.select("id", state.alias("state"), code.alias("code"))


def delivery_state(cat, variant: str) -> DataFrame:
    """What a request for each asset's derivative would get."""
    t = cat.thumbnails.filter(F.col("variant") == variant).select(F.col("asset_id").alias("id"), F.col("status").alias("t_status"))
    j = cat.media_jobs.filter(F.col("variant") == variant).select(F.col("asset_id").alias("id"), F.col("status").alias("j_status"))
    lib = cat.libraries.select(F.col("id").alias("library_id"), F.col("status").alias("l_status"))
    rows = cat.assets.select("id", "library_id", "kind", "duration_ms").join(lib, "library_id").join(t, "id", "left").join(j, "id", "left")
    unfit = F.lit(variant == "storyboard") & ((F.col("kind") != "video") | F.coalesce(F.col("duration_ms") < S.STORYBOARD_LEAST_MS, F.lit(True)))
    state = F.when(unfit, "not_eligible").when(F.col("l_status") == "offline", "offline").when(F.col("t_status").isin("ready", "failed"), F.col("t_status")).when(F.col("j_status") == "running", "running").otherwise("queued")
    return rows.select("id", state.alias("state"))


def violations(rows: DataFrame) -> DataFrame:
    """Asset rows with a state that can't be."""
    code, probe = F.col("probe_error_code"), F.col("probe_status")
    sized = F.coalesce((F.col("width") >= 1) & (F.col("height") >= 1), F.lit(False))
    probe_ok = F.when(probe == "pending", code.isNull()).when(probe == "ready", sized & code.isNull()).when(probe.isin("failed", "unsupported"), code.isNotNull()).otherwise(F.lit(False))
    t, t_code = F.col("thumbnail_status"), F.col("thumbnail_error_code")
    t_ok = F.when(t == "pending", t_code.isNull()).when(t == "ready", (probe == "ready") & t_code.isNull()).when(t == "failed", t_code.isNotNull()).otherwise(F.lit(False))
    named = (F.col("id") > 0) & (F.col("library_id") > 0) & (F.col("directory_id") > 0) & (F.col("relative_path") != "") & (F.col("name") != "") & (F.col("size_bytes") >= 0) & F.col("kind").isin(*KINDS)
    return rows.filter(~(named & probe_ok & t_ok))
