"""From a listing of files to the next generation of the catalogue: difference, merge, sweep, and what follows for derivatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.staging import staged

KEY = ["library_id", "relative_path"]
_TAKEN = ["directory_id", "name", "kind", "format", "mime_type", "size_bytes", "mtime_ns", "source_fingerprint"]
#: What merge gives, besides columns that it is asked to keep.
MERGED = ["id", *KEY, *_TAKEN, "last_seen_generation", "width", "height", "duration_ms", "probe_status", "probe_error_code"]
#: Directory ids of this many in a row are numbered together.
SPAN = 4096


def _before(window) -> Column:
    """The counts of the rows before, summed."""
    return F.coalesce(F.sum("count").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def difference(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """(library_id, relative_path, change): new, changed or removed; unchanged rows are left out."""
    old = assets.select(*KEY, F.col("source_fingerprint").alias("old"))
    new = listing.select(*KEY, F.col("source_fingerprint").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, KEY, "full").withColumn("change", change).filter("change is not null").select(*KEY, "change")


def _new_ids(fresh: DataFrame, top: DataFrame) -> DataFrame:
    """(library_id, relative_path, new_id) of fresh(library_id, directory_id, relative_path), numbered behind the one row of top(top)."""
    groups = fresh.groupBy("library_id", "directory_id").count().withColumn("span", F.floor(F.col("directory_id") / SPAN))
    spans = groups.groupBy("library_id", "span").agg(F.sum("count").alias("count"))
    base = spans.select("library_id", "span", _before(Window.orderBy("library_id", "span")).alias("base"))
    inner = groups.withColumn("inner", _before(Window.partitionBy("library_id", "span").orderBy("directory_id")))
    start = inner.join(base, ["library_id", "span"]).select("library_id", "directory_id", (F.col("base") + F.col("inner")).alias("start"))
    numbered = fresh.withColumn("n", F.row_number().over(Window.partitionBy("library_id", "directory_id").orderBy("relative_path"))).join(start, ["library_id", "directory_id"])
    return numbered.join(F.broadcast(top)).select(*KEY, (F.col("top") + F.col("start") + F.col("n")).cast("long").alias("new_id"))


def _top(assets: DataFrame, first_id: int | None = None) -> DataFrame:
    """The id that new ones follow, in a row."""
    return assets.sparkSession.range(1).select(F.lit(first_id - 1).alias("top")) if first_id is not None else assets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))


def compared(assets: DataFrame, listing: DataFrame, generation: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of merge, new ones without an id, by one join that tells more of them: `listed`, the `change` as difference has it, and `places`, the directories that it is a change in. keep: more columns of assets that a row keeps; new rows have none."""
    learned = ["width", "height", "duration_ms", "probe_status", "probe_error_code"]
    old = assets.select(*KEY, "id", "last_seen_generation", *learned, *keep, *[F.col(c).alias(f"old_{c}") for c in _TAKEN])
    both = old.join(listing.select(*KEY, *_TAKEN, F.lit(True).alias("listed")), KEY, "full")
    was, now = F.col("old_source_fingerprint"), F.col("source_fingerprint")
    change = F.when(was.isNull(), "new").when(now.isNull(), "removed").when(was != now, "changed")
    places = F.array_distinct(F.array_compact(F.array("old_directory_id", "directory_id")))
    same = was.eqNullSafe(now) | F.col("listed").isNull()
    told = {"listed": F.col("listed").isNotNull(), "change": change, "places": places}
    out = both.withColumns({c: F.when(same, F.col(c)) for c in learned if c != "probe_status"} | {"probe_status": F.when(same, F.col("probe_status")).otherwise("pending")} | told)
    out = out.withColumns({c: F.coalesce(c, f"old_{c}") for c in _TAKEN} | {"last_seen_generation": F.when(F.col("listed"), F.lit(generation)).otherwise(F.col("last_seen_generation"))})
    return out.select("id", *KEY, *_TAKEN, "last_seen_generation", *learned, *keep, *told)


def merge(assets: DataFrame, listing: DataFrame, generation: int, first_id: int | None = None) -> DataFrame:
    """The next asset rows. A path keeps its id; what was learned from a file goes when its fingerprint changes. Rows that the listing lacks stay, as they were seen last.

    New ids follow the largest one, or begin with first_id where the assets are not all there are, in the order of library, directory and path. They are numbered in three levels (spans
    of directories, directories in a span, files in a directory), so that one task sees a row per span at most.
    """
    fresh = listing.join(assets.select(*KEY), KEY, "left_anti").select(*KEY, "directory_id")  # keys alone: the whole rows are joined once
    out = compared(assets, listing, generation).join(_new_ids(fresh, _top(assets, first_id)), KEY, "left")
    return out.withColumn("id", F.coalesce("id", "new_id")).select(MERGED)


def identified(fresh: DataFrame, first_id: int) -> DataFrame:
    """New rows of compared with the ids that merge gives them."""
    ids = _new_ids(fresh.select(*KEY, "directory_id"), _top(fresh, first_id))
    return fresh.join(ids, KEY).withColumn("id", F.col("new_id")).select(fresh.columns)


def unmatched(assets: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets that the listing lacks, new ones with the ids that a merge gives them), each (id, library_id, directory_id, relative_path, source_fingerprint).

    One join of narrow rows tells both; it is staged, so that what follows goes through what came and went, not through all.
    """
    row = [*KEY, "directory_id", "source_fingerprint"]
    old = assets.select(*KEY, F.struct("id", "directory_id", "source_fingerprint").alias("old"))
    new = listing.select(*KEY, F.struct("directory_id", "source_fingerprint").alias("new"))
    both = staged(old.join(new, KEY, "full").filter("old is null or new is null"), "unmatched")
    fresh = both.filter("old is null").select(*KEY, "new.*")
    gone = both.filter("new is null").select(*KEY, "old.*").select("id", *row)
    return gone, fresh.join(_new_ids(fresh, _top(assets)), KEY).select(F.col("new_id").alias("id"), *row)


def sweep(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows that the current listing lacks."""
    return assets.join(listing, KEY, "left_anti")


def stale(rows: DataFrame, generation: int) -> DataFrame:
    return rows.filter(F.col("last_seen_generation") < generation)


def changed_sources(assets: DataFrame, listing: DataFrame) -> DataFrame:
    new = listing.select(*KEY, F.col("source_fingerprint").alias("new_fingerprint"))
    return assets.join(new, KEY).filter(F.col("source_fingerprint") != F.col("new_fingerprint"))


def invalidated(assets: DataFrame, listing: DataFrame, thumbnails: DataFrame, jobs: DataFrame) -> DataFrame:
    """(asset_id, variant, action) for changed sources: ready files to delete, derivative rows and storyboard jobs to drop."""
    gone = changed_sources(assets, listing).select(F.col("id").alias("asset_id"))
    t = thumbnails.join(gone, "asset_id", "left_semi")
    files = t.filter("status = 'ready'").select("asset_id", "variant", F.lit("delete_file").alias("action"))
    rows = t.select("asset_id", "variant", F.lit("drop_row").alias("action"))
    job = jobs.filter("variant = 'storyboard'").join(gone, "asset_id", "left_semi").select("asset_id", "variant", F.lit("drop_job").alias("action"))
    return files.unionByName(rows).unionByName(job)


def admitted_grid_jobs(listing_assets: DataFrame, jobs: DataFrame, version: int) -> DataFrame:
    """Assets without a grid job of this version and fingerprint."""
    have = jobs.filter("variant = 'grid'").filter(F.col("transform_version") == version).select("asset_id", "source_fingerprint")
    return listing_assets.select(F.col("id").alias("asset_id"), "library_id", "source_fingerprint").join(have, ["asset_id", "source_fingerprint"], "left_anti")


def _grams(text: str) -> Column:
    """The distinct runs of three characters of a text that has one."""
    n = F.length(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(F.col(text), i, F.lit(3))))


def trigrams(rows: DataFrame, key: str = "id", text: str = "search_path_key") -> DataFrame:
    """(key, gram): distinct runs of three characters."""
    return rows.filter(F.length(text) >= 3).select(key, F.explode(_grams(text)).alias("gram"))


def stored_order(grams: DataFrame, key: str = "id") -> DataFrame:
    """An index as it is best written: by gram, so that a search reads the row groups of its own grams only."""
    return grams.repartitionByRange("gram", key).sortWithinPartitions("gram", key)


def _parts(term: str) -> list[str]:
    return sorted({term[i : i + 3] for i in range(len(term) - 2)})


def trigram_candidates(grams: DataFrame, term: str, key: str = "id") -> DataFrame:
    """Keys of a stored index with all trigrams of a term of three characters or more; the exact test stays with the caller."""
    parts = _parts(term)
    return grams.filter(F.col("gram").isin(*parts)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(parts)).select(key)


def found(rows: DataFrame, grams: DataFrame, term: str, key: str = "id", text: str = "search_path_key") -> DataFrame:
    """The rows whose text holds a term, by a stored index and the exact test."""
    return rows.join(trigram_candidates(grams, term, key), key, "left_semi").filter(F.contains(text, F.lit(term)))


def scanned_candidates(rows: DataFrame, term: str, text: str = "search_path_key") -> DataFrame:
    """The rows that trigram_candidates would give, where no index is stored: one scan, without exploding or shuffling."""
    return rows.filter(reduce(lambda a, b: a & b, [F.contains(text, F.lit(g)) for g in _parts(term)]))


def index_differences(grams: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, gram, side) where the derived index and its source disagree.

    Ids are compared by the number of their grams and two order-free sums of 32 bits each; only the grams of ids that
    differ are compared one by one. Texts under three characters have no grams.
    """
    digest = lambda of: [F.count("*").alias(f"n_{of}"), F.sum(F.xxhash64("gram").bitwiseAND(2**32 - 1)).alias(f"low_{of}"), F.sum(F.shiftrightunsigned(F.xxhash64("gram"), 32)).alias(f"high_{of}")]
    fresh = trigrams(rows)
    grams = grams.select("id", "gram")
    both = grams.groupBy("id").agg(*digest("a")).join(fresh.groupBy("id").agg(*digest("b")), "id", "full")
    same = reduce(lambda a, b: a & b, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in ("n", "low", "high")])
    ids = both.filter(~same).select("id")
    # a row per gram and side with its copies counted, in place of two differences of whole indexes
    count = lambda df, sign: df.join(ids, "id", "left_semi").select("id", "gram", F.lit(sign).alias("sign"))
    left = count(grams, 1).unionByName(count(fresh, -1)).groupBy("id", "gram").agg(F.sum("sign").alias("left")).filter("left <> 0")
    return left.select("id", F.explode(F.array_repeat("gram", F.abs("left").cast("int"))).alias("gram"), F.when(F.col("left") > 0, "extra").otherwise("missing").alias("side"))
