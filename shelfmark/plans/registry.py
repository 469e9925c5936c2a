"""The queries of the library by name, and their statements in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import browse
from shelfmark.plans import browse_queries, commit_queries, job_queries, scalar_queries, stream_queries
from shelfmark.plans.project import PRELUDE, Catalogue

_MODULES = (browse_queries, job_queries, commit_queries, scalar_queries, stream_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The newest assets of one library with their states, and the library's facet counts."""
    c = Catalogue(spark, folder)
    q = browse.AssetQuery(library=1, directory=1_000_000, recursive=True)
    rows = browse.with_state(c, browse.page(c, q)).select("id", "relative_path", "kind", "size_bytes", "mtime_ns", "availability", "thumbnail_status", "storyboard_status")
    return rows.crossJoin(browse.facets(c, q))  # one row of counts


def queries() -> dict:
    return {name: (lambda spark, folder, run=run: run(Catalogue(spark, folder))) for m in _MODULES for name, run, _ in m.ENTRIES}


def oracle_sql() -> dict:
    return {name: f"{PRELUDE}\n{sql}" for m in _MODULES for name, _, sql in m.ENTRIES if sql}
