"""Every query that SQL can state gives the rows that DuckDB gives for it on the same tables."""

import pytest
from parity import same

from shelfmark.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, duck, name):
    assert same(registry.queries()[name](spark, sf_dir), duck, SQL[name]) is None


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_flagship(spark, sf_dir):
    df = registry.flagship(spark, sf_dir)
    assert 0 < df.count() <= 51
    assert {"all_assets", "images", "videos"} <= set(df.columns)


def test_empty_tables(spark, sf_dir, tmp_path):
    """Pages and scopes of an empty catalogue are empty."""
    from conftest import TABLES

    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("keyset_name_scoped", "keyset_name_global", "keyset_modified", "keyset_size", "scope_directory_recursive", "commit_ready", "commit_reconcile", "upsert_directory", "cache_cleanup", "claim_removal"):
        assert registry.queries()[name](spark, str(tmp_path)).isEmpty(), name
