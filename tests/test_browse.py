import dataclasses

import pytest

from shelfmark.operators.browse import AssetQuery, facets, page
from shelfmark.plans.project import Catalogue
from shelfmark.sources import cursors


@pytest.fixture(scope="module")
def cat(spark, sf_dir):
    return Catalogue(spark, sf_dir)


@pytest.mark.parametrize("sort", ["name", "modified", "size"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_make_the_whole(cat, sort, order):
    q = AssetQuery(library=2, sort=sort, order=order, kinds=("video",), limit=37)
    whole = [r["id"] for r in page(cat, dataclasses.replace(q, limit=200)).collect()]
    seen, after = [], None
    while True:
        rows = page(cat, dataclasses.replace(q, after=after)).collect()
        seen += [r["id"] for r in rows[:37]]
        if len(rows) <= 37 or len(seen) >= 150:
            break
        after = tuple(rows[36][k] for k in q.normal().keys())
    n = min(len(seen), len(whole))
    assert seen[:n] == whole[:n] and n > 37


def test_defaults_and_errors():
    assert AssetQuery(library=1).normal().sort == "name"
    assert AssetQuery(library=1).normal().order == "asc"
    assert AssetQuery(library=1, recursive=True).normal().sort == "modified"
    assert AssetQuery(library=1, sort="size").normal().order == "desc"
    for bad in (AssetQuery(), AssetQuery(library=1, kinds=("x",)), AssetQuery(library=1, limit=0), AssetQuery(library=1, modified_from=5, modified_before=5)):
        with pytest.raises(ValueError):
            bad.normal()


def test_facets_ignore_kinds(cat):
    one, other = (facets(cat, AssetQuery(library=1, kinds=k)).first() for k in ((), ("video",)))
    assert one == other and one["all_assets"] == one["images"] + one["videos"]


def test_root_scope_has_no_join(cat):
    plan = page(cat, AssetQuery(library=2, directory=1_000_001, recursive=True))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_filters_reach_the_scan(cat):
    plan = cat.assets.filter("id = 7").select("id", "size_bytes")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan


def test_cursors():
    q = AssetQuery(library=1)
    c = cursors.encode(b"k", q, 3, (1, "x"))
    assert cursors.decode(b"k", q, 3, c) == (1, "x")
    assert cursors.decode(b"k", dataclasses.replace(q, limit=7), 3, c) == (1, "x")
    for key, query, revision, text in ((b"z", q, 3, c), (b"k", AssetQuery(library=2), 3, c), (b"k", q, 4, c), (b"k", q, 3, c[:-2]), (b"k", q, 3, "!")):
        with pytest.raises(cursors.InvalidCursor):
            cursors.decode(key, query, revision, text)
