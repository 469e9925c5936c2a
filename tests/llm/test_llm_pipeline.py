import collections
import hashlib

import corpus_pipeline as P
import pytest
from oddities import none, odd
from pyspark.sql import functions as F

from shelfmark.llm import language_bitmask, minmax_dedup, source_mix, span_crf
from shelfmark.llm.common import written


def test_stages_by_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(P.STAGES)
    one = written(stages["language"](spark, docs, sf_dir), "one")
    f = language_bitmask.fit(docs)
    judged = language_bitmask.identify(docs, f).filter("lang_pred <> 'und' and score >= 0.3").select("doc_id")
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in judged.collect()}
    clean = docs.filter("lang is not null and length(text) > 200")
    assert clean.join(one, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    two = written(stages["near_duplicates"](spark, one, sf_dir), "two")
    kept = minmax_dedup.near_duplicates(one).filter("kept").select("doc_id")
    assert {r[0] for r in two.select("doc_id").collect()} == {r[0] for r in kept.collect()} and two.count() < one.count()
    three = written(stages["personal_data"](spark, two, sf_dir), "three")
    assert three.count() == two.count()
    for r in three.collect():
        assert not span_crf.base_spans(r["text"]), r["doc_id"]
    four = written(stages["source_mixture"](spark, three, sf_dir), "four")
    words = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')")
    got = {r[0]: r[1] for r in four.groupBy("source").agg(F.sum(words)).collect()}
    target = {r["source"]: r["target"] for r in source_mix.mix(three).join(three.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    size = {r[0]: (r[1], r[2]) for r in three.groupBy("source").agg(F.sum(words), F.max(words)).collect()}
    for s, t in target.items():
        assert abs(got.get(s, 0) - t) <= 0.15 * t + 2 * size[s][1], s
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    five = stages["pieces"](spark, four, sf_dir)
    assert five.filter("not lossless").isEmpty() and five.count() == four.count()


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    out = P.run(spark, sf_dir)
    count = lambda df: collections.Counter((r["doc_id"], hashlib.sha256(bytes(str(r["pieces"]), "ascii")).hexdigest(), r["lossless"]) for r in df.collect())
    assert count(out) == count(docs)


@pytest.mark.parametrize("rows", [odd, none])
def test_oddities(spark, sf_dir, rows):
    docs = rows(spark)
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == rows(spark).columns
    out = P.STAGES[-1][1](spark, docs, sf_dir)
    assert out.filter("not lossless").isEmpty()
    if rows is odd:
        assert {2, 3, 4, 5}.isdisjoint({r["doc_id"] for r in out.collect()})
