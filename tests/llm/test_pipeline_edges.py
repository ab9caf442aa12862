"""The stages on tables with nulls, repeated rows, clashing names, a very long text, and on none at all."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paytrail.llm import exact_dedup, ngram_join, registry, sharding
from paytrail.plans.cut import shared_dir

SF = "/root/testdata/sf0.001"
LONG = "whole texts are kept " * 100_000


@pytest.fixture(scope="module")
def odd(spark):
    docs = registry.table(spark, SF, "documents")
    extra = [(None, "no key at all", None, None, None), (None, None, "en", "s", 0), (10**9, None, "en", "s", 0), (10**9, "", "en", "s", 0), (10**9 + 1, "twice the same row", "en", "s", 18), (10**9 + 1, "twice the same row", "en", "s", 18), (10**9 + 2, LONG, "en", "s", len(LONG))]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.unionByName(spark.createDataFrame(extra, kinds))
    return rows.withColumns({c: F.lit("clash") for c in ("rep", "n", "__hash", "__near_row", "body", "leaf", "class_id", "rate", "__mix_copies", "g", "k")}).repartition(3)


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs, counts = odd, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == odd.columns
    kept, unique, single, _, packed = counts
    assert kept >= unique >= single > 0 and packed > 0


def test_exact_and_near_stages_keep_one_of_each(spark, odd):
    rows = exact_dedup.drop_duplicates(odd).collect()
    texts = [r.text or "" for r in rows]
    assert sorted(texts) == sorted({r.text or "" for r in odd.collect()}) and LONG in texts
    near = ngram_join.keep_one(odd).collect()
    assert sum(r.text == "no key at all" for r in near) == 1 and sum(r.text == "twice the same row" for r in near) == 1 and sum(r.text == LONG for r in near) == 1
    assert sharding.shard_documents(odd).count() == odd.count()


def test_stages_on_no_rows(spark, odd):
    none = spark.createDataFrame([], odd.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_a_stage_leaves_other_results_alone(spark):
    """Tables belong to the stage that wrote them; a result made elsewhere can still be read."""
    docs = registry.table(spark, SF, "documents")
    groups = exact_dedup.equal_groups(docs)
    corpus_pipeline.STAGES[1][1](spark, docs, SF).count()
    corpus_pipeline.STAGES[2][1](spark, docs, SF).count()
    assert groups.count() == docs.count()
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert {x for x in left if x.startswith("pipeline")} == {"pipeline-best_fit_packing"}  # which the result reads
