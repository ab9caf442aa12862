import corpus_pipeline
from paytrail.llm import ngram_join, registry
from tests.llm.test_token_ops import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = registry.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    kept, unique, single, mixed, packed = seen
    last = {}
    for r in kept:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in unique) == sorted(last.values())
    from tests.llm.test_keys_and_copies import brute_links

    classes = brute_links([(r.doc_id, r.text) for r in unique])
    assert sorted(r.doc_id for r in single) == sorted({c for c, _, _ in classes.values()})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single} and len(mixed) > 0.5 * len(single)
    check_packing(packed, corpus_pipeline.packing.SIZES)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_registry_is_complete():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert ngram_join.choose_bands(0.8) == (18, 4)
