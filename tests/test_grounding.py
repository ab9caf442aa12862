"""Replies that must keep to a schema, payloads that are cut down, filter documents and curated keys."""

import json

import pytest
from pyspark.sql import functions as F

from paytrail.operators import grounding, retrieval


def test_replies_are_read_or_refused(spark):
    good = '{"narrative": "n", "risk_level": "high", "cited": ["a"]}'
    cases = {good: None, "prose": "not an object of the schema", "[]": "no narrative", '{"risk_level": "low", "cited": []}': "no narrative", '{"narrative": "n", "risk_level": "dire", "cited": []}': "no such risk level",
             '{"narrative": "n", "cited": []}': "no such risk level", '{"narrative": "n", "risk_level": "low"}': "no list of citations", '{"narrative": "n", "risk_level": "low", "cited": [null]}': "no list of citations", None: "no reply",
             '{"narrative": "n", "risk_level": "low", "cited": "a"}': "not an object of the schema"}
    draft, why = grounding.read_reply(F.col("r"))
    got = {r.r: (r.d, r.w) for r in spark.createDataFrame([(k,) for k in cases], "r string").select("r", draft.alias("d"), why.alias("w")).collect()}
    for reply, reason in cases.items():
        assert (got[reply][1] is None) == (reason is None) and (got[reply][0] is None) == (reason is not None), reply
        assert reply == "[]" or got[reply][1] == reason
    assert got[good][0].asDict() == {"narrative": "n", "risk_level": "high", "cited": ["a"]}


def test_only_refused_rows_are_drafted_again(spark):
    asked = []

    def draft(rows, attempt):
        asked.append(sorted((r.k, r.error) for r in rows.collect()))
        good = F.concat(F.lit('{"narrative": "'), F.coalesce("error", F.lit("first")), F.lit('", "risk_level": "low", "cited": []}'))
        return rows.withColumn("reply", F.when(F.col("k") < attempt, good).otherwise("no"))

    rows = spark.range(5).select(F.col("id").alias("k"))
    got = {r.k: (r.narrative, r.attempts, r.note) for r in grounding.ground(rows, draft).collect()}
    bad = "not an object of the schema"
    assert got == {0: ("first", 1, None), 1: (bad, 2, None), 2: (bad, 3, None), 3: (None, 3, f"{grounding.FAILED}: {bad}"), 4: (None, 3, f"{grounding.FAILED}: {bad}")}
    assert asked == [[(k, None) for k in range(5)], [(k, bad) for k in range(1, 5)], [(k, bad) for k in range(2, 5)]]
    assert grounding.ground(rows.limit(0), draft).count() == 0 and len(asked) == 4


def test_payloads_are_cut_down_at_any_depth(spark):
    deep = json.loads("[" * 60 + '{"Wires": [1, 2]}' + "]" * 60)
    payloads = [{"a": list(range(30)), "records": [{"x": 1}] * 40, "batch_graph": {"n": 1}, "b": {"c": [[0] * 26], "transactions": "none"}}, deep, list(range(25)), "text", 3.5, None]
    rows = [(i, json.dumps(p), "kept") for i, p in enumerate(payloads)] + [(98, "{broken", "kept"), (99, None, None), (97, "[" * 100_000, "kept")]
    got = {r.k: r.p for r in grounding.trimmed(spark.createDataFrame(rows, "k long, p string, other string"), "p").collect()}
    assert json.loads(got[0]) == {"a": [*range(25), "5 more left out"], "records": "[40 entries left out of the trace]", "batch_graph": "[left out of the trace]", "b": {"c": [[0] * 25 + ["1 more left out"]], "transactions": "none"}}
    assert got[1] == "[" * 60 + '{"Wires":"[2 entries left out of the trace]"}' + "]" * 60
    assert [json.loads(got[k]) for k in (2, 3, 4, 5)] == payloads[2:] and got[99] is None
    assert got[98] == got[97] == '"[unreadable payload left out]"'


def test_filter_documents(spark, tmp_path):
    spark.createDataFrame([(1, "en", "law"), (2, "de", "guide"), (3, "fr", None), (4, "en", "guide")], "k long, lang string, tier string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    ids = lambda d: sorted(r.k for r in rows.where(retrieval.where(d)).collect())
    assert ids({}) == ids({"$and": []}) == [1, 2, 3, 4] and ids({"$or": []}) == ids({"lang": {"$in": []}}) == []
    assert ids({"lang": "en", "tier": "guide"}) == [4] and ids({"tier": None}) == [3] and ids({"tier": {"$ne": None}}) == [1, 2, 4]
    nested = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"$or": [{"tier": "law"}, {"k": {"$gte": 2, "$lt": 4}}]}, {"$not": {"k": 1}}]}
    assert ids(nested) == [2]
    plan = rows.where(retrieval.where(nested))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(lang, [de,en])" in pushed or "In(lang, [en,de])" in pushed
    for bad in ({"$nor": []}, {"k": {"$regex": "x"}}):
        with pytest.raises(ValueError):
            retrieval.where(bad)


def test_obligations_once_and_their_notes(spark):
    curated = spark.createDataFrame([("p", "s1", "a"), ("p", "s1", "b"), ("p", "s9", "x"), ("q", "s9", "y"), ("r", None, None), ("t", "s1", "a")], "pattern_type string, source_id string, section_ref string")
    chunks = spark.createDataFrame([("s1", "a", "c1"), ("s1", "b", "c1"), ("s1", "a", "c2")], "source_id string, section_ref string, chunk_id string")
    hits, notes = retrieval.obligations(curated, chunks)
    assert sorted(map(tuple, hits.collect())) == [("p", "c1"), ("t", "c1")]
    assert sorted(map(tuple, notes.collect())) == [("p", 1, None), ("q", 1, "OBLIGATION_MAP_MISS"), ("r", 0, "OBLIGATION_MAP_MISS")]
