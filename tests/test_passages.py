"""Containment by anchors against a plain search, and the map from documents to texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paytrail.operators import passages
from paytrail.plans.cut import cut


@pytest.mark.parametrize("seed", range(3))
def test_containment_against_a_plain_search(spark, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "bc", "cab", "été", "x1", "1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", ", "]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(None, text(40)), (3, text(40)), (99, None), (98, "")]
    asked = []
    for i in range(150):
        body = rng.choice(docs)[1] or "zz"
        a = rng.randrange(len(body) + 1)
        asked.append((i, rng.choice([body[a : a + rng.randint(1, 40)], text(rng.randint(1, 3)), " " + body[a : a + 9]])))
    asked += [(500, None), (501, ""), (502, "  "), (503, asked[0][1])]
    frame = spark.createDataFrame(asked, "item long, passage string")
    got = passages.containment(frame, spark.createDataFrame(docs, "doc long, body string"), "passage", "body", "doc")
    assert got.columns == ["item", "passage", "doc"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    want = [(i, d) for i, p in asked for d, t in docs if p and p.strip() and t is not None and p in t]
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
    assert order([(r.item, r.doc) for r in got.collect()]) == order(want) and len(want) > 100


def test_nothing_to_look_up(spark):
    none = spark.createDataFrame([], "item long, passage string")
    docs = spark.createDataFrame([(1, "text")], "doc long, body string")
    assert passages.containment(none, docs, "passage", "body", "doc").count() == 0
    some = spark.createDataFrame([(1, "no such words in any of the texts here")], none.schema)
    assert passages.containment(some, docs.limit(0), "passage", "body", "doc").count() == 0 == passages.containment(some, docs, "passage", "body", "doc").count()


def _some_texts(spark):
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + " here are some words that texts share") for i in range(50)]
    asked = [(i, docs[i][1][3:90]) for i in range(0, 50, 5)] + [(60, "are some words that texts"), (61, "re some wor"), (62, "x3"), (63, "no such thing is in here at all")]
    want = sorted((i, d) for i, p in asked for d, t in docs if p in t)
    return spark.createDataFrame(asked, "item long, passage string"), spark.createDataFrame(docs, "doc long, body string"), want


def test_few_passages_shuffle_neither_texts_nor_their_grams(spark, monkeypatch):
    asked, docs, want = _some_texts(spark)
    tables = []
    monkeypatch.setattr(passages, "cut", lambda df, label: tables.append(df) or cut(df, label), raising=False)
    got = passages.containment(asked, docs, "passage", "body", "doc")
    assert sorted((r.item, r.doc) for r in got.collect()) == want
    for df in [t for t in tables if t.columns == ["d", "k"]] + [got]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"Exchange hashpartitioning\((\w+)", plan)) <= {"passage", "p"}  # the passages' own join, on what was found


def test_many_passages_find_the_same_by_shuffle(spark, monkeypatch):
    asked, docs, want = _some_texts(spark)
    monkeypatch.setattr(passages, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = passages.containment(asked, docs, "passage", "body", "doc")
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.item, r.doc) for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_longest_passages_are_the_probes(spark):
    rows = [("a", "x" * n) for n in (10, 201, 300, 250)] + [("b", "y" * n) for n in range(1, 9)] + [("b", None)]
    got = passages.probes(spark.createDataFrame(rows, "doc string, passage string"), "doc", "passage")
    assert sorted((r["doc"], len(r["probe"])) for r in got.collect()) == [("a", 201), ("a", 250), ("a", 300)] + [("b", n) for n in (4, 5, 6, 7, 8)]


def test_a_map_that_is_not_one_to_one_names_both_sides(spark):
    texts = [("t1", "Alpha  beta gamma delta. Epsilon zeta eta theta."), ("t2", "iota kappa lambda mu, nu xi omicron pi"), ("t3", "iota kappa lambda mu; rho"), ("t4", "sigma tau upsilon phi chi psi")]
    asked = [("d1", "alpha beta gamma"), ("d2", "EPSILON zeta eta"), ("d3", "iota kappa lambda"), ("d4", "sigma tau upsilon"), ("d4", "phi chi"), ("d5", "nowhere to be found"), ("d6", "nu xi omicron"), ("d6", "iota kappa lambda")]
    got = passages.document_map(spark.createDataFrame(asked, "doc string, p string"), spark.createDataFrame(texts, "name string, t string"), "doc", "p", "name", "t")
    rows = {r.doc: (r.probes, r.name, r.hits, r.winners, r.rival, r.problem) for r in got.collect()}
    assert rows == {
        "d1": (1, "t1", 1, 1, "d2", "not injective"), "d2": (1, "t1", 1, 1, "d1", "not injective"), "d3": (1, "t2", 1, 2, None, "ambiguous"),
        "d4": (2, "t4", 2, 1, None, None), "d5": (1, None, 0, 0, None, "no text"), "d6": (2, "t2", 2, 1, None, None),
    }
    assert passages.normal(F.lit("  A\n b ")) is not None
