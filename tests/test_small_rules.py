"""Small rules that no query shows at their edges."""

from pyspark.sql import functions as F

from paytrail.functions import redact, text
from paytrail.operators import detectors, evaluate, graph
from paytrail.plans.params import Params

from .test_detectors import edges


def test_banners(spark):
    rows = spark.createDataFrame([("# a\n# b\n\n body\n# kept", "body\n# kept"), ("body", "body"), ("# only", "# only"), ("", ""), (None, None)], "t string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", text.strip_banner(F.col("t"))).collect())


def test_identifiers(spark):
    rows = [("a@b.co", True), ("GB29NWBK60161331926819", True), ("account 12345678", True), ("room 1234", False), ("on 2024-01-05", False), ("95000.00", False), ("", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", redact.has_identifier(F.col("t"))).collect()
    assert [r.t for r in got if r.got != r.want] == []


def test_evidence_lines_and_dot(spark):
    e = edges(spark, [("a", "b", 10, 0), ("b", "c", 9.5, 1), ("c", "a", 9, 2)])
    found = spark.createDataFrame([("x", ["T0002", "T0000", "T0001", "gone"]), ("y", ["gone"])], "candidate_id string, refs array<string>")
    shown = graph.subgraph(e, found)
    lines = {r.candidate_id: r.lines for r in graph.edge_lines(shown, 2).collect()}
    assert lines == {"x": "T0000: a -> b 10.00 (wire)\nT0001: b -> c 9.50 (wire)\nand 1 more"}
    assert "more" not in graph.edge_lines(shown, 3).first().lines
    assert graph.to_dot(shown).first().dot == 'digraph candidate {\n  "a" -> "b" [label="10.00"];\n  "b" -> "c" [label="9.50"];\n  "c" -> "a" [label="9.00"];\n}'
    assert shown.first().nodes == ["a", "b", "c"]


def test_only_the_best_connected_senders_are_paired(spark):
    legs = [(f"s{i}", f"r{j}", 10, 1) for i in range(4) for j in range(3)] + [(f"s{i}", f"own{i}{k}", 10, 1) for i in (1, 3) for k in range(2)]
    pairs = lambda most: {(r.a, r.b) for r in detectors.sender_pairs(edges(spark, legs), Params(max_block_senders=most))[1].collect()}
    assert len(pairs(None)) == 6 and pairs(2) == {("s1", "s3")} and pairs(3) == {("s0", "s1"), ("s0", "s3"), ("s1", "s3")}
    assert pairs(1) == set()


def test_recall_and_its_weakest_shape(spark):
    labels = spark.createDataFrame([(i, s, f"t{k}") for i, s, ks in (("c1", "cycle", (1, 2, 3)), ("c2", "cycle", (4, 5)), ("f1", "fan_in", (6, 7)), ("b1", "block", (8,))) for k in ks], "instance string, shape string, txn_ref string")
    found = spark.createDataFrame([("x", "cycle", ["t1", "t2"]), ("y", "fan_out", ["t6", "t4"]), ("z", "cycle", ["t99"])], "candidate_id string, pattern_type string, refs array<string>")
    recalled = evaluate.recall(found, labels)
    assert {tuple(r) for r in recalled.collect()} == {("cycle", 2, 2, 1), ("fan_in", 1, 1, 0), ("block", 1, 0, 0)}
    assert tuple(evaluate.summary(recalled).first()) == (4, 0.75, 0.25, "block", 0.0)


def test_draws_take_batches_in_turn(spark):
    rows = spark.createDataFrame([("k", b, i) for b, n in (("x", 5), ("y", 1), ("z", 2)) for i in range(n)] + [("other", "x", 9)], "k string, b string, i int")
    got = sorted((r.k, r.place, r.b, r.i) for r in evaluate.round_robin_batches(rows, "k", "b", ["i"], 5).collect())
    assert got == [("k", 1, "x", 0), ("k", 2, "y", 0), ("k", 3, "z", 0), ("k", 4, "x", 1), ("k", 5, "z", 1), ("other", 1, "x", 9)]
