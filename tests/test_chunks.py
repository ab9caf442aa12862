"""Texts taken apart: known answers, and chunks against a plain loop."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paytrail.functions import chunks, text


def of(spark, column, *texts):
    """The expression's value for each text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", column.alias("x"))
    return [r.x for r in sorted(rows.collect(), key=lambda r: r.k)]


def test_sentences(spark):
    got = of(spark, chunks.sentence_list(F.col("t")), "See Art. 5 of it. Then No. 8.3.1 applies. (a) It ends.\n(b) Next one", 'He said "go." Then (e.g. Mr. X) left!? “Yes.” J. Smith [cf. Fig. 2] stayed.', "one\n\n  two  \nthree", "", " \n ", None)
    assert got == [
        ["See Art. 5 of it.", "Then No. 8.3.1 applies.", "(a) It ends.", "(b) Next one"],
        ['He said "go."', "Then (e.g. Mr. X) left!?", "“Yes.” J. Smith [cf. Fig. 2] stayed."],
        ["one", "two", "three"], [], [], None,
    ]


def test_wrapping_and_tables(spark):
    assert of(spark, chunks.wrap_list(F.col("t"), 10), "aa bb  cc dd ee", "a" * 12 + " b", "", "  ") == [["aa bb cc", "dd ee"], ["a" * 12, "b"], [], []]
    table = "Intro\n/Table Start\nTerm\tMeaning\n" + "\n".join(f"t{i}\t{'m' * 50}" for i in range(100)) + "\n/Table End"
    parts, small, bare = of(spark, chunks.table_list(F.col("t"), 500), table, "/Table Start\nA\tB\n\t\n1\t2\n/Table End", "/Table Start\nA\n/Table End tail")
    assert parts[0] == "Intro" and all(p.startswith("Term | Meaning\n") and len(p) <= 500 for p in parts[1:]) and sum(p.count("\n") for p in parts[1:]) == 100
    assert small == ["A | B\n1 | 2"] and bare == []


def plain_chunks(body, least, most):
    """Sentences of one line each, put together one by one."""
    parts = body.split("\n")
    v = np.zeros((len(parts), 64))
    for i, s in enumerate(parts):
        for h in (zlib.crc32(w.encode()) for w in s.lower().split()):
            v[i, h % 64] += 1 if h >> 16 & 1 else -1
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    away = 1 - (v[:-1] * v[1:]).sum(axis=1)
    cut = set(np.flatnonzero(away > np.quantile(away, text.PERCENTILE)) + 1) if len(parts) >= text.MIN_SENTENCES else set()
    out = [parts[0]]
    for i, s in enumerate(parts[1:], 1):
        if len(out[-1]) + 1 + len(s) > most or (i in cut and len(out[-1]) >= least):
            out.append(s)
        else:
            out[-1] += " " + s
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + 1 + len(out[-1]) <= most:
        out[-2:] = [" ".join(out[-2:])]
    return out


def test_chunks(spark):
    body = " ".join(f"Sentence number {i} is about {'cats' if i < 40 else 'bonds'}." for i in range(90))
    lines = ["\n".join(f"line {i * k % 37} of {k} {'x' * (i % 9)} {i % (k + 3)}" for i in range(60 + k)) for k in range(1, 8)]
    texts = [body, "word " * 900, "", "short", None, *lines]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, t string, s string")
    got: dict = {}
    for r in chunks.chunk(frame, "k", "t", most=800, least=100).orderBy("k", "ordinal").collect():
        got.setdefault(r.k, []).append(r.piece)
    assert " ".join(got[0]) == body and len(got[0]) > 1 and all(len(c) <= 800 for c in got[0])
    assert got[1][0].count("word") == 160 and sum(c.count("word") for c in got[1]) == 900 and got[3] == ["short"] and 2 not in got and 4 not in got
    for k, t in enumerate(lines, 5):
        assert got[k] == plain_chunks(t, 100, 800), k
    # an encoder that sees no difference makes no boundary
    flat = chunks.chunk(frame, "k", "t", lambda rows: rows.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), 100, 800)
    assert all(r.n >= 700 for r in flat.where("k = 0 and ordinal < 4").select(F.length("piece").alias("n")).collect())
    assert chunks.chunk(frame.limit(0), "k", "t").count() == 0


def test_sections_follow_the_deepest_label(spark):
    body = "\n\n".join(["(a) One", "(1) Two", "(i) Three", "(ii) Four", "more", "(2) Five", "(b) Six", "(A) Up", "(B) Up", "(c) Down", "(aa) long"])
    got, plain, none = of(spark, chunks.section_list(F.col("t"), F.lit("§ 1")), body, "no label\n\nat all", "")
    refs = ["(a)", "(a)(1)", "(a)(1)(i)", "(a)(1)(ii)", "(a)(2)", "(b)", "(b)(A)", "(b)(B)", "(c)", "(c)(aa)"]
    assert [r["ref"] for r in got] == [f"§ 1{r}" for r in refs] and got[3]["text"] == "(ii) Four\nmore"
    assert [tuple(r) for r in plain] == [("§ 1", "no label\nat all")] and none == []


@pytest.mark.parametrize(
    "body,items,prose",
    [
        ("Red Flags\n• First thing\ncontinues here.\nPlain prose follows.\n• Second\nPage 1 of 2\nPage 2 of 2", [("Red Flags ¶ 1", "First thing continues here."), ("Red Flags ¶ 2", "Second")], "Red Flags\nPlain prose follows."),
        ("• a\nb\nc.\nd\n\nTitle Two\n- x;\ny\n* z", [("Guidance ¶ 1", "a b c."), ("Title Two ¶ 1", "x;"), ("Title Two ¶ 2", "z")], "d\nTitle Two\ny"),
        ("plain, only", [], "plain, only"),
    ],
)
def test_guidance(spark, body, items, prose):
    found, around = chunks.guidance(spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, t string"), "k", "t")
    assert [(r.section_ref, r.text) for r in found.orderBy("k", "ln").collect()] == items and [r.text for r in around.collect()] == [prose]


def test_texts_are_made_once(spark, monkeypatch):
    """A filter on a normalised text would normalise it again, Python step included."""
    plans, real = [], chunks.cut
    monkeypatch.setattr(chunks, "cut", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    docs = spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id long, text string").withColumn("text", text.normalize(F.col("text")))
    assert [tuple(r) for r in chunks.chunk(docs, "doc_id").collect()] == [(1, 0, "One. Two.")]
    assert plans[0].count("ArrowEvalPython") == 1
