"""Hashed terms against a plain computation, the vector cache, and the indicator search with its failures."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paytrail import catalog
from paytrail.operators import embed, retrieval

TEXTS = ["Cash in, cash out.", "cash deposits below the limit", "wires to many, many receivers", "", None, "Été 2024: été"]


def plain(corpus, text, dims):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    n = len(corpus)
    v = np.zeros(dims)
    for w in set(split(text)):
        df = sum(w in split(c) for c in corpus) or 1
        v[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dims] += split(text).count(w) * math.log(1 + n / df)
    return v / (np.linalg.norm(v) or 1)


def test_vectors_against_a_plain_computation(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    encode = embed.HashedTerms(corpus, dims=32)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "unheard words, cash"])] + [(None, "cash")], "id long, text string")
    got = {r.id: r.vector for r in encode(asked).collect()}
    for i, t in enumerate([*TEXTS, "unheard words, cash"]):
        assert np.allclose(got[i], plain(TEXTS, t, 32))
    assert np.allclose(got[None], plain(TEXTS, "cash", 32)) and len(got) == 8


def test_known_texts_are_not_encoded_again(spark, tmp_path):
    seen = []

    def encode(rows):
        seen.append(sorted(r.text for r in rows.collect()))
        return rows.select("id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))

    rows = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "k long, text string")
    one, two = (embed.VectorCache(spark, str(tmp_path / "v"), "lengths", encode) for _ in range(2))
    assert {r.k: r.vector[0] for r in one.vectors(rows("a", "bb", "a", None)).collect()} == {0: 1, 1: 2, 2: 1, 3: 0} and one.encoded == 3
    assert {r.k: r.vector[0] for r in two.vectors(rows("bb", "ccc")).collect()} == {0: 2, 1: 3} and two.encoded == 1
    assert one.vectors(rows("a", "bb", "ccc")).count() == 3 and one.encoded == 0 and seen == [["", "a", "bb"], ["ccc"]]
    # another writer files the same digest a moment later: the newest counts, once
    late = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(), [9.0, 9.0], "lengths")], "digest string, vector array<double>, backend string")
    late.withColumn("cached_at", F.current_timestamp()).write.mode("append").parquet(str(tmp_path / "v"))
    assert [r.vector for r in one.vectors(rows("a")).collect()] == [[9.0, 9.0]]
    other = embed.VectorCache(spark, str(tmp_path / "v"), "other", lambda r: r.select("id", F.array(F.lit(0.0)).alias("vector")))
    assert [r.vector for r in other.vectors(rows("a")).collect()] == [[0.0]] and other.encoded == 1


def test_search_leaves_odd_vectors_out_and_takes_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    rows = [(f"c{i:02d}", v[i].tolist()) for i in range(60)] + [("null", None), ("short", [1.0]), ("hole", [1.0, None, 0.0, 0.0]), ("none", [])]
    frame = spark.createDataFrame(rows, "c string, v array<double>")
    asks = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 60, 5)] + [(99, None), (98, [2.0])], "q long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, r + 1, f"c{j:02d}") for i in range(0, 60, 5) for r, j in enumerate(np.argsort(-(unit @ unit[i]), kind="stable")[:3])}
    for block in (20_000, 5):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        assert {(r.q, r["rank"], r.c) for r in retrieval.search(asks, frame, 3, "q", "c", "v").collect()} == want
    assert retrieval.search(asks, frame.limit(0), 3, "q", "c", "v").count() == 0 == retrieval.search(asks.limit(0), frame, 3, "q", "c", "v").count()


def test_indicators_and_what_they_note(spark):
    chunks = spark.createDataFrame([("a", "cash deposits below the limit", "guide"), ("b", "wires to many receivers", "guide"), ("c", "cash deposits below the limit", "law"), ("d", "deposits", "guide")], "chunk_id string, text string, kind string")
    asked = spark.createDataFrame([(1, "deposits of cash"), (2, "zzz"), (3, "zzz")], "query_id long, text string")
    encode = embed.HashedTerms(chunks, dims=4096)
    found, notes = embed.indicators(asked, chunks, encode, F.col("kind") == "guide", keep=2, hint=spark.createDataFrame([(3, "wires")], asked.schema))
    rows = sorted((r.query_id, r.new_rank, r.chunk_id) for r in found.collect())
    assert rows == [(1, 1, "a"), (1, 2, "d"), (3, 1, "b")] and [tuple(r) for r in notes.collect()] == [(2, embed.EMPTY)]

    def broken(rows):
        return rows.select("id", F.array(F.raise_error(F.lit("no model")).cast("double")).alias("vector"))

    with pytest.warns(UserWarning, match="indicator search failed"):
        found, notes = embed.indicators(asked, chunks, broken)
    assert found.count() == 0 and sorted(r.query_id for r in notes.collect()) == [1, 2, 3]


def test_a_failed_search_is_no_empty_one(spark, monkeypatch):
    """The notes tell them apart, and a query that has no notes to show fails."""
    chunks = spark.createDataFrame([("a", "cash")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "zzz")], "query_id long, text string")
    plain_encoder = embed.HashedTerms(chunks, dims=16)

    def broken(rows):
        return rows.select("id", F.array(F.raise_error(F.lit("no model")).cast("double")).alias("vector"))

    assert [r.code for r in embed.indicators(asked, chunks.where("false"), plain_encoder)[1].collect()] == [embed.EMPTY]
    with pytest.warns(UserWarning, match="indicator search failed"):
        assert [r.code for r in embed.indicators(asked, chunks, broken)[1].collect()] == [embed.FAILED]
    with pytest.raises(Exception, match="no model"):
        embed.indicators(asked, chunks, broken, degrade=False)
    monkeypatch.setattr(embed.HashedTerms, "__call__", lambda self, rows: broken(rows))
    with pytest.raises(Exception, match="no model"):
        catalog.queries()["indicator_search"](spark, "/root/testdata/sf0.001")


def test_a_tie_of_rounded_scores_goes_to_the_smaller_key(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e-6]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "k long, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "q long, v array<double>")
    assert [r["k"] for r in retrieval.search(asked, rows, 1, "q", "k", "v").collect()] == [1]


def test_search_by_a_few_scores_at_a_time(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "k long, v array<double>").coalesce(1)
    asked = rows.withColumnRenamed("k", "q")
    want = sorted(map(tuple, retrieval.search(asked, rows, 3, "q", "k", "v", own=True).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 100)
    got = sorted(map(tuple, retrieval.search(asked, rows, 3, "q", "k", "v", own=True).collect()))
    assert len(want) == 120 and [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)
