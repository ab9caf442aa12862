import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paytrail.llm import ann, components, exact_dedup, ngram_join, sharding

SCHEMA = "doc_id long, text string, rep string, shard string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "a", "b", "c") for k, t in rows], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: b * 3), max_size=30))
def test_radix_groups_are_the_equal_values(values):
    got = sorted(sorted(g) for g in exact_dedup.radix_groups(values))
    want = {}
    for i, v in enumerate(values):
        want.setdefault(v, []).append(i)
    assert got == sorted(want.values())


@pytest.mark.parametrize("leaf,buffer", [(1 << 20, 1 << 20), (200, 100), (1, 1)])
def test_exact_dedup_against_brute_force(spark, leaf, buffer):
    import hashlib

    rng = random.Random(leaf)
    base = ["", "same start " * 40 + "x", "same start " * 40 + "y", "same start " * 40, "Ä\x00", "Ä"] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(1000, None), (None, "gone")] + [(2000 + i, "hot text") for i in range(150)]
    out = {r.doc_id: r for r in exact_dedup.equal_groups(docs(spark, rows), leaf_bytes=leaf, buffer_bytes=buffer).collect()}
    groups = {}
    for k, t in rows:
        if k is not None:
            groups.setdefault(t or "", []).append(k)
    assert len(out) == len(rows) - 1
    for t, ids in groups.items():
        for k in ids:
            assert (out[k].keep_id, out[k].group_size, out[k].kept, out[k].text_sha256) == (max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.equal_groups(docs(spark, [])).count() == 0
    kept = exact_dedup.drop_duplicates(docs(spark, [(1, "a"), (2, "a"), (3, "b")])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3] and len(kept[0]) == 5


def test_shards_follow_the_key_law(spark):
    rows = [(i, "x" * (i % 7)) for i in range(4000)] + [(None, None), (5, None)]
    out = sharding.shard_documents(docs(spark, rows), [1.0] * 8, block_rows=100).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(docs(spark, rows), [1.0] * 9).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in out)
    moved = sum(r.grown_shard == 8 for r in out) / len(out)
    assert abs(moved - 1 / 9) < 0.03
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 3} == {(19, zlib.crc32(b"xxx"))}
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(16, 0)}


def test_shard_weights(spark):
    out = sharding.shard_documents(docs(spark, [(i, "") for i in range(6000)]), [1, 2, 0, 3]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 6000 for r in out}
    assert set(share) == {0, 1, 3} and abs(share[3] - 0.5) < 0.03 and abs(share[0] - 1 / 6) < 0.03
    with pytest.raises(ValueError):
        sharding.shard_documents(docs(spark, []), [])
    assert sharding.shard_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("one_task", [1_000_000, 5])
def test_components_against_union_find(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), one_task).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40), st.integers(2, 9))
def test_forests_of_a_task_join_what_its_edges_join(edges, held):
    edges = [(a, b) for a, b in edges if a != b]

    def roots(pairs):
        root = {x: x for e in pairs for x in e}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    batches = [pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges[i : i + 5]], pa.int64()) for k in (0, 1)], names=["a", "b"]) for i in range(0, len(edges), 5)]
    kept = [e for b in components._forests(iter(batches), held) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert roots(kept) == roots(edges) and len(kept) <= len(edges)


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95, 1.0):
        b, r = ngram_join.choose_bands(t)
        assert b * r <= 96 and (1 - (1 - t**r) ** b >= 0.9999 or r == 1)


def brute_links(rows, n=5, t=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= t * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[q] = p
    return {rows[i][0]: (rows[find(i)][0], links[i], len(sets[i])) for i in range(len(rows))}


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_ngram_join_against_brute_force(spark, block):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(60)] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "two words"), (4, "Two  words"), (5, "other")]
    for i in range(60):
        own = list(base[i % 6])
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(60)] = word()
        rows.append((10 + i, " ".join(own)))
    rows += [(200 + i, " ".join(base[0])) for i in range(15)] + [(300, "long " + " ".join(word() for _ in range(20_000)))]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_grams) for r in ngram_join.near_classes(docs(spark, rows), block_grams=block).collect()}
    assert got == brute_links(rows)


def test_ngram_join_edge_tables(spark):
    out = ngram_join.near_classes(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)])).collect()
    by = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.set_size) for r in out)
    assert by == [("1", "1", 1, 2), ("1", "1", 1, 2), ("2", "2", 0, 1), ("None", "None", 0, 1)]
    assert ngram_join.near_classes(docs(spark, [])).count() == 0
    kept = ngram_join.keep_one(docs(spark, [(4, "a b c d e f g"), (2, "A b c d e f g"), (9, "z")])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 9]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, tree string")


def test_nearest_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    data = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)
    data[:40] = data[0]
    rows = [(i, v.tolist(), 0, "t") for i, v in enumerate(data)]
    bad = [(3001, None, 0, "t"), (3100, [0.0] * 16, 0, "t"), (3200, [float("nan")] + [1.0] * 15, 0, "t"), (3300, [None] + [1.0] * 15, 0, "t"), (3400, [1.0], 0, "t"), (None, [1.0] * 16, 0, "t"), (5, data[5].tolist(), 0, "t")]
    df = vectors(spark, rows + bad)
    out = ann.nearest(df, F.col("vec_id") % 100 == 0, trees=6, leaf_rows=32, search_rows=600, block_rows=64).collect()
    full = data.astype(np.float64)
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(3000), d))
        want = order[order != q][:10].tolist()
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-9 for _, v, s in own) and own == sorted(own, key=lambda r: (r[2], r[1]))
        hit += len(set(want) & {r[1] for r in own})
        total += 10
        if q == 0:
            assert [r[1] for r in own] == list(range(1, 11))
    assert hit / total >= 0.9 and {r.query_id for r in out} == set(range(0, 3000, 100))


@pytest.mark.parametrize("spread", [0.25, None])
def test_shipped_settings_reach_the_recall(spark, tmp_path, spread):
    """On clustered vectors and on even ones, well above the number below which all are searched."""
    import pyarrow.parquet as pq

    n, dims, rng = 24_000, 24, np.random.default_rng(4)
    data = rng.standard_normal((n, dims))
    if spread:
        data = rng.standard_normal((60, dims))[rng.integers(0, 60, n)] + spread * data
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(data.astype(np.float32)), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    out = ann.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 100 == 0).toPandas()
    full, hit = data.astype(np.float32).astype(np.float64), 0
    for q, own in out.groupby("query_id"):
        d = ((full - full[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argpartition(d, 10)[:10].tolist()) & set(own.vec_id))
    assert len(out) == n // 10 and hit / len(out) >= 0.9


def test_ids_that_repeat_with_other_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, "t"), (0, [0.0, 1.0], 0, "t"), (1, [0.9, 0.1], 0, "t"), (1, [0.1, 0.9], 0, "t"), (2, [5.0, 5.0], 0, "t")]
    out = ann.nearest(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(out)] == [(1, 1), (2, 2)]


def test_nearest_neighbours_of_small_tables(spark):
    few = ann.nearest(vectors(spark, [(0, [1.0, 0.0], 0, "t"), (1, [0.0, 1.0], 0, "t"), (2, [1.0, 1.0], 0, "t")]), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few)] == [(1, 2), (2, 1)]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("leaf,buffer", [(None, 8 << 20), (200, 100), (1, 1)])
def test_exact_dedup_of_repeated_rows(spark, leaf, buffer):
    rows = [(7, "the same row")] * 12 + [(8, "kept for this text"), (8, "lost here"), (9, "lost here")]
    df = docs(spark, rows).repartition(3)
    out = exact_dedup.equal_groups(df, leaf_bytes=leaf, buffer_bytes=buffer).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(7, 7, 12)] * 12 + [(8, 8, 1), (8, 9, 2), (9, 9, 2)]
    assert sorted(r.doc_id for r in out if r.kept) == [7, 8, 9]
    kept = exact_dedup.drop_duplicates(df, leaf_bytes=leaf, buffer_bytes=buffer)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text, r.n) for r in kept.collect()) == [(7, "the same row", "c"), (8, "kept for this text", "c"), (9, "lost here", "c")]


def test_ngram_join_keeps_one_of_repeated_rows(spark):
    rows = [(4, "a b c d e f g")] * 3 + [(4, "quite another text of the same key here"), (2, "A b c d e f g"), (9, None), (9, None)]
    kept = ngram_join.keep_one(docs(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(2, "A b c d e f g"), (4, "quite another text of the same key here"), (9, ""), (9, "")]


def test_rows_without_a_key_stay(spark, monkeypatch):
    from paytrail.llm import registry

    rows = [(None, "only here"), (None, "twice, without a key"), (None, "twice, without a key"), (None, "with a key too"), (-5, "with a key too"), (None, None)]
    df = docs(spark, rows).repartition(3)
    monkeypatch.setattr(registry, "table", lambda *_: df)
    out = registry.op8_exact_dedup(spark, "").collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(-5, -5, 2, True), (0, -5, 2, False), (0, 0, 1, True), (0, 0, 1, True), (0, 0, 2, False), (0, 0, 2, True)]
    kept = exact_dedup.drop_duplicates(df)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(-5, "with a key too"), (0, ""), (0, "only here"), (0, "twice, without a key")]
    near = [(None, "a b c d e f g"), (3, "A b c d e f g"), (None, "other words"), (None, "Other words"), (None, "clean")]
    got = ngram_join.keep_one(docs(spark, near).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == [(0, "clean"), (0, "other words"), (3, "a b c d e f g")]
