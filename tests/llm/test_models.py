import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paytrail.llm import labelled, mixing, networks, quality, toxicity, word_vectors

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijkl") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def text(n, bad=False, toxic=False):
    own = [RNG.choice(WORDS) for _ in range(n)]
    if bad:
        own = [w.upper() + "!!" for w in own]
    if toxic:
        own[RNG.randrange(n)] = RNG.choice(["idiot", "scumbag", "moron"])
    return " ".join(own)


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for i in range(500):
        bad, toxic = RNG.random() < 0.3, RNG.random() < 0.3
        rows.append((i, text(RNG.randint(8, 120), bad, toxic), "x", "y"))
        labels.append((i, int(not bad), int(toxic), "extra"))
    rows += [(1000, None, "x", "y"), (1001, "", "x", "y"), (1002, text(30_000), "x", "y"), (None, text(9), "x", "y"), (3, rows[3][1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, tokens string")
    return docs, spark.createDataFrame(labels + [(7000, 1, 0, "e"), (None, 1, 0, "e"), (9, None, 0, "e")], "doc_id long, quality int, toxic int, text string"), {r[0]: r for r in labels}


def test_fold_is_crc32_of_the_key(spark):
    import zlib

    got = {r.k: r.f for r in spark.createDataFrame([(i,) for i in range(50)], "k long").withColumn("f", labelled.fold("k")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_sample_leaves_out_the_held_out_fold_and_is_bounded(spark, tables):
    docs, labels, _ = tables
    some = labelled.labelled_texts(docs, labels, ["quality"], rows=50).collect()
    assert 0 < len(some) <= 50 and all(r["fold"] != 0 for r in some)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, tables, kind):
    docs, labels, truth = tables
    if kind == "quality":
        out = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    else:
        out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 505 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id][1 if kind == "quality" else 2] for r in held]
    assert len(held) > 50 and sum(right) / len(right) >= 0.93
    assert all(r.predicted == int(r.score >= (0.3 if kind == "quality" else 0.5)) for r in out)


def test_models_without_labels_or_rows(spark, tables):
    docs, labels, _ = tables
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, none)).collect()}) == 1
    assert quality.score_quality(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_windows_cover_every_word_and_overlap():
    for n in (1, 5, 39, 40, 41, 60, 61, 1000):
        own = toxicity.window_starts(n)
        seen = {i for s in own for i in range(s, min(s + toxicity.WINDOW, n))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STEP for a, b in zip(own, own[1:]))


def test_gradients_of_the_recurrent_network():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, at, w = rng.standard_normal((9, 16)), rng.integers(0, 9, (3, 6)), np.array([0.3, -0.7, 1.1])
    at[0, 4:] = 8  # padding
    tape = {}
    net.forward(x, at, tape)
    g, dx = net.backward(x, at, tape, w)
    for k in net.p:
        i = tuple(s // 2 for s in net.p[k].shape)
        old, est = net.p[k][i], []
        for e in (1e-3, -1e-3):
            net.p[k][i] = old + e
            est.append(float((net.forward(x, at) * w).sum()))
        net.p[k][i] = old
        assert (est[0] - est[1]) / 2e-3 == pytest.approx(float(g[k][i]), abs=2e-4)


def test_a_text_scores_as_its_worst_window():
    net = toxicity.Network()
    words = [RNG.choice(WORDS) for _ in range(130)]
    whole = net.logits(pa.array([" ".join(words), ""]))
    parts = [net.logits(pa.array([" ".join(words[s : s + toxicity.WINDOW])]))[0] for s in toxicity.window_starts(130)]
    assert whole[0] == pytest.approx(max(parts), abs=1e-5) and np.isneginf(whole[1])


def test_mixing_meets_its_targets(spark, tables):
    docs, labels, _ = tables
    targets = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    rows = mixing.mix(docs, labels, targets).collect()
    assert len(rows) == 505
    tokens = np.array([r.tokens for r in rows])
    p = np.array([[r.p_good, r.p_low, r.p_toxic] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert (rate >= 0).all() and (rate <= 4).all()
    reached = (rate * tokens) @ p
    assert np.abs(reached / tokens.sum() - np.array([0.7, 0.2, 0.1])).max() < 0.01
    assert all(r.copies in (int(np.floor(r.rate)), int(np.floor(r.rate)) + 1) for r in rows)
    again = mixing.resample(docs, labels, targets)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rows)


def test_rates_against_a_plain_solver(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    t = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, posterior array<double>")
    goal = np.array([0.5, 0.3, 0.2])
    start, steps, pulls, reached = mixing.fit_rates(df, goal, tolerance=1e-9)
    w, weigh = t / t.sum(), np.linalg.inv(np.einsum("i,ij,ik->jk", t / t.sum(), p, p)) + mixing.WHOLE
    value = lambda q: ((q * w) @ p - goal) @ weigh @ ((q * w) @ p - goal) / 2 + mixing.RIDGE * w @ np.square(q - 1) / 2
    q = np.ones(200)
    for _ in range(100_000):  # plain projected gradient of the same sum, to its end
        q = np.maximum(0, q - (p @ (weigh @ ((q * w) @ p - goal)) + mixing.RIDGE * (q - 1)) / (1 + mixing.WHOLE))
    rate = mixing.replay(p, start, steps, pulls)
    assert start == 1 and (rate >= 0).all() and value(rate) <= value(q) * 1.01 + 1e-9
    assert np.allclose((rate * t) @ p, reached) and np.abs(reached / t.sum() - goal).max() <= 1e-4
    spread = mixing.concentration(df, 3, start, steps, pulls)
    own = t * rate
    assert spread["most"] == pytest.approx(rate.max()) and spread["zero"] == pytest.approx((rate == 0).mean())
    assert spread["effective"] == pytest.approx((own.sum() ** 2 / np.square(own).sum()) / (t.sum() ** 2 / np.square(t).sum()))


def test_a_target_that_few_documents_could_serve_is_reported(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    with pytest.warns(UserWarning) as said:
        rows = mixing.mix(docs, labels).collect()
    rate, tokens = np.array([r.rate for r in rows]), np.array([r.tokens for r in rows])
    assert any("mixing: no rates meet the targets" in str(w.message) for w in said)
    own = (rate * tokens).sum() ** 2 / np.square(rate * tokens).sum() / (tokens.sum() ** 2 / np.square(tokens).sum())
    assert all(r.effective == pytest.approx(own) for r in rows)
    assert own >= mixing.CONCENTRATED or any("of the documents in effect" in str(w.message) for w in said)
    print("MIX", len(rows), (rate == 0).mean(), rate.max(), own, [rows[0][f"off_{x}"] for x in mixing.DOMAINS])


def test_rates_of_a_rare_domain_meet_its_target(spark):
    rng = np.random.default_rng(8)
    p = np.vstack([rng.dirichlet([8.0, 0.01, 0.2], 995), rng.dirichlet([0.2, 8.0, 0.2], 5)])
    t = rng.integers(20, 300, 1000)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, posterior array<double>")
    goal = np.array([0.85, 0.12, 0.03])
    start, steps, pulls, reached = mixing.fit_rates(df, goal)
    rate = mixing.replay(p, start, steps, pulls, np.inf)
    assert (rate >= 0).all() and rate.max() > 4
    assert np.allclose((rate * t) @ p, reached) and np.abs(reached / t.sum() - goal).max() <= 1e-4


def test_mixing_reports_a_target_that_cannot_be_met(spark, tables):
    docs, labels, _ = tables
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        rows = mixing.mix(docs.limit(50), labels.limit(0), {"good": 0.9, "low": 0.1, "toxic": 0.0}).collect()
    assert all(r.off_good < -0.3 and r.off_toxic > 0.3 for r in rows)
    own = mixing.mix(docs, labels, {"good": 0.8, "low": None, "toxic": 0.2}).collect()
    tokens, rate = np.array([r.tokens for r in own]), np.array([r.rate for r in own])
    p = np.array([[r.p_good, r.p_low, r.p_toxic] for r in own])
    low = (tokens @ p)[1] / tokens.sum()
    assert np.abs((rate * tokens) @ p / tokens.sum() - np.array([0.8 * (1 - low), low, 0.2 * (1 - low)])).max() <= 2e-4
    assert max(abs(x) for r in own for x in (r.off_good, r.off_low, r.off_toxic)) <= 1e-4


def test_gated_documents_reach_the_targets_of_the_mixing_stage(spark, tables, monkeypatch):
    import corpus_pipeline

    docs, labels, _ = tables
    seen, whole = [], mixing.mix
    monkeypatch.setattr(corpus_pipeline.registry, "table", lambda *_: labels)
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    gated = quality.keep_good(docs, quality.fit(docs, labels))
    corpus_pipeline.mixing_stage(spark, gated, "")
    rows = [r.asDict() for r in seen[0].collect()]
    n = sum(r["__mix_tokens"] for r in rows)
    good, low, toxic = (sum(r["__mix_rate"] * r["__mix_tokens"] * r[f"__mix_p_{x}"] for r in rows) / n for x in mixing.DOMAINS)
    assert abs(good + low + toxic - 1) < 3e-4 and abs(good / toxic - 31) < 0.5 and low < 0.04
    assert all(abs(r[f"__mix_off_{x}"]) <= 1e-4 for r in rows for x in mixing.DOMAINS)


def test_sample_passes_over_long_texts_and_labels_without_a_document(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 10 == 3 else 10)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    whole = labelled.labelled_texts(docs, labels, ["quality"], rows=100).collect()
    short = labelled.labelled_texts(docs, labels, ["quality"], rows=100, chars=1000).collect()
    assert len(whole) > 60 and len(short) == sum(len(r["text"]) == 10 for r in whole)


def test_network_equals_a_plain_restatement():
    """The recurrent network with attention, word by word and unit by unit."""
    net, texts = toxicity.Network(), ["One two, three!", " ".join(RNG.choice(WORDS) for _ in range(30))]
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for text in texts:
        xs = []
        for word in text.split():
            bucket, grams, _ = toxicity.word_features(pa.array([word]))
            chars = [sum(float(net.gram[g, k]) for g in grams) / max(len(grams), 1) for k in range(toxicity.PART)]
            xs.append([float(v) for v in net.word[bucket[0]]] + chars)
        states = {}
        for d in "fb":
            h, out = [0.0] * toxicity.UNITS, []
            w, u, c, n = net.p[f"w{d}"], net.p[f"u{d}"], net.p[f"c{d}"], toxicity.UNITS
            for x in xs if d == "f" else xs[::-1]:
                a = [sum(x[i] * w[i, j] for i in range(len(x))) + c[j] for j in range(3 * n)]
                b = [sum(h[i] * u[i, j] for i in range(n)) for j in range(3 * n)]
                keep = [sigmoid(a[j] + b[j]) for j in range(n)]
                new = [math.tanh(a[2 * n + j] + sigmoid(a[n + j] + b[n + j]) * b[2 * n + j]) for j in range(n)]
                h = [keep[j] * h[j] + (1 - keep[j]) * new[j] for j in range(n)]
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        both = [f + b for f, b in zip(states["f"], states["b"])]
        attend = [sum(net.p["va"][k] * math.tanh(sum(h[i] * net.p["wa"][i, k] for i in range(len(h))) + net.p["ba"][k]) for k in range(toxicity.ATTEND)) for h in both]
        share = [math.exp(s) / sum(map(math.exp, attend)) for s in attend]
        want = sum(e * sum(h[i] * net.p["wo"][i] for i in range(len(h))) for e, h in zip(share, both)) + net.p["bo"][0]
        assert net.logits(pa.array([text]))[0] == pytest.approx(float(want), abs=1e-5)


def test_pooled_vectors_equal_a_plain_restatement():
    texts = ["A b, b 12 CAPS!!", "", "b a b zz 7", "a b c a b c"]
    known = word_vectors.fit_context(texts, min_docs=2)
    chosen = sorted(known)
    assert chosen == ["<num>", "a", "b"]
    lists = [[t for p in x.split() for t in word_vectors.tokens_of(p)] for x in texts]
    own = lambda t: word_vectors.index_vectors([t])[0].astype(float)
    vectors = {}
    for t in chosen:
        around = np.zeros(word_vectors.DIMS)
        for x in lists:
            for i, at in enumerate(x):
                if at == t:
                    for j in range(max(0, i - 2), min(len(x), i + 3)):
                        around += own(x[j]) if j != i and x[j] in known else 0
        vectors[t] = own(t) + around / max(np.linalg.norm(around), 1e-9)
        assert np.allclose(known[t], vectors[t], atol=1e-5)
    pooled = word_vectors.Pooler(known).pool(pa.array(texts))
    for row, x, text in zip(pooled, lists, texts):
        want = sum((vectors.get(t, own(t)) for t in x), np.zeros(word_vectors.DIMS)) / max(len(x), 1)
        pieces = text.split()
        again = np.mean([a == b for a, b in zip(pieces, pieces[1:])]) if len(pieces) > 1 else 0
        assert np.allclose(row[:-2], want, atol=1e-5) and row[-2] == pytest.approx(math.log1p(len(x)) / 10) and row[-1] == pytest.approx(again)


@pytest.mark.parametrize("sharp", [True, False])
def test_two_layers_equal_a_plain_restatement_and_are_calibrated_both_ways(sharp):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 3))
    y = (x[:, 0] + (0.05 if sharp else 1.5) * rng.standard_normal(600) > 0).astype(np.int64)
    spare = np.arange(600) % 3 == 0
    net = networks.TwoLayer(2, 6).fit(x, y, spare, epochs=10 if sharp else 120)
    for row, got in zip(x[:5], net.predict(x[:5])):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        h = [math.tanh(sum(z[i] * net.p["w1"][i, j] for i in range(3)) + net.p["b1"][j]) for j in range(6)]
        e = [math.exp((sum(h[j] * net.p["w2"][j, k] for j in range(6)) + net.p["b2"][k]) / net.temperature) for k in (0, 1)]
        assert got.tolist() == pytest.approx([v / sum(e) for v in e])
    assert net.temperature < 1 if sharp else net.temperature > 0.2
    loss = lambda p: -np.log(p[np.arange(200), y[spare]]).mean()
    tuned, temperature = loss(net.predict(x[spare])), net.temperature
    net.temperature = 1.0
    assert tuned <= loss(net.predict(x[spare])) + 1e-9 and temperature != 1.0


def test_mixing_with_clashing_names(spark, tables):
    docs, labels, _ = tables
    odd = docs.limit(40).withColumns({"__hash": F.lit(1), "__tokens": F.lit("t"), "__mix_copies": F.lit(0), "__text": F.lit("x"), "rate": F.lit(2.0), "hash": F.lit("h")})
    out = mixing.resample(odd, labels)
    assert out.columns == odd.columns and {r["__mix_copies"] for r in out.collect()} <= {0}
