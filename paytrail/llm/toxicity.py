"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A time step is a word. Its input joins an embedding of the whole word and the mean embedding of its byte n-grams (the
character input), both by hash; their first component starts as the smoothed log-odds of the word or n-gram in toxic
texts. The network reads windows of ``WINDOW`` words that overlap by half; a text's logit is the largest of its windows',
scaled to a probability on a fold of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Packed, fit_in_task, fold, labelled_texts
from .networks import Adam
from .pieces import text_blocks
from .storage import bound_batches
from .words import word_numbers

WINDOW, STEP = 40, 20
#: Units of each direction, components of the word and of the character input, units of the attention layer.
UNITS, PART, ATTEND = 8, 8, 8
#: Hash buckets of words and of byte n-grams, and the lengths of the n-grams.
WORDS, GRAMS, SPANS = 1 << 16, 1 << 17, (4, 5)
_M, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    return x ^ (x >> np.uint64(31))


def word_features(words: pa.Array, block: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_word_features`` of all words, a block at a time: it needs a few hundred bytes for each letter."""
    parts = [_word_features(words[s : s + block]) for s in range(0, max(len(words), 1), block)]
    grams = [p[1].astype(np.int32) for p in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate(grams), np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]


def _word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all n-grams, bounds of the words in them). Words are lower-cased and keep letters
    and digits alone; ``^`` and ``$`` stand at their ends in n-grams."""
    clean = pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.string())), r"[^\p{L}\p{N}]+", "")
    marked = pc.binary_join_element_wise("^", clean, "$", "").cast(pa.large_binary())
    _, offsets, data = marked.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) if len(marked) else np.empty(0, np.uint64)
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - bounds[owner]
    spread = _mix((flat + np.uint64(1)) * _M + place.astype(np.uint64) * _C)
    whole = np.add.reduceat(spread, bounds[:-1]) if len(sizes) else np.empty(0, np.uint64)
    grams, owners = [], []
    for n in SPANS:
        start = np.flatnonzero(place + n <= sizes[owner]) if len(flat) else np.empty(0, np.int64)
        h = np.full(len(start), np.uint64(n))
        for k in range(n):
            h = (h ^ flat[start + k]) * _M
        grams.append((_mix(h) % np.uint64(GRAMS)).astype(np.int64))
        owners.append(owner[start])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    many = np.bincount(owners, minlength=len(sizes))
    return (_mix(whole) % np.uint64(WORDS)).astype(np.int64), grams[order], np.r_[0, np.cumsum(many)]


def window_starts(words: int) -> list[int]:
    """Starts of the overlapping windows of a text; the last one ends with the text."""
    return [*range(0, max(words - WINDOW, 0), STEP), max(words - WINDOW, 0)] if words else []


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], axis=0)
    return out


class Windows:
    """All windows of a block of texts: ``rows`` (first word of each), ``bounds`` (windows of each text), ``words``."""

    def __init__(self, texts: pa.Array):
        self.words, self.flat, ends = word_numbers(texts)
        rows, many = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = window_starts(b - a)
            rows += [a + s for s in own]
            many.append(len(own))
        self.rows, self.bounds = np.array(rows, dtype=np.int64), np.r_[0, np.cumsum(many, dtype=np.int64)]
        self.stop = np.repeat(ends[1:], many)

    def numbers(self, which) -> np.ndarray:
        """Word numbers at (window, step) of some windows; a short text's window ends in padding, numbered after all words."""
        place = self.rows[which][:, None] + np.arange(WINDOW)
        inside = place < self.stop[which][:, None]
        return np.where(inside, self.flat[np.minimum(place, len(self.flat) - 1)] if len(self.flat) else 0, len(self.words))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.word = (rng.standard_normal((WORDS, PART)) * 0.05).astype(np.float32)
        self.gram = (rng.standard_normal((GRAMS, PART)) * 0.05).astype(np.float32)
        self.pad = np.zeros(2 * PART, dtype=np.float32)
        self.p = {"wa": draw(2 * UNITS, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND), "wo": draw(2 * UNITS), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * PART, 3 * UNITS), f"u{d}": draw(UNITS, 3 * UNITS), f"c{d}": np.zeros(3 * UNITS, np.float32)}
        self.slope, self.shift, self.empty = 1.0, 0.0, 0.5

    def inputs(self, word: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row per distinct word, and at the end that of the padding."""
        out = np.empty((len(word) + 1, 2 * PART), dtype=np.float32)
        out[:-1, :PART], out[-1] = self.word[word], self.pad
        for s in range(0, len(word), 20_000):
            own = bounds[s : s + 20_001]
            out[s : s + len(own) - 1, PART:] = _sum_by(self.gram[grams[own[0] : own[-1]]], own - own[0]) / np.maximum(np.diff(own), 1)[:, None].astype(np.float32)
        return out

    def _run(self, proj: np.ndarray, at: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, units) of one direction; ``at``: number of the word at (window, step)."""
        u, n, h = self.p[f"u{d}"], UNITS, np.zeros((len(at), UNITS), dtype=np.float32)
        out = np.empty((at.shape[1], len(at), n), dtype=np.float32)
        for t in range(at.shape[1]) if d == "f" else range(at.shape[1] - 1, -1, -1):
            x, hu = proj[at[:, t]], h @ u
            gate = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * n] + hu[:, : 2 * n]))
            z, r = gate[:, :n], gate[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * n :]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; ``x``: inputs of distinct words, the last the padding."""
        keeps = {d: [] if tape is not None else None for d in "fb"}
        h = np.concatenate([self._run(x @ self.p[f"w{d}"] + self.p[f"c{d}"], at, d, keeps[d]) for d in "fb"], axis=2)
        a = np.tanh(h @ self.p["wa"] + self.p["ba"])
        s = a @ self.p["va"]
        s[(at == len(x) - 1).T] = -1e9
        e = np.exp(s - s.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", e, h)
        if tape is not None:
            tape |= {"h": h, "a": a, "e": e, "pooled": pooled, "keeps": keeps}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def backward(self, x: np.ndarray, at: np.ndarray, tape: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """(gradients of the parameters, gradients of the inputs)."""
        h, a, e, n = tape["h"], tape["a"], tape["e"], UNITS
        g = {"wo": tape["pooled"].T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * self.p["wo"]
        d_e = np.einsum("bk,tbk->tb", d_pool, h)
        d_h = e[:, :, None] * d_pool
        d_s = e * (d_e - (e * d_e).sum(axis=0))
        d_a = d_s[:, :, None] * self.p["va"] * (1 - a * a)
        g["va"] = np.einsum("tb,tbk->k", d_s, a)
        g["wa"], g["ba"] = np.einsum("tbi,tbk->ik", h, d_a), d_a.sum(axis=(0, 1))
        d_h += d_a @ self.p["wa"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, dh, du = self.p[f"u{d}"], np.zeros((len(at), n), dtype=np.float32), np.zeros_like(self.p[f"u{d}"])
            d_proj = np.zeros((len(x), 3 * n), dtype=np.float32)
            for t, before, z, r, new, hu in reversed(tape["keeps"][d]):
                dh = dh + d_h[t][:, k * n : (k + 1) * n]
                dn = dh * (1 - z) * (1 - new * new)
                part = np.concatenate([dh * (before - new) * z * (1 - z), dn * hu * r * (1 - r), dn], axis=1)
                np.add.at(d_proj, at[:, t], part)
                part[:, 2 * n :] *= r
                du += before.T @ part
                dh = dh * z + part @ u.T
            g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = du, d_proj.sum(axis=0), x.T @ d_proj
            d_x += d_proj @ self.p[f"w{d}"].T
        return g, d_x

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The largest window logit of each text; minus infinity for a text without words."""
        own = Windows(texts)
        x = self.inputs(*word_features(own.words))
        out = np.concatenate([self.forward(x, own.numbers(slice(s, s + 2048))) for s in range(0, len(own.rows), 2048)] or [np.empty(0, np.float32)])
        top = np.full(len(texts), -np.inf)
        some = np.flatnonzero(np.diff(own.bounds))
        if len(some):
            top[some] = np.maximum.reduceat(out, own.bounds[some])
        return top

    def score(self, texts: pa.Array) -> np.ndarray:
        top = self.logits(texts)
        fine = np.isfinite(top)
        return np.where(fine, 1 / (1 + np.exp(-(self.slope * np.where(fine, top, 0) + self.shift))), self.empty)


def _log_odds(count: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``count``: texts of either label that hold a bucket."""
    rate = (count + (count.sum(axis=0) + 0.5) / (len(y) + 1)) / (np.bincount(y, minlength=2)[:, None] + 1.0)
    return np.log((rate[1] + 1e-4) / (rate[0] + 1e-4))


def train(texts: list[str], y: np.ndarray, spare: np.ndarray, steps: int = 900, batch: int = 64, seed: int = 3) -> Network:
    """Fitted on the texts outside ``spare``, whose texts set the scale of the scores. Of a toxic text the two windows with
    the highest log-odds are examples, of another the highest and a random one; the rest of it is scored all the same."""
    net, rng = Network(), np.random.default_rng(seed)
    net.empty = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y) or y.min() == y.max():
        net.slope, net.shift = 0.0, float(np.log(net.empty / (1 - net.empty)))
        return net
    use = ~spare if len(set(y[~spare].tolist())) == 2 else np.ones(len(y), dtype=bool)
    arr = pa.array([t for t, o in zip(texts, use, strict=True) if o])
    labels = y[use]
    own = Windows(arr)
    bounds, (word, grams, span) = own.bounds, word_features(own.words)
    count_word, count_gram = np.zeros((2, WORDS)), np.zeros((2, GRAMS))
    for v, a, b in zip(labels.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            d = np.unique(own.numbers(slice(a, b)))
            d = d[d < len(word)]
            count_word[v, np.unique(word[d])] += 1
            count_gram[v, np.unique(np.concatenate([grams[span[w] : span[w + 1]] for w in d]))] += 1
    net.word[:, 0], net.gram[:, 0] = _log_odds(count_word, labels) / 3, _log_odds(count_gram, labels) / 2
    x = net.inputs(word, grams, span)
    odds = np.r_[x[:-1, 0] + x[:-1, PART], -9.0].astype(np.float32)
    hint = np.concatenate([np.sort(odds[own.numbers(slice(s, s + 4096))], axis=1)[:, -3:].sum(axis=1) for s in range(0, len(own.rows), 4096)] or [np.empty(0)])
    examples, truth = [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            best = a + np.argsort(-hint[a:b], kind="stable")[: 2 if labels[i] else 1]
            pick = best.tolist() + ([] if labels[i] else [int(rng.integers(a, b))])
            examples += pick
            truth += [int(labels[i])] * len(pick)
    examples, truth = np.array(examples), np.array(truth, dtype=np.float32)
    pos, neg = np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)
    if not len(pos) or not len(neg):
        return net
    adam, seen_word, seen_gram = Adam(net.p, 4e-3), np.full(net.word.shape, 0.02, np.float32), np.full(net.gram.shape, 0.02, np.float32)
    for _ in range(steps):
        pick = np.r_[rng.choice(pos, batch // 4), rng.choice(neg, batch - batch // 4)]
        used, inner = np.unique(own.numbers(examples[pick]), return_inverse=True)
        pad = len(used) if used[-1] != len(word) else len(used) - 1
        kinds = used[:pad]
        sizes = span[kinds + 1] - span[kinds]
        own_grams = grams[np.repeat(span[kinds] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        own_span = np.r_[0, np.cumsum(sizes)]
        xs, tape = net.inputs(word[kinds], own_grams, own_span), {}
        logit = net.forward(xs, inner.reshape(-1, WINDOW), tape)
        d = ((1 / (1 + np.exp(-logit)) - truth[pick]) / batch).astype(np.float32)
        g, d_x = net.backward(xs, inner.reshape(-1, WINDOW), tape, d)
        adam.step(net.p, g)
        # embeddings: only the rows in use, each with its own rate
        for table, seen, rows, grad in ((net.word, seen_word, word[kinds], d_x[:-1, :PART]), (net.gram, seen_gram, own_grams, np.repeat(d_x[:-1, PART:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))):
            total = np.zeros((len(u := np.unique(rows)), PART), dtype=np.float32)
            np.add.at(total, np.searchsorted(u, rows), grad)
            seen[u] += total * total
            table[u] -= 0.02 * total / np.sqrt(seen[u])
    check = spare if spare.any() and y[spare].min() != y[spare].max() else np.ones(len(y), dtype=bool)
    rest = pa.array([t for t, c in zip(texts, check, strict=True) if c])
    top = np.concatenate([net.logits(rest[s]) for s in text_blocks(rest, 1_000_000)])
    fine = np.isfinite(top)
    net.slope, net.shift = _scale(top[fine], y[check][fine])
    return net


def _scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (logit, label), labels drawn in a little, by Newton's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w, r = p * (1 - p) + 1e-9, p - t
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        a, b = max(a - np.clip(step[0], -1, 1), 0.05), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def _build(rows: list[dict]) -> Network:
    return train([r["text"] for r in rows], np.array([int(r["toxic"]) for r in rows], dtype=np.int64), np.array([r["fold"] == 1 for r in rows], dtype=bool))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 6000) -> Packed:
    """A network for ``labels.toxic``, from at most ``rows`` labelled rows outside fold 0; fold 1 scales the scores."""
    return fit_in_task(labelled_texts(docs, labels, ["toxic"], key, text, rows), _build)


def score_toxicity(docs: DataFrame, net: Network | Packed, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``key``, ``held_out``, ``score`` (probability of label 1) and ``predicted`` (score >= ``threshold``).

    Every overlapping window of every whole text, in one narrow pass. A null, empty or blank text has the share of toxic
    labels as its score; repeated rows and null keys come back as they are; without both labels to learn from all scores
    are that share; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Packed.of(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_blocks(b.column(2), 2_000_000):
                part = b.slice(s.start, s.stop - s.start)
                score = sent.value.load().score(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    slim = docs.select(F.col(key), (fold(key) == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return slim.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
