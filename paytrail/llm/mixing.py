"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives every document posterior probabilities of the domains. Nonnegative rates
``r`` of the documents are then fitted by least squares, so that the expected tokens of each domain, ``sum of r * tokens *
posterior``, come to its target, with a small ridge that draws all rates to the common one. The method is projected
gradient from that common rate. Documents weigh by their tokens, and misses by the inverse of the domains' matrix of
products, so that rare domains count, with more weight on the miss of all tokens. A step along the miss scaled by that
inverse solves the problem if no rate meets zero; where many do, the matrix of the documents whose rates are above zero
scales better. A round tries several lengths of these and of the gradient itself, and takes what is best: one aggregate
over (tokens, posteriors), for which a task needs to know one vector of each round so far.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import cut

from .labelled import Packed, fit_in_task, labelled_texts
from .networks import TwoLayer
from .pieces import text_blocks
from .storage import bound_batches
from .words import strings, word_numbers

#: Domains of the production query, by the labels' columns, and the share of tokens that each is to have.
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.93, "low": 0.04, "toxic": 0.03}
#: For documents that have passed the quality gate, which leaves no low ones to raise: low stays as rare as it is.
GATED_TARGETS = TARGETS | {"low": None}
#: The share of all tokens by which a domain may be off its target.
TOLERANCE = 1e-4
#: Weight of the squared distance from the common rate against that of the squared misses. It moves a reached target by
#: 3e-4 of what it was off, and keeps a target that only a few documents could serve from being served by them alone.
RIDGE = 3e-4
#: Weight of the miss of all domains' tokens together.
WHOLE = 10.0
#: Lengths of the steps that a round tries.
LENGTHS = (0.25, 1.0, 4.0, 16.0, 64.0)
#: Share of the documents in effect at the common rate below which the rates are reported as concentrated.
CONCENTRATED = 0.1


def traits(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """(traits, in turn, for all words: stem, start, marks, case; four each). A stem is the lower-cased letters and digits."""
    words = words.cast(pa.string())
    stem = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")
    start = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(stem, 0, 5), "")
    marks = pc.binary_join_element_wise("+", pc.replace_substring_regex(words, r"[\p{L}\p{N}]+", ""), "")
    case = pc.if_else(pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(stem), 1)), "<caps>", "<case>")
    table = pa.concat_arrays([x.cast(pa.string()) for x in (stem, start, marks, case)]).dictionary_encode()
    return strings(table.dictionary), table.indices.to_numpy().reshape(4, -1).T.astype(np.int64)


class DomainModel:
    """Log-odds of word traits for each domain, pooled as mean and maximum, and a small calibrated network on top."""

    def __init__(self, texts: list[str], y: np.ndarray, spare: np.ndarray, domains: int, min_docs: int = 3):
        self.domains, self.odds, self.net = domains, {}, None
        if not len(texts):
            return
        arr = pa.array(texts, pa.string())
        seen: dict[str, np.ndarray] = {}
        # odds from one half and the network from the other, so that it meets odds of words as unseen as later ones
        first = ~spare & (np.arange(len(texts)) % 2 == 0) if (~spare).sum() > 20 else np.ones(len(texts), dtype=bool)
        for i in np.flatnonzero(first).tolist():
            names, own = traits(word_numbers(arr[i : i + 1])[0])
            for t in set(map(names.__getitem__, np.unique(own).tolist())):
                seen.setdefault(t, np.zeros(domains))[y[i]] += 1
        total = np.bincount(y[first], minlength=domains) + 1.0
        for t, n in seen.items():
            if n.sum() >= min_docs:
                rate = (n + n.sum() / total.sum()) / total
                self.odds[t] = np.log(rate / ((n.sum() - n + 0.5) / (total.sum() - total + 1))).astype(np.float32)
        x = np.concatenate([self.pool(arr[s])[0] for s in text_blocks(arr)])
        rest = ~first | spare if (~first & ~spare).sum() > 10 else np.ones(len(texts), dtype=bool)
        self.net = TwoLayer(domains, 16).fit(x[rest], y[rest], spare[rest])

    def pool(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(a row per text, its number of words)."""
        words, at, bounds = word_numbers(texts)
        names, own = traits(words)
        table = np.zeros((len(names) + 1, self.domains), dtype=np.float32)
        for i, t in enumerate(names):
            if (v := self.odds.get(t)) is not None:
                table[i] = v
        each = table[own].reshape(len(own), -1)[at] if len(at) else np.zeros((0, 4 * self.domains), np.float32)
        out = np.zeros((len(texts), 8 * self.domains), dtype=np.float32)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            out[some, : 4 * self.domains] = np.add.reduceat(each, bounds[some], axis=0) / np.diff(bounds)[some, None]
            out[some, 4 * self.domains :] = np.maximum.reduceat(each, bounds[some], axis=0)
        return out, np.diff(bounds)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, n = self.pool(texts)
        return (self.net.predict(x) if self.net else np.full((len(texts), self.domains), 1 / self.domains)), n


def domain_of(quality: int, toxic: int) -> int:
    return 2 if toxic else 0 if quality else 1


def _build(rows: list[dict]) -> DomainModel:
    y = np.array([domain_of(r["quality"], r["toxic"]) for r in rows], dtype=np.int64)
    return DomainModel([r["text"] for r in rows], y, np.array([r["fold"] == 1 for r in rows], dtype=bool), len(DOMAINS))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 4000) -> Packed:
    """A model of the three domains from at most ``rows`` labelled rows outside fold 0; fold 1 sets the temperature."""
    return fit_in_task(labelled_texts(docs, labels, ["quality", "toxic"], key, text, rows), _build)


def memberships(docs: DataFrame, model: DomainModel | Packed, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``__tokens`` (words between white space, plus one for the end of the text) and ``__posterior``."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Packed.of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep))
            for s in text_blocks(texts, 2_000_000):
                p, n = sent.value.load().posteriors(texts[s])
                part = b.slice(s.start, s.stop - s.start)
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(n + 1, pa.int64()), lists], names=[*keep, "__tokens", "__posterior"])

    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, __tokens long, __posterior array<double>")


def _step(q: np.ndarray, p: np.ndarray, g: np.ndarray, pull: float, top: float) -> np.ndarray:
    return np.clip(q - p @ g - pull * (q - 1), 0.0, top)


def replay(p: np.ndarray, start: float, steps: list[np.ndarray], pulls: list[float], top: float = math.inf) -> np.ndarray:
    """Rates after the rounds whose steps are given: a step moves a document by its posterior's share and pulls it to the
    common rate ``start``."""
    q = np.ones(len(p))
    for g, k in zip(steps, pulls, strict=True):
        q = _step(q, p, g, k, top / start)
    return start * q


def fit_rates(members: DataFrame, targets: np.ndarray, total: float | None = None, top: float = math.inf, rounds: int = 60, tolerance: float = TOLERANCE, ridge: float = RIDGE) -> tuple[float, list[np.ndarray], list[float], np.ndarray]:
    """(start, steps, pulls, expected domain tokens reached). ``total``: tokens of the mixture, by default all there are.

    One pass adds up the domains' tokens and their matrix; every round is one pass that replays the rates, tries the next
    steps, and adds up what each would reach. It ends once no domain is off by more than ``tolerance`` of the total, or no
    step gets closer, which is where the ridge outweighs what is left to gain.
    """
    d = len(targets)
    p = [F.col("posterior")[i] for i in range(d)]
    sums = members.agg(F.sum("tokens").alias("n"), *(F.sum(F.col("tokens") * a * b).alias(f"h{i}_{j}") for i, a in enumerate(p) for j, b in enumerate(p)), *(F.sum(F.col("tokens") * a).alias(f"t{i}") for i, a in enumerate(p))).first()
    n = float(sums["n"] or 0)
    if not n:
        return 1.0, [], [], np.zeros(d)
    total = total or n
    goal, start = targets / targets.sum(), total / n
    matrix = np.array([[sums[f"h{i}_{j}"] for j in range(d)] for i in range(d)]) / n
    scale = np.linalg.pinv(matrix, rcond=1e-9, hermitian=True)
    weigh = scale + WHOLE
    miss, free, strain = np.array([sums[f"t{i}"] for i in range(d)]) / n - goal, matrix, 0.0
    value, steps, pulls = miss @ weigh @ miss / 2, [], []
    while len(steps) < rounds and np.abs(miss).max() > tolerance:
        ways = [weigh @ miss / (1 + WHOLE), scale @ miss, np.linalg.pinv(free + 1e-9 * np.trace(matrix) * np.eye(d), rcond=1e-12, hermitian=True) @ miss]
        tried = [(s * way, min(1.0, s * ridge)) for way in ways for s in LENGTHS]
        found = _trials(members, d, n, steps, pulls, top / start, tried)
        values = [(m - goal) @ weigh @ (m - goal) / 2 + ridge * far / 2 for m, _, far in found]
        k = int(np.argmin(values))
        if values[k] >= value * (1 - 1e-4):
            break
        value, (reached, free, strain) = values[k], found[k]
        miss = reached - goal
        steps.append(tried[k][0])
        pulls.append(tried[k][1])
    return start, steps, pulls, (miss + goal) * total


def _trials(members: DataFrame, d: int, n: float, steps: list[np.ndarray], pulls: list[float], top: float, tried: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each next step: the domains' shares, the matrix of the documents whose rates are above zero, and the mean squared
    distance from the common rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(tried), d + d * d + 1))
        for b in batches:
            p, w = b.column(1).flatten().to_numpy().reshape(-1, d), b.column(0).to_numpy() / n
            now = replay(p, 1.0, steps, pulls, top)
            for k, (g, pull) in enumerate(tried):
                q = _step(now, p, g, pull, top)
                out[k] += np.r_[(q * w) @ p, ((p.T * (w * (q > 0))) @ p).ravel(), w @ np.square(q - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried))), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["k", "s"])

    parts = members.select("tokens", "posterior").mapInArrow(run, "k long, s array<double>")
    rows = parts.groupBy("k").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d + d * d + 1))).orderBy("k").collect()
    sums = [np.array(r[1:]) for r in rows]
    return [(s[:d], s[d:-1].reshape(d, d), float(s[-1])) for s in sums]


def concentration(members: DataFrame, d: int, start: float, steps: list[np.ndarray], pulls: list[float], top: float = math.inf) -> dict[str, float]:
    """``effective`` (documents in effect, the squared sum of their tokens over the sum of their squares, as a share of those at
    the common rate), ``zero`` (share of documents with a rate of zero) and ``most`` (the largest rate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, most = np.zeros(6), 0.0
        for b in batches:
            t, r = b.column(0).to_numpy().astype(np.float64), replay(b.column(1).flatten().to_numpy().reshape(-1, d), start, steps, pulls, top)
            out += [len(t), (r == 0).sum(), t.sum(), np.square(t).sum(), t @ r, np.square(t * r).sum()]
            most = max(most, float(r.max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64())), pa.array([most])], names=["s", "most"])

    parts = members.select("tokens", "posterior").mapInArrow(run, "s array<double>, most double")
    s = parts.agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(6)), F.max("most").alias("most")).first()
    if not s["s4"]:
        return {"effective": 1.0, "zero": 0.0 if not s["s0"] else s["s1"] / s["s0"], "most": s["most"] or 0.0}
    return {"effective": (s["s4"] ** 2 / s["s5"]) / (s["s2"] ** 2 / s["s3"]), "zero": s["s1"] / s["s0"], "most": s["most"]}


def goal_of(targets: Mapping[str, float | None], shares: np.ndarray) -> np.ndarray:
    """Target shares of ``DOMAINS``, which add up to 1. A domain whose target is None keeps its share; the others have what
    remains, in proportion."""
    own = np.array([np.nan if targets[x] is None else targets[x] for x in DOMAINS], dtype=float)
    kept = np.isnan(own)
    if (own < 0).any() or np.nansum(own) <= 0:
        raise ValueError("targets must be nonnegative, and one positive")
    return np.where(kept, shares, own / np.nansum(own) * (1 - shares[kept].sum()))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float | None] | None = None, keep: list[str] | None = None, key: str = "doc_id", text: str = "text", rows: int = 4000, top: float = math.inf, prefix: str = "") -> DataFrame:
    """One row per input row: ``keep`` (default ``key``), ``tokens``, ``p_<domain>`` for each domain, ``rate`` (0 to
    ``top``), ``tokens`` being words between white space and an end mark, ``copies`` (the rate rounded up or down, at random by a hash of key and text, so that copies have the
    rate as their mean), ``off_<domain>`` (share of the tokens that the rates reach less that of the target) and ``effective``
    (see ``concentration``); these two are the same in all rows. ``prefix`` stands before the names of the columns that are added.

    A domain whose target is None keeps the share that it has. Where no nonnegative rates meet the targets, a warning says
    by how much each domain is off, and the rates are those of the last round. Rates that leave few documents in effect warn too,
    and say how many have none and how large the largest is.

    A null, empty or blank text has one token (its end) and the posterior that the classifier gives to no words. Equal rows
    have equal rates; a null key is a key. Without labels the posteriors are equal. An empty table gives no rows.
    """
    targets = TARGETS if targets is None else targets
    keep = [key] if keep is None else keep
    goal_of(targets, np.zeros(len(DOMAINS)))
    slim = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.xxhash64(F.col(key), F.col(text)).alias("hash"), F.col(text).alias("text"))
    members = cut(memberships(slim, fit(docs, labels, key, text, rows), slim.columns[:-1], "text"), "members")
    slim = members.select(F.col("__tokens").alias("tokens"), F.col("__posterior").alias("posterior"))
    sums = slim.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col("posterior")[i]) for i in range(len(DOMAINS)))).first()
    n, has = float(sums[0] or 1), np.array([x or 0.0 for x in sums[1:]])
    goal = goal_of(targets, has / n)
    start, steps, pulls, reached = fit_rates(slim, goal, top=top)
    spread = concentration(slim, len(goal), start, steps, pulls, top)
    off = reached / n - goal if sums[0] else np.zeros(len(goal))
    if np.abs(off).max() > TOLERANCE:
        warnings.warn("mixing: no rates meet the targets; token shares reached (targets): " + ", ".join(f"{x} {a:.5f} ({b:.5f})" for x, a, b in zip(DOMAINS, reached / n, goal, strict=True)), stacklevel=2)
    if spread["effective"] < CONCENTRATED:
        warnings.warn(f"mixing: the rates leave {spread['effective']:.4f} of the documents in effect; {spread['zero']:.4f} have a rate of zero, the largest rate is {spread['most']:.1f}", stacklevel=2)
    names = [prefix + x for x in ("tokens", *(f"p_{x}" for x in DOMAINS), "rate", "copies", *(f"off_{x}" for x in DOMAINS), "effective")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(b.schema.get_field_index("__posterior")).flatten().to_numpy().reshape(-1, len(goal))
            r = replay(p, start, steps, pulls, top)
            u = (b.column(b.schema.get_field_index("hash")).to_numpy().view(np.uint64) >> np.uint64(11)) / 2.0**53
            cols = [b.column(i) for i in range(len(keep))] + [b.column(b.schema.get_field_index("__tokens"))] + [pa.array(p[:, i]) for i in range(len(goal))]
            miss = [pa.array(np.full(len(r), x)) for x in (*off, spread["effective"])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r), pa.array(np.floor(r + u).astype(np.int32)), *miss], names=[*keep, *names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    types = ["long", *("double" for _ in DOMAINS), "double", "int", *("double" for _ in DOMAINS), "double"]
    return members.mapInArrow(run, f"{kinds}, {', '.join(f'{a} {b}' for a, b in zip(names, types, strict=True))}")


def resample(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float | None] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as its copies say, all columns."""
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rates = mix(docs, labels, targets, docs.columns, key, text, prefix=prefix)
    copies = F.col(f"{prefix}copies")
    often = rates.where(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)))
    return often.select(docs.columns)
