"""Random-indexing word vectors, pooled per document.

Every token has a sparse ternary index vector that its hash alone decides. A token's context vector is the sum of the
index vectors around it in the sample that the model is fitted on; its word vector is its index vector plus the
normalised context vector. Tokens that the sample doesn't hold keep their index vector. A document is the mean over all
its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from .words import strings, word_numbers

#: Length of the vectors, non-zero places of an index vector, and words either side that count as context.
DIMS, PLACES, WINDOW = 64, 4, 2
#: Pieces that a worker remembers before it starts afresh.
CACHE_PIECES = 100_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def tokens_of(piece: str) -> list[str]:
    """Tokens of a run without white space: lower-cased words, numbers as ``<num>``, runs of one punctuation mark as that
    mark and ``<run>``, and ``<caps>`` after a word all in capitals."""
    out = []
    for t in _TOKEN.findall(piece):
        if t[0].isalpha():
            out.append(t.lower())
            if len(t) > 1 and t.isupper():
                out.append("<caps>")
        elif t[0].isdigit():
            out.append("<num>")
        else:
            out += dict.fromkeys(t)
            if len(t) > 1:
                out.append("<run>")
    return out


def index_vectors(tokens: Sequence[str], dims: int = DIMS) -> np.ndarray:
    """A row per token: ``PLACES`` additions of 1 or -1, each decided by a byte of the token's hash."""
    out = np.zeros((len(tokens), dims), dtype=np.float32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    rows = np.arange(len(tokens))
    for k in range(PLACES):
        part = (h >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        out[rows, (part >> np.uint64(1)).astype(np.int64) % dims] += np.where(part & np.uint64(1), 1, -1).astype(np.float32)
    return out


def fit_context(texts: Sequence[str], min_docs: int = 3, most: int = 50_000) -> dict[str, np.ndarray]:
    """Word vectors of the tokens that at least ``min_docs`` of the texts hold (the ``most`` frequent)."""
    known: dict[str, int] = {}
    docs = [np.fromiter((known.setdefault(t, len(known)) for p in x.split() for t in tokens_of(p)), dtype=np.int32) for x in texts]
    seen = np.zeros(len(known), dtype=np.int64)
    for d in docs:
        seen[np.unique(d)] += 1
    tokens = list(known)
    chosen = sorted(np.flatnonzero(seen >= min_docs).tolist(), key=lambda i: (-seen[i], tokens[i]))[:most]
    words = [tokens[i] for i in chosen]
    place = np.zeros(len(known), dtype=np.int64)  # 0: any other token, which gives no context
    place[chosen] = np.arange(1, len(words) + 1)
    del known, tokens
    index = np.zeros((len(words) + 1, DIMS), dtype=np.float32)
    index[1:] = index_vectors(words)
    context = np.zeros_like(index)
    for d in docs:
        at = place[d]
        around = np.zeros((len(at), DIMS), dtype=np.float32)
        for k in range(1, WINDOW + 1):
            around[k:] += index[at[:-k]]
            around[:-k] += index[at[k:]]
        order = np.argsort(at, kind="stable")
        if len(at):
            own, first = np.unique(at[order], return_index=True)
            context[own] += np.add.reduceat(around[order], first, axis=0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = index + context / np.maximum(norm, 1e-9)
    return {w: vectors[i] for i, w in enumerate(words, 1)}


class Pooler:
    """Means of word vectors over whole texts; remembers the sums of pieces."""

    #: Columns of a pooled row: the mean, log of 1 + tokens, share of pieces that repeat the one before.
    width = DIMS + 2

    def __init__(self, words: dict[str, np.ndarray]):
        self.words = words
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1 << 14, DIMS + 1), dtype=np.float32)  # the last column counts tokens

    def _learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        at = len(self.known)
        while at + len(pieces) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        lists = [tokens_of(p) for p in pieces]
        flat = list(chain.from_iterable(lists))
        number = {t: i for i, t in enumerate(dict.fromkeys(flat))}
        vectors = index_vectors(list(number))
        for t, i in number.items():
            if (v := self.words.get(t)) is not None:
                vectors[i] = v
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        rows = self.sums[at : at + len(pieces)]
        rows[:] = 0
        some = sizes > 0
        if len(flat):
            own = vectors[np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))]
            rows[some, :DIMS] = np.add.reduceat(own, (np.cumsum(sizes) - sizes)[some], axis=0)
        rows[:, DIMS] = sizes
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def pool(self, texts: pa.Array) -> np.ndarray:
        """A row per text, of ``width`` columns; zeros for a text without pieces."""
        if len(self.known) > CACHE_PIECES:
            self._reset()
        words, numbers, bounds = word_numbers(texts)
        words = strings(words)
        self._learn([w for w in words if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))[numbers]
        again = np.r_[False, at[1:] == at[:-1]] if len(at) else np.zeros(0, dtype=bool)
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = int(bounds[i]), int(bounds[i + 1])
            total = np.zeros(DIMS + 1)
            for s in range(a, b, 4096):  # in parts, so that the gathered rows stay in cache
                total += self.sums[at[s : min(s + 4096, b)]].sum(axis=0)
            out[i, :DIMS] = total[:DIMS] / max(total[DIMS], 1)
            out[i, DIMS] = np.log1p(total[DIMS]) / 10
            out[i, DIMS + 1] = again[a + 1 : b].mean() if b > a + 1 else 0
        return out
