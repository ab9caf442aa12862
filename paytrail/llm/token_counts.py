"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole Arrow batch lie in one flat numpy array of symbol ids with a sequence index (a ragged array). Each
round looks up the merge rank of every adjacent pair, takes every sequence's lowest rank, and merges all its pairs of
that rank at once, left to right; a sequence without a mergeable pair leaves the array, and its surviving symbols are its
tokens. A trained merge list gives any pair that holds a new symbol a higher rank than the merge that made it, so the
simultaneous step equals merging one pair at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CACHE_PIECES, Cut, lead, special_strings, text_blocks, unsafe, with_special
from .storage import bound_batches

_NONE = np.int32(2**31 - 1)
#: White space as the tokenizer's pattern engine has it (fixed values).
_WS = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokenizer's published pattern (fixed value), its white space spelled out.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by rule: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Ranks and results of all merges of one vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Number of symbols left of each pre-token."""
        sizes = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
        counts = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return counts
        sym = self.byte_id[np.frombuffer(b"".join(pre_tokens[i] for i in live), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(live)), sizes[live])
        rank = np.full(len(sym), _NONE, dtype=np.int32)  # of the pair that starts here
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(seq)])
            ended = low == _NONE
            if ended.any():
                counts[live[seq[starts[ended]]]] = length[ended]
                going = np.repeat(~ended, length)
                sym, seq, rank = sym[going], seq[going], rank[going]
                low, length = low[~ended], length[~ended]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            run = np.r_[True, np.diff(hit) != 1]  # overlapping hits are runs of one symbol: every other one merges
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            alive = np.ones(len(sym), dtype=bool)
            alive[hit + 1] = False
            now = np.cumsum(alive)[hit] - 1
            sym, seq, rank = sym[alive], seq[alive], rank[alive]
            touched = np.zeros(len(sym) + 1, dtype=bool)  # the last entry takes the -1 of a first symbol
            touched[now] = touched[now - 1] = True
            stale = np.flatnonzero(touched[:-1])
            rank[stale] = _NONE
            stale = stale[stale < len(sym) - 1]
            stale = stale[seq[stale] == seq[stale + 1]]
            rank[stale] = self.rank(sym[stale], sym[stale + 1])
        return counts


class TokenCounter:
    """Counts whole texts; remembers the counts of pieces."""

    def __init__(self, path: str):
        self.table, self.special, self.later = MergeTable(path), special_strings(path), {}
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _count(self, strings: list[str]) -> list[int]:
        found = [PRE_TOKEN.findall(s) for s in strings]
        number = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        counts = self.table.count([t.encode("utf-8", "surrogatepass") for t in number]).tolist()
        return [sum([counts[number[t]] for t in x]) for x in found]

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if p.isalpha()]  # each one pre-token
        if words:
            self.later.update(zip(words, self.table.count((" " + "\n ".join(words)).encode("utf-8").split(b"\n")).tolist(), strict=True))
        rest = [p for p in pieces if not p.isalpha()]
        self.later.update(zip(rest, self._count([lead(p) + p for p in rest]), strict=True))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; special strings inside a text count as one token each, as the library takes them."""
        if len(self.later) > CACHE_PIECES:
            self.later.clear()
        cut = Cut(texts)
        whole = with_special(texts, self.special)
        for i in whole:
            cut.empty(i)
        number = np.fromiter((self.later.get(p, -1) for p in cut.later), dtype=np.int64, count=len(cut.later))
        missing = np.flatnonzero(number < 0).tolist()
        if bad := {p for p in map(cut.later.__getitem__, missing) if unsafe(p)}:
            whole += cut.drop(bad)
            missing = [i for i in missing if cut.later[i] not in bad]
        new = [cut.later[i] for i in missing]
        self._learn(new)
        number[missing] = np.fromiter(map(self.later.__getitem__, new), dtype=np.int64, count=len(new))
        each = np.zeros(len(cut.at), dtype=np.int64)
        on = cut.at >= 0
        each[on] = number[cut.at[on]]
        each[cut.bounds[:-1]] = self._count(cut.first)
        out = np.add.reduceat(each, cut.bounds[:-1]) if len(each) else np.zeros(0, dtype=np.int64)
        parts = [self.split_special.split(texts[i].as_py()) if self.split_special else [texts[i].as_py()] for i in whole]
        flat = iter(self._count(list(chain.from_iterable(parts))))
        for i, x in zip(whole, parts, strict=True):
            out[i] = len(x) - 1 + sum(next(flat) for _ in x)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Null texts count as empty (0 bytes, 0 tokens). Rows repeat as often as they come in; an empty table gives none. No
    shuffle: one narrow pass that reads only the columns it needs. ``tokenizer`` is a path that executors can open.
    """
    bound_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in batches:
            texts = b.column(len(keep))
            for s in text_blocks(texts):
                part, counts = b.slice(s.start, s.stop - s.start), own.count(texts[s])
                size = pc.binary_length(texts[s]).cast(pa.int64())
                cols = [part.column(i) for i in range(len(keep))] + [size, pa.array(counts, pa.int64()), pa.array(counts > limit)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
