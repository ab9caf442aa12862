"""Exact splitting of texts into short pieces that a byte-level BPE tokenizer treats independently.

The pre-tokenizer's pattern lets a space join only the run that follows it, so a token always starts at a space whose
next character is not white space; and a line feed between two characters that aren't white space is a token of its own.
Cutting there changes nothing. Arrow splits a block of texts and numbers its distinct pieces; a worker tokenizes each
piece once and remembers it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import strings

#: Distinct pieces that a worker remembers before it starts afresh.
CACHE_PIECES = 600_000


def lead(piece: str) -> str:
    """What stands before a later piece in its text."""
    return "" if piece[:1] == "\n" else " "


def unsafe(piece: str) -> bool:
    """Whether a later piece follows or starts more white space than one character, so that its text can't be cut there."""
    start = piece[1:2] if piece[:1] == "\n" else piece[:1]
    return not start or start.isspace()


class Cut:
    """Pieces of a block of texts.

    ``first``: the first piece of each text, which stands as it is. ``later``: the distinct other pieces; one that starts
    with a line feed stands as it is, any other follows a space. ``at``: for each text its first piece (-1) and the numbers
    of its later ones, all in one array with ``bounds``.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        self.bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        heads = self.bounds[:-1]
        self.at = coded.indices.to_numpy().astype(np.int64)
        words = strings(coded.dictionary)
        self.first = [words[i] for i in self.at[heads]]
        self.at[heads] = -1
        used = np.zeros(len(words), dtype=bool)
        used[self.at[self.at >= 0]] = True
        number = np.cumsum(used) - 1
        self.at = np.where(self.at >= 0, number[self.at], -1)
        self.later = [w for w, u in zip(words, used.tolist(), strict=True) if u]

    def drop(self, pieces: set[str]) -> list[int]:
        """Empty the texts that hold one of the later ``pieces``, which can't be cut, and tell which they are."""
        bad = np.array([p in pieces for p in self.later], dtype=bool)
        hit = np.flatnonzero(self.at >= 0)
        hit = hit[bad[self.at[hit]]]
        texts = np.unique(np.searchsorted(self.bounds, hit, side="right") - 1)
        for i in texts.tolist():
            self.empty(i)
        return texts.tolist()

    def empty(self, i: int) -> None:
        self.first[i] = ""
        self.at[self.bounds[i] + 1 : self.bounds[i + 1]] = -2


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """Contents of the tokenizer's added tokens, which it recognises inside texts."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


def with_special(texts: pa.Array, special: tuple[str, ...]) -> list[int]:
    """Which texts hold a special string."""
    found = np.zeros(len(texts), dtype=bool)
    for s in special:
        found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found).tolist()


def text_blocks(texts: pa.Array, size: int = 4_000_000) -> list[slice]:
    """Slices of about ``size`` bytes, so that what a block needs stays bounded."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if not len(ends):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(ends)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
