"""Token ids in directly addressable files.

An id is cut into chunks, low bits first. Level 0 holds the first chunk of every id; a continuation bitmap marks the ids
that go on, whose next chunks stand in level 1, and so on. A rank directory (ones before each block of the bitmap) turns a
position in one level into that in the next, so any token is read from a few bytes without decoding its neighbours. The
chunk widths of each file are those that make it smallest.

File: ``b"DACT"``, uint32 header length, JSON header, then the sections the header places: doc ids, starts, and for each
level its packed chunks, bitmap and rank directory.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import new_path

from .pieces import Cut, special_strings, text_blocks, unsafe, with_special
from .storage import bound_batches
from .token_counts import byte_symbols
from .words import strings

MAGIC = b"DACT"
#: Distinct pieces whose ids a worker remembers before it starts afresh, keeping these in reach (about 200 bytes each).
CACHE_PIECES = 500_000
#: Pieces that are tokenized at once; the library's results for them are objects of some hundred bytes each.
AT_ONCE = 5_000
#: Bytes of text that are cut at once.
BLOCK = 8_000_000
#: Bits of a bitmap for each entry of its rank directory.
RANK_BLOCK = 512
#: Marks that, behind letters and before white space, make a pre-token of their own; an apostrophe may belong to the letters.
MARKS = ".,;:!?"
#: All pieces at which a text can't be cut, and perhaps others.
UNCUT = r"^\n?(\pZ|[\t-\r\x1c-\x1f\x{85}]|$)"


class Pieces:
    """Ids of numbered pieces in a ragged array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 18, dtype=np.uint32), 0
        self.starts, self.sizes, self.count = np.empty(1 << 15, dtype=np.int64), np.empty(1 << 15, dtype=np.int64), 0

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Their numbers."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        own = np.arange(self.count, self.count + len(pieces))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.number.update(zip(pieces, own.tolist(), strict=True))
        self.used, self.count = self.used + len(ids), self.count + len(sizes)
        return own

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered pieces, one after the other, how many each has); a negative number has none."""
        sizes = np.where(at >= 0, self.sizes[at], 0)
        ends = np.cumsum(sizes)
        place = np.repeat(np.where(at >= 0, self.starts[at], 0) - (ends - sizes), sizes)
        place += np.arange(len(place))
        return self.flat[place], sizes


def _joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of pieces whose first part, second part and so on are given as (ids, sizes)."""
    sizes = np.stack([n for _, n in parts])
    total = sizes.sum(axis=0)
    at = np.cumsum(total) - total + np.cumsum(sizes, axis=0) - sizes  # where each part starts
    out = np.empty(int(total.sum()), dtype=np.uint32)
    for (ids, n), start in zip(parts, at, strict=True):
        out[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, total


def _flat(parts: Iterator[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of lists that come in parts, so that few are held at once."""
    ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for lists in parts:
        sizes.append(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        ids.append(np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes[-1].sum())))
    return np.concatenate(ids), np.concatenate(sizes)


class PieceEncoder:
    """Ids of whole texts by the tokenizers library; remembers the ids of pieces.

    ``later``: pieces that follow a space or start with a line feed; ``bare``: pieces with nothing before them; ``old``: the
    later ones remembered before, from which those that come again are taken over.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.lib, self.special = Tokenizer.from_file(path), special_strings(path)
        self.symbols = {b: c for b, c in enumerate(byte_symbols()) if b != 10}
        self.later, self.old, self.bare = Pieces(), Pieces(), Pieces()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.lib.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)] for i in range(0, len(texts), AT_ONCE))

    def _words(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters alone behind ``before``, each one pre-token, straight through the library's model."""
        stand_ins = (before + ("\n" + before).join(words)).encode("utf-8").decode("latin-1").translate(self.symbols).split("\n") if words else []
        return _flat([[t.id for t in x] for x in map(self.lib.model.tokenize, stand_ins[i : i + AT_ONCE])] for i in range(0, len(words), AT_ONCE))

    def _learn(self, pieces: list[str], known: Pieces, before: str) -> np.ndarray:
        """Numbers of new pieces that stand behind ``before``. Letters with marks behind them are two pre-tokens, so their
        ids are those of the letters and those of the marks."""
        texts = pa.array(pieces, pa.large_string())
        stems = pc.utf8_rtrim(texts, MARKS)
        plain = pc.utf8_is_alpha(stems)
        some = plain.to_numpy(zero_copy_only=False)
        coded = stems.filter(plain).dictionary_encode()
        words = strings(coded.dictionary)
        word = known.find(words)
        fresh = np.flatnonzero(word < 0)
        own = list(map(words.__getitem__, fresh.tolist()))
        word[fresh] = known.add(own, *self._words(own, before))
        number = np.full(len(pieces), -1, dtype=np.int64)
        number[some] = word[coded.indices.to_numpy()]
        marked = np.flatnonzero(some & (pc.binary_length(texts).to_numpy() > pc.binary_length(stems).to_numpy()))
        if len(marked):
            own = list(map(pieces.__getitem__, marked.tolist()))
            ends = [p[n:] for p, n in zip(own, pc.utf8_length(stems.take(pa.array(marked))).to_numpy().tolist(), strict=True)]
            marks = Pieces()
            marks.add(kinds := list(set(ends)), *self._encode(kinds))
            number[marked] = known.add(own, *_joined(known.ids(number[marked]), marks.ids(marks.find(ends))))
        rest = np.flatnonzero(~some)
        own = list(map(pieces.__getitem__, rest.tolist()))
        number[rest] = known.add(own, *self._encode([before + p for p in own]))
        return number

    def _bare(self, pieces: list[str]) -> np.ndarray:
        if new := list(set(pieces) - self.bare.number.keys()):
            self._learn(new, self.bare, "")
        return self.bare.find(pieces)

    def _later(self, pieces: list[str]) -> tuple[np.ndarray, set[str]]:
        """(numbers of later pieces, those at which a text can't be cut, which have none)."""
        number = self.later.find(pieces)
        missing = np.flatnonzero(number < 0)
        own = list(map(pieces.__getitem__, missing.tolist()))
        was = self.old.find(own)
        again = missing[was >= 0]
        number[again] = self.later.add(list(map(pieces.__getitem__, again.tolist())), *self.old.ids(was[was >= 0]))
        missing = missing[was < 0]
        texts = pa.array(list(map(pieces.__getitem__, missing.tolist())), pa.large_string())
        doubt = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        bad = {p for i in missing[doubt].tolist() if unsafe(p := pieces[i])}
        if bad:
            fine = np.array([pieces[i] not in bad for i in missing.tolist()], dtype=bool)
            missing, texts = missing[fine], texts.filter(pa.array(fine))
        line = pc.starts_with(texts, "\n").to_numpy(zero_copy_only=False)
        spaced, lines = missing[~line], missing[line]
        number[spaced] = self._learn(list(map(pieces.__getitem__, spaced.tolist())), self.later, " ")
        # the line feed is a token of its own
        own = list(map(pieces.__getitem__, lines.tolist()))
        feed = np.repeat(self._encode(["\n"])[0], len(own)), np.ones(len(own), np.int64)
        number[lines] = self.later.add(own, *_joined(feed, self.bare.ids(self._bare([p[1:] for p in own]))))
        return number, bad

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, equal to the library's for the whole text."""
        if self.later.count > CACHE_PIECES:
            self.old, self.later = self.later, Pieces()
        if self.bare.count > CACHE_PIECES:
            self.bare = Pieces()
        cut = Cut(texts)
        whole = with_special(texts, self.special)
        for i in whole:
            cut.empty(i)
        number, bad = self._later(cut.later)
        if bad:
            whole += cut.drop(bad)
        first = self._bare(cut.first)
        at = np.full(len(cut.at), -1, dtype=np.int64)
        on = cut.at >= 0
        at[on] = number[cut.at[on]]
        ids, sizes = self.later.ids(at)
        heads, length = self.bare.ids(first)
        ends = np.r_[0, np.cumsum(sizes)][cut.bounds]
        starts = np.cumsum(length) - length
        out = [np.concatenate([heads[h : h + n], ids[a:b]]) for h, n, a, b in zip(starts.tolist(), length.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        if whole:
            ids, sizes = self._encode([texts[i].as_py() for i in whole])
            for i, x in zip(whole, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _fields(width: int) -> list[tuple[int, int, int]]:
    """(value, byte, shift) of all overlaps between 8 fields of ``width`` bits and the ``width`` bytes they fill."""
    return [(i, j, (i + 1) * width - 8 * (j + 1)) for i in range(8) for j in range(width) if i * width < 8 * (j + 1) and 8 * j < (i + 1) * width]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Big-endian fields of ``width`` bits, one after the other, filled up to 8 fields with zeros."""
    v = np.zeros(-(-len(values) // 8) * 8, dtype=np.uint32)
    v[: len(values)] = values
    v = np.ascontiguousarray(v.reshape(-1, 8).T)
    out = np.zeros((width, v.shape[1]), dtype=np.uint8)
    for i, j, shift in _fields(width):
        out[j] |= (v[i] >> shift if shift >= 0 else v[i] << -shift).astype(np.uint8)
    return np.ascontiguousarray(out.T).tobytes()


def unpack_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    b = np.ascontiguousarray(data.reshape(-1, width).T).astype(np.uint32)
    out = np.zeros((8, b.shape[1]), dtype=np.uint32)
    for i, j, shift in _fields(width):
        out[i] |= b[j] << shift if shift >= 0 else b[j] >> -shift
    out &= (1 << width) - 1
    return np.ascontiguousarray(out.T).ravel()[:n]


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths (up to three levels) with the fewest bits in all."""
    top = max(1, int(ids.max(initial=1)).bit_length())
    over = [int(np.count_nonzero(ids >> k)) for k in range(top)]  # ids of more than k bits
    best, widths = math.inf, [top]
    for cuts in chain.from_iterable(combinations(range(1, top), k) for k in (0, 1, 2)):
        edges, cost = [0, *cuts, top], 0.0
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            n = len(ids) if i == 0 else over[a]
            cost += n * (b - a + (1 + 32 / RANK_BLOCK) * (b < top))
        if cost < best:
            best, widths = cost, [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return widths


def encode_file(doc_ids: list, id_lists: list[np.ndarray]) -> bytes:
    """One file of the documents' ids, in the given order."""
    ids = np.concatenate(id_lists) if id_lists else np.empty(0, dtype=np.uint32)
    starts = np.r_[0, np.cumsum([len(x) for x in id_lists], dtype=np.int64)].astype("<i8")
    keys, null = np.array([0 if d is None else d for d in doc_ids], dtype="<i8"), np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    sections, levels, rest = [keys.tobytes(), null.tobytes(), starts.tobytes()], [], ids
    for k, w in enumerate(widths := best_widths(ids)):
        last = k == len(widths) - 1
        levels.append({"bits": w, "n": len(rest)})
        sections.append(pack_bits(rest if last else rest & ((1 << w) - 1), w))
        if not last:
            more = rest >> w > 0
            ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else np.empty(0, np.int64)
            sections += [np.packbits(more).tobytes(), np.r_[0, np.cumsum(ones)[:-1]].astype("<u4").tobytes() if len(ones) else b""]
            rest = rest[more] >> w
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": levels, "sections": [len(s) for s in sections]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


class CodeFile:
    """A file's bytes, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token code file")
        (n,) = struct.unpack("<I", data[4:8])
        head = json.loads(data[8 : 8 + n])
        cut = np.cumsum([8 + n, *head["sections"]])
        part = [np.frombuffer(data, dtype=np.uint8, count=b - a, offset=a) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        null = np.unpackbits(part[1])[: head["docs"]]
        self.doc_ids = [None if z else d for d, z in zip(part[0].view("<i8").tolist(), null, strict=True)]
        self.starts, self.tokens, self.levels = part[2].view("<i8"), head["tokens"], []
        at = 3
        for k, v in enumerate(head["levels"]):
            last = k == len(head["levels"]) - 1
            self.levels.append((v["bits"], v["n"], part[at], None if last else part[at + 1], None if last else part[at + 2].view("<u4")))
            at += 1 if last else 3

    def token(self, i: int) -> int:
        """Token ``i``, from its own chunks only."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for w, _, chunks, more, ranks in self.levels:
            a, b = i * w, i * w + w
            field = int.from_bytes(chunks[a // 8 : (b + 7) // 8].tobytes(), "big") >> (-b % 8) & ((1 << w) - 1)
            value |= field << shift
            if more is None or not more[i // 8] >> (7 - i % 8) & 1:
                return value
            block = i // RANK_BLOCK
            i = int(ranks[block]) + int(np.unpackbits(more[block * RANK_BLOCK // 8 : i // 8 + 1])[: i - block * RANK_BLOCK].sum())
            shift += w
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        values: list[np.ndarray] = []
        for w, n, chunks, more, _ in self.levels:
            values.append((w, unpack_bits(chunks, w, n), None if more is None else np.unpackbits(more)[:n].astype(bool)))
        out = None
        for w, chunk, more in reversed(values):
            if more is not None and out is not None:
                chunk = chunk.copy()
                chunk[more] |= out << w
            out = chunk
        return np.empty(0, np.uint32) if out is None else out


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def write_codes(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 2, file_bytes: int = 12_000_000) -> list[dict]:
    """Encode every whole text, append ``end_id``, and write files in ascending ``key`` order below ``folder`` (a URI that
    driver and executors share; by default a new one in the shared folder). One entry per file, in order: ``path``,
    ``docs``, ``tokens``, ``base`` (tokens in the files before).

    A null text is empty (its end id alone); null keys come first; rows that repeat a key stand side by side; an empty
    table makes no file. The rows shuffle once, by key range; a task starts another file once ``file_bytes`` of text have gone
    into one, and a retried task writes files of other names, of which the list knows nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or new_path(spark, "codes")
    slim = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = 2 * max(1, docs.rdd.getNumPartitions())

    def store(keys: list, lists: list[np.ndarray]) -> str:
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.dact"
        with fs.open_output_stream(f"{top}/{name}.part") as out:
            out.write(encode_file(keys, lists))
        fs.move(f"{top}/{name}.part", f"{top}/{name}")
        return f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, lists, held, files = encoder(tokenizer), [], [], 0, []
        end, least = np.array([end_id], dtype=np.uint32), None
        for b in batches:
            for s in text_blocks(b.column(1), BLOCK):
                if not files and not keys:
                    least = b.column(0)[s.start].as_py()
                keys += b.column(0)[s].to_pylist()
                lists += [np.concatenate([x, end]) for x in own.encode(b.column(1)[s])]
                held += pc.sum(pc.binary_length(b.column(1)[s])).as_py()
                if held >= file_bytes:
                    files.append((store(keys, lists), len(keys), sum(map(len, lists))))
                    keys, lists, held = [], [], 0
                    pa.default_memory_pool().release_unused()
        if keys:
            files.append((store(keys, lists), len(keys), sum(map(len, lists))))
        if files:
            path, docs_in, tokens = zip(*files, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array([least] * len(files), pa.int64()), pa.array(range(len(files)), pa.int32()), pa.array(docs_in, pa.int64()), pa.array(tokens, pa.int64())], names=["path", "least", "place", "docs", "tokens"])

    ordered = slim.repartitionByRange(parts, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    files = ordered.mapInArrow(run, "path string, least long, place int, docs long, tokens long").collect()  # a row for each file
    out, base = [], 0
    for f in sorted(files, key=lambda f: (f["least"] is not None, f["least"] or 0, f["place"])):
        out.append({"path": f["path"], "docs": f["docs"], "tokens": f["tokens"], "base": base})
        base += f["tokens"]
    return out


def read_codes(spark, files: list[dict], key: str = "doc_id") -> DataFrame:
    """From the files alone: ``key``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = _open(path)
                with fs.open_input_stream(p) as f:
                    own = CodeFile(f.read())
                ids, s = own.all().astype("<u4"), own.starts
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(s[:-1], s[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64()), pa.array(s[:-1] + base, pa.int64()), pa.array(np.diff(s), pa.int64()), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(f["path"], f["base"]) for f in files], "path string, base long")
    return rows.repartition(max(1, len(files))).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
