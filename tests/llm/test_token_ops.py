import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paytrail.llm import packing, token_codes, token_counts

TOK = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(TOK)
ODD = ["", " ", "\n", "a\n \nb", "x  y", " lead", "trail ", "a \n\n  b\t c", "it's  we'll 'S", "<|endoftext|>hi<|endoftext|> <|endoftext|>", "a" * 3000, "é　x \x85y\x1cz \x1c a", "\nb\n", "日本語 テスト", "1234 5678!!??  \n", "a\x00b \x00c", "a\r\nb"]
PARTS = st.sampled_from([" ", "\n", "a", "b", "'s", "1", "!", "é", "　", "\t", "\x1c", "  ", "<|endoftext|>", "the", "᠎", "​", "\r", "Ä", "_"])


def library(texts):
    return [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_counts_and_ids_equal_the_library_on_odd_texts():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["the", " ", "\n", "idle", ",", "ß", "7"]) for _ in range(40)) for _ in range(300)]
    want, arr = library(texts), pa.array(texts)
    assert token_counts.TokenCounter(TOK).count(arr).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in token_codes.PieceEncoder(TOK).encode(arr)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=1, max_size=4))
def test_counts_and_ids_equal_the_library(texts):
    want, arr = library(texts), pa.array(texts)
    assert token_counts.counter(TOK).count(arr).tolist() == [len(w) for w in want]
    assert [x.tolist() for x in token_codes.encoder(TOK).encode(arr)] == want


def test_cache_that_starts_afresh_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 3)
    monkeypatch.setattr(token_codes, "CACHE_PIECES", 3)
    c, e, texts = token_counts.TokenCounter(TOK), token_codes.PieceEncoder(TOK), ["one two three four", "five six", "one six"]
    for _ in range(3):
        assert c.count(pa.array(texts)).tolist() == [len(w) for w in library(texts)]
        assert [x.tolist() for x in e.encode(pa.array(texts))] == library(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 511, 513, 5000])
def test_code_file_round_trip_and_random_access(n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype(np.uint32)
    cuts = sorted(np.random.default_rng(1).integers(0, n + 1, 3).tolist())
    lists = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
    f = token_codes.CodeFile(token_codes.encode_file([None, 1, 2, 9], lists))
    assert (f.all() == ids).all() and f.doc_ids == [None, 1, 2, 9]
    assert [f.token(i) for i in range(0, n, 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        f.token(n)


def test_ids_of_any_width():
    ids = np.array([0, 1, 2**17, 2**19 + 5, 2**31, 2**32 - 1] * 3, dtype=np.uint32)
    f = token_codes.CodeFile(token_codes.encode_file([4], [ids]))
    assert (f.all() == ids).all() and [f.token(i) for i in range(len(ids))] == ids.tolist()


@pytest.mark.parametrize("width", range(1, 18))
def test_bit_fields(width):
    v = np.random.default_rng(width).integers(0, 1 << width, 1003).astype(np.uint32)
    data = np.frombuffer(token_codes.pack_bits(v, width), np.uint8)
    assert (token_codes.unpack_bits(data, width, len(v)) == v).all()


ROWS = [(3, "one two", "x"), (1, None, "y"), (2, "", "z"), (3, "one two", "x"), (None, "hello", "n"), (7, "word " * 30_000, "long")]
SCHEMA = "doc_id long, text string, n_tokens string"


def test_count_query_handles_nulls_repeats_and_clashing_columns(spark):
    out = token_counts.count_tokens(spark.createDataFrame(ROWS, SCHEMA), TOK).collect()
    want = sorted((str(k), len((t or "").encode()), len(library([t or ""])[0]), len(library([t or ""])[0]) > 1024) for k, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), TOK).count() == 0


def test_code_query_reads_back_what_the_library_gives(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for size in (12_000_000, 4):
        files = token_codes.write_codes(df, TOK, file_bytes=size)
        out = sorted(token_codes.read_codes(spark, files).collect(), key=lambda r: r.start)
        start, want = 0, []
        for k, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = np.array(library([t or ""])[0] + [2], dtype="<u4")
            want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r) for r in out] == want
    assert token_codes.read_codes(spark, token_codes.write_codes(spark.createDataFrame([], SCHEMA), TOK)).count() == 0


def check_packing(rows, sizes):
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_offset, r.piece_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), own in bins.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert size == min(s for s in sizes if s >= at)


def test_packing_keeps_every_token_and_downsizes(spark):
    sizes = (8, 16, 64)
    out = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), TOK, sizes).collect()
    check_packing(out, sizes)
    want = {}
    for k, t, _ in ROWS:
        want[k] = want.get(k, 0) + len(library([t or ""])[0]) + 1
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.piece_tokens
    assert got == want
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), TOK).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_every_bin_is_opened_at_the_least_cost(lengths):
    sizes, lengths = [8, 16, 64], sorted(lengths, reverse=True)
    bins = []  # [size, contents, last use], by plain search
    least = lambda n: min(s for s in sizes if s >= n)

    def rate(i, size):
        held = lengths[i]
        for n in lengths[i + 1 :]:
            held += n if n <= size - held else 0
        return packing.sequence_cost(least(held)) / held

    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if not fits:
            fits = [[min((s for s in sizes if s >= n), key=lambda s: (rate(i, s), s)), 0, 0]]
            bins += fits
        own = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
        own[1], own[2] = own[1] + n, i
    own, final = packing.pack_lengths(lengths, sizes)
    assert sorted(final) == sorted(least(b[1]) for b in bins)
    held = [0] * len(final)
    for b, n in zip(own, lengths):
        held[b] += n
    assert [least(h) for h in held] == final


def test_packing_does_not_depend_on_partitioning(spark):
    rows = [(k, "word " * (7 * k % 90), "x") for k in range(300)] + [(5, "same", "y")] * 100 + [(None, "none", "n")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(tuple, packing.pack_documents(docs.repartition(n, "text") if n > 1 else docs.coalesce(1), TOK, (16, 64, 256), group_rows=50).collect()), key=str) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and len({r[5] >> 32 for r in got[0] if r[0] == 5}) > 1
    assert sum(r[2] == 0 for r in got[0]) == len(rows)
