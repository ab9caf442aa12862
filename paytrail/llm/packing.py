"""Variable-capacity best-fit packing of documents into training sequences.

Pieces go, longest first, into the open bin with the least room that still holds them. Where none does, a bin of the
least-cost size is opened: for every permitted size that holds the piece, the pieces still to come are laid into it, each
time the longest that fits, and the size whose contents cost least per token is taken. The sizes are thus chosen bin by
bin, all together, against what is left to pack. In the end every bin is downsized to the least size that holds its contents.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import cut

from .token_counts import count_tokens

#: Permitted sequence lengths of the production query.
SIZES = (512, 1024, 2048, 4096, 8192)
#: Rows that repeat key and text and are dealt to one group together.
COPIES = 16


def sequence_cost(size: int) -> float:
    """Work of a padded sequence: linear layers, attention that grows with the square, and a fixed part."""
    return size * (1 + size / 65536) + 32


def prospect(lengths: Sequence[int], order: Sequence[int], at: int, size: int) -> int:
    """Tokens in a bin of ``size`` that holds piece ``at`` and, of the later pieces, always the longest that fits next.
    ``lengths`` descend, ``order`` are their negatives."""
    left, nxt = size - lengths[at], at + 1
    while left and (nxt := bisect.bisect_left(order, -left, nxt)) < len(lengths):
        left -= lengths[nxt]
        nxt += 1
    return size - left


def pack_lengths(lengths: Sequence[int], sizes: Sequence[int], cost=sequence_cost) -> tuple[list[int], list[int]]:
    """(bin of each length, size of each bin) for descending lengths by best fit; a new bin has the size whose prospect costs
    least per token, ties go to the smaller one; bins are downsized at last."""
    sizes = sorted(sizes)
    least = lambda n: sizes[bisect.bisect_left(sizes, n)]
    order = [-n for n in lengths]
    room: dict[int, list[int]] = {}  # open bins by the room left
    rooms: list[int] = []  # its keys, ascending
    bins, filled = [], []
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            own = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            may = {s: prospect(lengths, order, i, s) for s in sizes[bisect.bisect_left(sizes, n) :]}
            own, left = len(filled), min(may, key=lambda s: (cost(least(may[s])) / may[s], s))
            filled.append(0)
        bins.append(own)
        filled[own] += n
        left -= n
        if left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append(own)
    return bins, [least(f) for f in filled]


def pack_documents(docs: DataFrame, tokenizer: str, sizes: Sequence[int] = SIZES, key: str = "doc_id", text: str = "text", group_rows: int = 4096) -> DataFrame:
    """One row per piece: ``key``, ``row_tokens`` (tokens of the text and its end mark), ``piece`` (from 0), ``piece_start``,
    ``piece_tokens``, ``bin_id``, ``bin_size``, ``bin_offset``.

    A text longer than the largest size is cut into full pieces and a rest, so no token is lost; every other text stays
    whole. A null or empty text has its end mark alone. Rows that repeat a key are packed each; a null key is carried
    along. The rows are dealt by hash of key and text into groups of about ``group_rows``, which are packed
    independently: work per task stays the same at any size, and only (key, tokens) shuffle. Rows that repeat key and text
    are counted and dealt ``COPIES`` at a time, so they spread over groups. Neither the groups nor the bins
    depend on how the rows are partitioned. No rows, no bins.
    """
    sizes = sorted({int(s) for s in sizes})
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes must be positive")
    slim = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    counted = cut(count_tokens(slim, tokenizer, text="t", keep=["k", "h"]).select("k", "h", (F.col("n_tokens") + 1).alias("n")), "lengths")
    groups = max(1, math.ceil(counted.count() / group_rows))
    times = counted.groupBy("k", "h", "n").agg(F.count("*").alias("c")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / COPIES).cast("int"))))
    dealt = times.select("k", "h", "n", F.least(F.col("c") - F.col("part") * COPIES, F.lit(COPIES)).cast("int").alias("c"), F.pmod(F.xxhash64("h", "part"), F.lit(groups)).alias("g"))
    kind = docs.schema[key].dataType.simpleString()

    def pack(rows: pa.Table) -> pa.Table:
        g = rows["g"][0].as_py()
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows["c"].to_numpy())))
        n = rows["n"].to_numpy()
        pieces = -(-n // sizes[-1])
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * sizes[-1]
        length = np.minimum(n[row] - start, sizes[-1])
        order = np.lexsort((piece, rows["h"].to_numpy()[row], -length))
        bins, final = pack_lengths(length[order].tolist(), sizes)
        own = np.array(bins)
        by_bin = np.argsort(own, kind="stable")
        sorted_len, first = length[order][by_bin], np.r_[True, np.diff(own[by_bin]) != 0]
        ends = np.cumsum(sorted_len) - sorted_len
        offset = np.empty(len(own), dtype=np.int64)
        offset[by_bin] = ends - np.repeat(ends[first], np.diff(np.r_[np.flatnonzero(first), len(own)]))
        taken = pa.array(row[order])
        return pa.table({
            "k": rows["k"].take(taken), "row_tokens": rows["n"].take(taken), "piece": pa.array(piece[order], pa.int32()),
            "piece_start": pa.array(start[order], pa.int64()), "piece_tokens": pa.array(length[order], pa.int64()),
            "bin_id": pa.array((int(g) << 32) + own, pa.int64()), "bin_size": pa.array(np.array(final)[own], pa.int32()), "bin_offset": pa.array(offset, pa.int64()),
        })

    out = dealt.groupBy("g").applyInArrow(pack, f"k {kind}, row_tokens long, piece int, piece_start long, piece_tokens long, bin_id long, bin_size int, bin_offset long")
    return out.withColumnRenamed("k", key)
