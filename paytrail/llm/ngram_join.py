"""N-gram Jaccard self-join by MinHash banding.

1. One pass turns each text into hashed word n-grams, a digest of the set, and one hash per band of MinHash values. Texts
   with one n-gram set form a class, found by an aggregate on the digest; only classes go on.
2. Class representatives that share a band are candidates. Each bucket yields one edge per member (to its least), never
   its pairs, and the components of these edges bring possible partners together, each n-gram set shipped once.
3. Within a component the full n-gram sets are compared through an inverted index. A component whose sets exceed
   ``block_grams`` is dealt into blocks and every pair of blocks is compared by a task of its own.

The number of bands and rows is chosen for a target recall at the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import cut

from .components import connected_components
from .pieces import text_blocks
from .storage import bound_batches, free_name
from .words import strings, word_numbers

#: Rows of document ids that may be broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)


def choose_bands(threshold: float, recall: float = 0.9999, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands still reach ``recall`` at ``threshold`` within ``hashes`` values."""
    for rows in range(hashes, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashed word n-grams of lower-cased texts; fewer than ``n`` words make one n-gram, no words none."""

    def __init__(self, n: int):
        self.n = n
        self.weights = _mix(np.arange(1, n + 2, dtype=np.uint64) * _M) | np.uint64(1)

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all n-grams, how many each text has), in order and with repeats."""
        distinct, at, bounds = word_numbers(texts, lower=True)
        sizes = np.diff(bounds)
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, strings(distinct)), dtype=np.uint64, count=len(distinct))[at]
        many = np.where(sizes >= self.n, sizes - self.n + 1, np.minimum(sizes, 1))
        first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        width = np.repeat(np.minimum(sizes, self.n), many)
        out = width.astype(np.uint64) * self.weights[self.n]
        for k in range(self.n):
            on = width > k
            out[on] += words[first[on] + k] * self.weights[k] if not on.all() else words[first + k] * self.weights[k]
        return _mix(out), many


def band_hashes(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row per text (which must have n-grams), a column per band."""
    out = np.empty((len(starts), bands), dtype=np.uint64)
    salt = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _M)
    for b in range(bands):
        acc = np.full(len(starts), salt[b])
        for r in range(rows):
            k = salt[b * rows + r]
            acc = _mix(acc ^ np.minimum.reduceat((grams ^ k) * (k | np.uint64(1)), starts))
        out[:, b] = acc
    return out


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """``key``, ``digest`` of the n-gram set (null without n-grams), ``grams`` (its size), ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(n)
        for batch in batches:
            for s in text_blocks(batch.column(1), 500_000):
                grams, many = own.grams(batch.column(1)[s])
                starts = np.cumsum(many) - many
                some = many > 0
                hashes = band_hashes(grams, starts[some], bands, rows).view(np.int64) if some.any() else np.empty((0, bands), np.int64)
                sets = [np.unique(grams[a : a + m]) for a, m in zip(starts, many, strict=True)]
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(some * bands)].astype(np.int32), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), pa.array(digest, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), lists], names=["doc", "digest", "grams", "bands"])

    slim = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return slim.mapInArrow(run, "doc long, digest binary, grams int, bands array<long>")


def _compare(rows: pa.Table, threshold: float) -> pa.Table:
    """Members of one component, or of one pair of its blocks -> rep, root (least linked rep here), links (documents)."""
    rep, size, blk = (rows[c].to_numpy() for c in ("rep", "size", "blk"))
    _, once = np.unique(rep, return_index=True)  # a repeated key is compared once
    rep, size, blk = rep[once], size[once], blk[once]
    sets = rows["set"].combine_chunks()
    bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    values = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in once])
    lengths = (bounds[once + 1] - bounds[once]).astype(np.int64)
    starts = np.r_[0, np.cumsum(lengths)]
    m = len(rep)
    code = np.unique(values, return_inverse=True)[1]
    owner = np.repeat(np.arange(m), lengths)
    order = np.argsort(code, kind="stable")  # owners ascend within a code
    posting, first = owner[order], np.r_[0, np.cumsum(np.bincount(code))]
    place = np.empty(len(code), dtype=np.int64)
    place[order] = np.arange(len(code))
    stop = first[code + 1]
    links, parent = np.zeros(m, dtype=np.int64), list(range(m))
    split = rows["i"][0] != rows["j"][0]  # of two blocks, only pairs across them

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(m - 1):
        a, b = starts[i], starts[i + 1]
        count = stop[a:b] - place[a:b] - 1  # later owners of each of its n-grams
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(place[a:b] + 1 - (np.cumsum(count) - count), count) + np.arange(total)
        shared = np.bincount(posting[at], minlength=m)
        on = np.flatnonzero(shared)
        both = shared[on]
        on = on[both >= threshold * (lengths[i] + lengths[on] - both) - 1e-9]
        if split:
            on = on[blk[on] != blk[i]]
        if len(on):
            links[i] += size[on].sum()
            links[on] += size[i]
            r = find(i)
            for j in on.tolist():
                q = find(j)
                if q != r:
                    parent[max(q, r)] = r = min(q, r)
    root = rep[[find(i) for i in range(m)]]  # rep ascends, so the least index is the least rep
    return pa.table({"rep": pa.array(rep, pa.int64()), "root": pa.array(root, pa.int64()), "links": pa.array(links, pa.int64())})


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block_grams: int = 1_000_000) -> DataFrame:
    """One row per input row: ``key``, ``class_id`` (least key that a chain of links reaches), ``n_links`` (documents with
    Jaccard similarity of at least ``threshold``, copies included), ``set_id`` (least key with the same n-gram set),
    ``set_size`` (documents that have it), ``n_grams``.

    Words are lower-cased runs without white space. A text of fewer than ``n`` words is one n-gram; a null, empty or blank
    text has none and links with nothing, itself a class. Rows with a null key come back with null ``class_id`` and no
    links. Repeated rows count as documents; ``key`` should not stand for two different texts (one of them is compared).
    A pair at the threshold is missed with probability 1 - ``recall`` at most; every reported link is exact.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    table = cut(signatures(docs, key, text, n, bands, rows), "signatures")
    known = table.where(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    # first() takes one copy's bands: equal sets have equal bands
    classes = cut(known.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("size"), F.first("grams").alias("n_grams"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("h"))
    least = keyed.groupBy("h").agg(F.min("rep").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    linked = connected_components(keyed.join(least, "h").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    members = linked.join(classes.select(F.col("rep").alias("node"), "size", "n_grams"), "node")
    weight = members.groupBy("root").agg(F.sum("n_grams").alias("g")).withColumn("nb", F.ceil(F.col("g") / block_grams).cast("int"))
    info = cut(members.join(weight, "root").select(F.col("node").alias("rep"), "root", "size", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("blk")), "members")
    held = info.agg(F.count("*").alias("rows"), F.max("nb").alias("blocks")).first()
    small = held["rows"] <= BROADCAST_ROWS

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(n)
        for batch in batches:
            for s in text_blocks(batch.column("t"), 500_000):
                grams, many = own.grams(batch.column("t")[s])
                sets = [np.unique(grams[a - m : a]) for a, m in zip(np.cumsum(many), many, strict=True)]
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("root", "rep", "size", "nb", "blk")] + [lists], names=["root", "rep", "size", "nb", "blk", "set"])

    slim = docs.select(F.col(key).cast("long").alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chosen = slim.join(F.broadcast(info) if small else info, "rep").select("root", "rep", "size", "nb", "blk", "t")
    sets = chosen.mapInArrow(full_sets, "root long, rep long, size long, nb int, blk int, set array<long>")
    pairs = sets.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")})
    compared = pairs.groupBy("root", "i", "j").applyInArrow(lambda t: _compare(t, threshold), "rep long, root long, links long")
    found = cut(compared, "compared")
    # a component in one block has its root; those of several blocks are joined through their blocks' roots
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))) if (held["blocks"] or 0) > 1 else None
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root0"))
    if roots is not None:
        links = links.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        links = links.withColumn("root", F.col("root0"))
    done = classes.select("digest", "rep", "size", "n_grams").join(links, "rep", "left")
    out = table.select("doc", "digest").join(done.withColumn("one", F.lit(True)), "digest", "left")
    on = F.col("one").isNotNull() & F.col("doc").isNotNull()
    return out.select(
        F.col("doc").alias(key), F.when(on, F.coalesce("root", "root0", "rep")).otherwise(F.col("doc")).alias("class_id"),
        F.when(on, F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(on, F.col("rep")).otherwise(F.col("doc")).alias("set_id"), F.when(on, F.col("size")).otherwise(1).cast("long").alias("set_size"), F.coalesce("n_grams", F.lit(0)).cast("int").alias("n_grams"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class, all columns: that with the least key and, of one key's rows, the
    first; one with a null key only if no row of the class has a key. Rows are numbered once by place and compared under their
    numbers, so rows that repeat a key, or have none, are told apart."""
    number = free_name("__near_row", docs)
    rows = cut(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = near_classes(rows, number, text, **options).select(number, "class_id")
    least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col(number).alias("row")))
    kept = classes.join(rows.select(number, key), number).groupBy("class_id").agg(least.alias("least")).select(F.col("least.row").alias(number))
    return rows.join(kept, number, "left_semi").select(docs.columns)
