"""Hard negatives by one-dimensional distance keys.

Inner products become distances: a vector gets one more component, so that all have the length of the longest; then the
squared distance to a query (with a zero there) is a constant less twice the inner product. Each vector belongs to its
nearest pivot and is keyed by its distance to it; vectors are stored sorted by (pivot, distance) in blocks. By the triangle
inequality the block of an annulus can't hold anything nearer to a query than the gap between the annulus and the
query's own distance to the pivot. A search takes blocks in the order of these gaps, a few and then ever more, until the
least gap left exceeds the distance of what it has found: its answer is then certain.

The positives of an anchor are searched among the vectors of its label, the negatives of a positive among the others, from
the positive's score downward, which is from an inner sphere outward.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut, cut

from .storage import bound_batches

#: Directory entries (four numbers each) that tasks may hold; blocks grow with the table so that there are no more.
MOST_BLOCKS = 200_000
#: Copies of queries in one batch of a plan.
BATCH_ASKS = 50_000
#: Beyond any score.
TOP = 2**62
INDEX = "block long, pivot int, lo double, hi double, v array<array<int>>, labels array<long>, ids array<array<long>>"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


class Space:
    """Pivots of the vectors with their added component, and the square that all vectors reach by it."""

    def __init__(self, sample: np.ndarray, square: float, pivots: int, rounds: int = 6, seed: int = 11):
        self.square, self.room = square, 1e-6 * (1 + 2 * math.sqrt(square))  # room for rounding in distances
        rng = np.random.default_rng(seed)
        own = self.lifted(sample)
        self.pivots = own[rng.permutation(len(own))[:pivots]]
        for _ in range(rounds):  # means of the nearest
            near = self.distances(own).argmin(axis=1)
            n = np.bincount(near, minlength=len(self.pivots))
            sums = np.zeros_like(self.pivots)
            np.add.at(sums, near, own)
            self.pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.pivots)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(0.0, self.square - np.square(v).sum(axis=1)))]

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To every pivot."""
        squares = np.square(lifted).sum(axis=1)[:, None] + np.square(self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0.0, squares))

    def radius(self, v: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from the query of what has the score."""
        return np.sqrt(np.maximum(0.0, np.square(v).sum(axis=-1) + self.square - 2.0 * score))


def _plan(space: Space, directory: tuple, asks: pa.Table, dims: int, done: int, step: int) -> Iterator[pa.RecordBatch]:
    """Which blocks the queries search next, a row for each block that some of them want: of the ``step`` blocks after the
    ``done`` nearest those that may hold a score between one of the query's (low, top)."""
    block, pivot, lo, hi = directory
    v = _matrix(asks["v"], dims)
    far = space.distances(np.c_[v, np.zeros(len(v))])
    wanted: list[list[int]] = []
    for i, (q, tops, lows) in enumerate(zip(v, asks["tops"].to_pylist(), asks["lows"].to_pylist(), strict=True)):
        own = far[i, pivot]
        gap = np.maximum(0.0, np.maximum(own - hi, lo - own))
        order = np.argsort(gap, kind="stable")[done : done + step]
        inner, outer = space.radius(q, np.array(tops, dtype=np.float64)), space.radius(q, np.array(lows, dtype=np.float64))
        may = (gap[order, None] <= outer + space.room) & ((own + hi)[order, None] >= inner - space.room)
        wanted.append(order[may.any(axis=1)].tolist())
    by: dict[int, list[int]] = {}
    for i, places in enumerate(wanted):
        for b in places:
            by.setdefault(b, []).append(i)
    held, n = [], 0
    for k, b in enumerate(sorted(by)):
        held.append(b)
        n += len(by[b])
        if n >= BATCH_ASKS or k == len(by) - 1:
            sizes, at = [len(by[b]) for b in held], pa.array([i for b in held for i in by[b]], pa.int64())
            columns = [_lists(asks[c].combine_chunks().take(at), sizes) for c in ("gid", "label", "v", "tops", "lows")]
            yield pa.RecordBatch.from_arrays([pa.array(block[held]), *columns], names=["block", "gid", "label", "q", "tops", "lows"])
            held, n = [], 0


def _best(scores: np.ndarray, at: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int]]:
    """The first ``k`` (-score, id) of the items ``at``."""
    if len(at) > 4 * k:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return sorted((-int(scores[j]), x) for j in at.tolist() for x in ids[j])[:k]


def _scan(dims: int, k: int, same: bool):
    """For every query of a row and each of its (low, top): the first ``k`` of the row's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in range(b.num_rows):
                own = {name: b.column(name)[r].values for name in ("gid", "label", "q", "tops", "lows", "v", "labels", "ids")}
                scores = _matrix(own["q"], dims) @ _matrix(own["v"], dims).T  # whole numbers below 2**53
                labels, ids = own["labels"].to_numpy(), own["ids"].to_pylist()
                for gid, label, s, tops, lows in zip(own["gid"].to_pylist(), own["label"].to_pylist(), scores, own["tops"].to_pylist(), own["lows"].to_pylist(), strict=True):
                    fits = np.flatnonzero(((labels == label) == same) & (s >= min(lows)) & (s <= max(tops)))
                    for top, low in zip(tops, lows, strict=True) if len(fits) else ():
                        out += [(gid, top, -minus, x) for minus, x in _best(s, fits[(s[fits] <= top) & (s[fits] >= low)], ids, k)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gid", "top", "score", "id"])

    return run


def _first(rows: DataFrame, by: list[str], k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col(name) <= k)


class DistanceKeys:
    """Vectors stored by (pivot, distance), with a directory of the blocks. ``items``: ``gid``, ``v``, ``label``, ``ids``."""

    def __init__(self, items: DataFrame, n: int, dims: int, square: float, block_rows: int, sample_rows: int):
        spark = items.sparkSession
        share = min(1.0, sample_rows / n)
        sample = _matrix(items.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * sample_rows).toArrow()["v"], dims)
        self.dims, self.rows = dims, max(block_rows, math.ceil(n / MOST_BLOCKS))
        space = Space(sample, square, max(1, min(1024, n // (4 * self.rows), len(sample))))
        self.space = spark.sparkContext.broadcast(space)
        self.located = cut(items.mapInArrow(self._locate(), "gid long, v array<int>, label long, ids array<long>, asks boolean, pivot int, dist double"), "located")
        parts = math.ceil(n / (16 * self.rows))
        dealt = self.located.repartitionByRange(parts, "pivot", "dist", F.xxhash64("v")).sortWithinPartitions("pivot", "dist")
        self.index = cut(dealt.mapInArrow(self._pack(), INDEX), "distance-keys")
        found = self.index.select("block", "pivot", "lo", "hi").toArrow()  # at most MOST_BLOCKS, one for each pivot and one for each part
        order = np.lexsort((found["lo"].to_numpy(), found["pivot"].to_numpy()))
        self.blocks = len(order)
        self.directory = spark.sparkContext.broadcast(tuple(found[c].to_numpy()[order] for c in ("block", "pivot", "lo", "hi")))

    def _locate(self):
        space, dims = self.space, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                far = space.value.distances(space.value.lifted(_matrix(b.column("v"), dims))) if b.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("gid", "v", "label", "ids", "asks")), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1, initial=math.inf))], names=["gid", "v", "label", "ids", "asks", "pivot", "dist"])

        return run

    def _pack(self):
        most = self.rows

        def block(rows: pa.Table) -> pa.RecordBatch:
            from pyspark import TaskContext

            block.number += 1
            values = [_lists(rows[c].combine_chunks(), [rows.num_rows]) for c in ("v", "label", "ids")]
            head = [pa.array([(TaskContext.get().partitionId() << 32) + block.number]), rows["pivot"].combine_chunks()[:1], rows["dist"].combine_chunks()[:1], rows["dist"].combine_chunks()[-1:]]
            return pa.RecordBatch.from_arrays([*head, *values], names=["block", "pivot", "lo", "hi", "v", "labels", "ids"])

        block.number = 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                pivots = b.column("pivot").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    while x < y:
                        if held and held[0].column("pivot")[0].as_py() != pivots[x]:
                            yield block(pa.Table.from_batches(held))
                            held = []
                        take = min(y - x, most - sum(h.num_rows for h in held))
                        held.append(b.slice(x, take))
                        x += take
                        if sum(h.num_rows for h in held) == most:
                            yield block(pa.Table.from_batches(held))
                            held = []
            if held:
                yield block(pa.Table.from_batches(held))

        return run

    def search(self, asks: DataFrame, k: int, same: bool, first: int = 8, grow: int = 4) -> DataFrame:
        """``gid``, ``top``, ``score``, ``id``, ``rank``: for each query and each of its ``tops`` the first ``k`` rows of the same
        (or of another) label that score between low and top. ``asks``: ``gid``, ``label``, ``v``, ``tops``, ``lows``."""
        spark, dims, space, directory = asks.sparkSession, self.dims, self.space, self.directory
        found, done, step = spark.createDataFrame([], "gid long, top long, score long, id long, rank int"), 0, first
        m = max(1, min(self.blocks, 4096))
        index = self.index.select("block", "v", "labels", "ids")
        while done < self.blocks:

            def plan(batches: Iterator[pa.RecordBatch], done=done, step=step) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(0, b.num_rows, 512):
                        yield from _plan(space.value, directory.value, pa.Table.from_batches([b.slice(i, 512)]), dims, done, step)

            # a low rises to the score of the k-th found so far
            risen = found.where(F.col("rank") == k).groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("top", "score"))).alias("at"))
            lows = F.zip_with("tops", "lows", lambda t, x: F.greatest(x, F.coalesce(F.try_element_at("at", t), x)))
            state = asks.join(risen, "gid", "left").withColumn("lows", F.when(F.col("at").isNull(), F.col("lows")).otherwise(lows)).drop("at")
            wants, n = counted_cut(state.mapInArrow(plan, "block long, gid array<long>, label array<long>, q array<array<int>>, tops array<array<long>>, lows array<array<long>>"), "annuli")
            if not n:
                break
            met = wants.repartition(m, "block").join(index.repartition(m, "block"), "block").drop("block")
            new = met.mapInArrow(_scan(dims, k, same), "gid long, top long, score long, id long")
            found = cut(_first(found.drop("rank").unionByName(new), ["gid", "top"], k), "nearest")
            done, step = done + step, step * grow
        return found


def _items(vectors: DataFrame, key: str, column: str, label: str, is_anchor: Column) -> DataFrame:
    """``id``, ``label``, ``v`` (whole numbers) and ``q`` of the rows that take part."""
    x = F.col("x")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(column).alias("x"), is_anchor.alias("q"))
    fine = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0))
    fine = fine.where(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(math.inf))))
    turned = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return fine.select("id", turned.alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("v"), F.coalesce("q", F.lit(False)).alias("q"))


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", column: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, block_rows: int = 1024, sample_rows: int = 50_000) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``: for each anchor and
    each of its ``positives`` first other rows of its label, the ``negatives`` first rows of other labels that score from four
    fifths of the positive's score up to it. Higher scores come first, ties by smaller id. Exact: every search goes on until
    what it has found is certain.

    Components are floor(256 x); where the key is divisible by 7 the label becomes (label + 1) % 10 first. Rows with a null
    key, label or vector, an empty vector, or a null or non-finite component take no part, nor do vectors of another length
    than the commonest, or ones whose scores might leave the whole numbers that a double holds (64 components beyond 2**23,
    say). Equal vectors of one label are stored once with their least ids, and search once. Rows that repeat are one; an id
    with several vectors or labels is a row for each, and as an anchor each of them has its own positives; another row is
    one with another id. An empty table gives no rows. Pivots are fitted on about ``sample_rows`` vectors picked by hash.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kept = max(positives, negatives) + 1
    rows = _items(vectors, key, column, label, is_anchor)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return spark.createDataFrame([], result)
    d = dims[0]["d"]
    most = math.isqrt(2**53 // d) - 1
    rows = rows.where((F.size("v") == d) & ~F.exists("v", lambda e: F.abs(e) > most)).withColumn("v", F.col("v").cast("array<int>"))
    # the least ids of each vector and label; the limit on the rank applies before the shuffle too
    least = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v", "label").orderBy("id"))).where(F.col("r") <= kept)
    items = least.groupBy("v", "label").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    anchors = rows.where("q").select(F.col("id").alias("anchor_id"), "v", "label").distinct()
    asking = anchors.select("v", "label").distinct().withColumn("asks", F.lit(True))
    items = items.join(asking, ["v", "label"], "left").select(F.monotonically_increasing_id().alias("gid"), "v", "label", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    items, n = counted_cut(items, "vectors")
    if not n:
        return spark.createDataFrame([], result)
    square = items.select(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e.cast("long") * e))).first()[0]
    keys = DistanceKeys(items, n, d, float(square), block_rows, sample_rows)
    asks = keys.located.where("asks").select("gid", "label", "v", "pivot", "dist")
    queries = asks.count()
    asks = cut(asks.repartitionByRange(max(1, math.ceil(queries / 2048)), "pivot", "dist").sortWithinPartitions("pivot", "dist").drop("pivot", "dist"), "queries")
    near = keys.search(asks.withColumns({"tops": F.array(F.lit(TOP)), "lows": F.array(F.lit(-TOP))}), positives + 1, True)
    own = anchors.join(items.where("asks").select("gid", "v", "label"), ["v", "label"]).select("anchor_id", "gid")
    pairs = own.join(near.drop("rank"), "gid").where(F.col("id") != F.col("anchor_id"))
    pairs = cut(_first(pairs, ["anchor_id", "gid"], positives).select("anchor_id", "gid", F.col("id").alias("positive_id"), F.col("score").alias("top")), "positives")
    tops = pairs.where("top >= 0").groupBy("gid").agg(F.sort_array(F.collect_set("top")).alias("tops"))  # at most positives + 1 each
    windows = asks.join(tops, "gid").withColumn("lows", F.transform("tops", lambda t: ((t * 4 + 4 - (t * 4 + 4) % 5) / 5).cast("long")))  # four fifths, rounded up
    hard = keys.search(cut(windows, "windows"), negatives + 1, False)  # one may be the anchor's id with another label
    out = pairs.join(hard.drop("rank"), ["gid", "top"]).where(F.col("id") != F.col("anchor_id"))
    out = _first(out, ["anchor_id", "gid", "positive_id", "top"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = """
with items as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as s
  from items a join items b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, other_id as positive_id, s as ps from scores where same qualify row_number() over (partition by anchor_id order by s desc, other_id) <= 5),
negatives as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by s desc, other_id)::int as rank, other_id as negative_id, ps as positive_score, s as negative_score
  from positives join scores using (anchor_id) where not same and 80 * ps <= 100 * s and s <= ps)
select * from negatives where rank <= 5"""
