"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue over all trees.

Trees are fitted on a bounded sample of the vectors and then every vector is filed in each of them. A query walks the
forest best first: the queue holds nodes of all trees by the least margin on their path, and leaves are taken until they
hold enough vectors. Leaves are joined with the queries that want them, distances in double precision are taken
block by block, and the nearest of all leaves are merged.

Equal vectors are filed once, with their k + 1 least ids: ties go to smaller ids, so no other copy can be in an answer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import cut


#: Directions that a node tries.
TRIALS = 16


class Forest:
    """Complete binary trees: ``normals[t, node]`` and ``cuts[t, node]``, leaves numbered from 0."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        inner = 2**depth - 1
        self.depth, self.trees = depth, trees
        self.normals = np.zeros((trees, inner, sample.shape[1]), dtype=np.float32)
        self.cuts = np.zeros((trees, inner), dtype=np.float32)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(inner):
                own = parts.pop(node)
                # of a few differences of random pairs, the direction along which the vectors spread most
                trial = np.zeros((TRIALS, sample.shape[1]), dtype=np.float32)
                if len(own):
                    trial = sample[own[rng.integers(0, len(own), TRIALS)]] - sample[own[rng.integers(0, len(own), TRIALS)]]
                    trial /= np.maximum(np.linalg.norm(trial, axis=1, keepdims=True), 1e-9)
                seen = sample[own[rng.integers(0, len(own), 256)]] if len(own) else sample[:0]
                k = int(np.argmax((seen @ trial.T).std(axis=0))) if len(own) else 0
                proj = sample[own] @ trial[k]
                cut = float(np.median(proj)) if len(own) else 0.0
                self.normals[t, node], self.cuts[t, node] = trial[k], cut
                right = proj > cut
                parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.empty((len(vectors), self.trees), dtype=np.int32)
        for t in range(self.trees):
            node = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.normals[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def walk(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """All (tree, leaf) in the order of the shared queue."""
        inner = 2**self.depth - 1
        queue = [(-math.inf, t, 0) for t in range(self.trees)]
        while queue:
            margin, t, node = heapq.heappop(queue)
            if node >= inner:
                yield t, node - inner
                continue
            gap = float(vector @ self.normals[t, node]) - float(self.cuts[t, node])
            near, far = (2 * node + 2, 2 * node + 1) if gap > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(margin, -abs(gap)), t, near))
            heapq.heappush(queue, (max(margin, abs(gap)), t, far))

    def search(self, vector: np.ndarray, sizes: np.ndarray, want: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until their vectors number ``want``."""
        found, total = [], 0
        for t, leaf in self.walk(vector):
            if total >= want:
                break
            if sizes[t, leaf]:
                found.append((t, leaf))
                total += int(sizes[t, leaf])
        return found

    def needs(self, vector: np.ndarray, sizes: np.ndarray, leaves: np.ndarray) -> list[int]:
        """For each row of ``leaves`` (a vector's leaf in every tree): how many vectors a search must want to reach it."""
        open_rows, total, out = set(range(len(leaves))), 0, [0] * len(leaves)
        at: dict[tuple[int, int], list[int]] = {}
        for i, row in enumerate(leaves.tolist()):
            for t, leaf in enumerate(row):
                at.setdefault((t, leaf), []).append(i)
        for place in self.walk(vector):
            for i in at.get(place, ()):
                if i in open_rows:
                    out[i] = total + 1
                    open_rows.remove(i)
            if not open_rows:
                break
            total += int(sizes[place])
        return out


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.empty((0, 0), kind)


def _wanted(asked: DataFrame, located: DataFrame, forest, counts, k: int, probes: int, recall: float) -> int:
    """How many vectors a search must want, so that ``probes`` queries find ``recall`` of their k nearest other vectors. These
    come from one pass over all vectors, in which a task keeps the k + 1 nearest of each batch; the probes' own searches
    run in tasks, and what reaches the driver are the probes and k numbers of each."""
    chosen = asked.orderBy(F.xxhash64("v"), "ask").limit(probes).select("v").toArrow()["v"]
    q = _matrix(chosen, np.float64)
    if not len(q):
        return 0
    sent = located.sparkSession.sparkContext.broadcast(q)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), np.float64)
                d = np.square(m).sum(axis=1) - 2 * q @ m.T  # less the probe's own square, which changes no order
                at = np.argpartition(d, k, axis=1)[:, : k + 1] if len(m) > k + 1 else np.tile(np.arange(len(m)), (len(q), 1))
                row = pa.array(at.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), at.shape[1])), pa.array(np.take_along_axis(d, at, axis=1).ravel()), b.column(1).take(row)], names=["probe", "d", "leaves"])

    found = located.select("v", "leaves").mapInArrow(near, "probe long, d double, leaves array<int>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("d"))).where(F.col("r").between(2, k + 1))  # the first is the probe

    def needs(rows: pa.Table) -> pa.Table:
        probe = rows["probe"][0].as_py()
        return pa.table({"need": pa.array(forest.value.needs(sent.value[probe].astype(np.float32), counts.value, _matrix(rows["leaves"], np.int64)), pa.int64())})

    need = sorted(r["need"] for r in best.groupBy("probe").applyInArrow(needs, "need long").collect())  # probes * k
    return need[min(len(need), math.ceil(recall * len(need))) - 1] if need else 0


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", k: int = 10, trees: int = 6, leaf_rows: int = 256, search_rows: int = 8000, recall: float = 0.95, probes: int = 128, sample_rows: int = 200_000, block_rows: int = 4096) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key``, ``score`` (Euclidean distance): the ``k`` nearest found of each row for
    which ``is_query`` (a Column) holds, its own id left out, nearest first, ties to the smaller id.

    Vectors that are null, zero, of another length than the commonest, or hold a null or non-finite component take no part,
    nor do null ids. Rows that repeat count once; fewer candidates than ``k`` give all of them; an empty table gives no
    rows. Trees are fitted on about ``sample_rows`` vectors, picked by hash, and have as many leaves as ``leaf_rows``
    vectors each would fill, but no more than a sixteenth of the sample; larger leaves are searched in blocks of
    ``block_rows``. A query's leaves hold ``search_rows`` vectors, counting a vector once per tree, or as many as ``probes``
    queries, picked by hash and answered exactly, need to find ``recall`` of their nearest, whichever is more. Directions
    without structure (vectors evenly spread over a sphere of 64 dimensions, say) need most of all vectors for a recall of
    0.9; where vectors cluster a few per cent do. An id that repeats with several vectors asks with each and has the nearest
    of its answers; as a candidate it counts once, with its nearest vector.
    """
    x = F.col("v")
    whole = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & x.isNotNull())
    fine = whole.where(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(math.inf))) & F.exists(x, lambda e: e != 0))
    dims = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark = vectors.sparkSession
    if not dims:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    fine = fine.where(F.size("v") == dims[0]["d"])
    least = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    filed = fine.select("id", "v").withColumn("r", least).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    filed = cut(filed, "vectors")
    n = filed.count()
    share = min(1.0, sample_rows / max(n, 1))
    sample = _matrix(filed.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()["v"])
    depth = max(0, int(math.log2(max(1, min(n // leaf_rows, len(sample) // 16)))))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = forest.value.file(_matrix(b.column(0)))
                lists = pa.ListArray.from_arrays(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1], pa.array(leaves.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["v", "ids", "leaves"])

    kind = fine.schema["v"].dataType.simpleString()
    located = cut(filed.mapInArrow(file, f"v {kind}, ids array<long>, leaves array<int>"), "leaves")
    placed = located.select("v", "ids", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 2**depth), dtype=np.int64)
    for r in located.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # at most trees * sample / 16
        sizes[r["tree"], r["leaf"]] = r["count"]
    counts = spark.sparkContext.broadcast(sizes)
    queries = fine.where(F.col("q")).select("id", "v").distinct()
    asked = queries.groupBy("v").agg(F.min("id").alias("ask"))
    want = search_rows
    if trees * n > search_rows:
        want = max(want, _wanted(asked, located, forest, counts, k, probes, recall))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = forest.value, counts.value
        for b in batches:
            rows, tree, leaf, sub = [], [], [], []
            for i, v in enumerate(_matrix(b.column(0))):
                for t, x in own.search(v, size, want):
                    for s in range(-(-int(size[t, x]) // block_rows)):
                        rows.append(i)
                        tree.append(t)
                        leaf.append(x)
                        sub.append(s)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(sub, pa.int32())], names=["v", "ask", "tree", "leaf", "sub"])

    wanted = asked.mapInArrow(walk, f"v {kind}, ask long, tree int, leaf int, sub int")
    parts = spark.createDataFrame([(int(t), int(x), int(-(-c // block_rows))) for (t, x), c in np.ndenumerate(sizes) if c > block_rows] or [(-1, -1, 1)], "tree int, leaf int, blocks int")
    # a row for each leaf above block_rows, at most trees * sample / 16
    members = placed.join(F.broadcast(parts), ["tree", "leaf"], "left").withColumn("sub", F.pmod(F.xxhash64("v"), F.coalesce("blocks", F.lit(1))).cast("int"))

    def rank(asks: pa.Table, own: pa.Table) -> pa.Table:
        q, m, ids = _matrix(asks["v"], np.float64), _matrix(own["v"], np.float64), own["ids"].to_pylist()
        out_q, out_id, out_d = [], [], []
        if len(m):
            for a, v in zip(asks["ask"].to_pylist(), q, strict=True):
                d = np.sqrt(np.square(m - v).sum(axis=1))
                near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                best = heapq.nsmallest(k + 1, ((d[i], x) for i in near.tolist() for x in ids[i]))
                out_q += [a] * len(best)
                out_d += [float(b[0]) for b in best]
                out_id += [b[1] for b in best]
        return pa.table({"ask": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_d, pa.float64())})

    found = wanted.groupBy("tree", "leaf", "sub").cogroup(members.select("v", "ids", "tree", "leaf", "sub").groupBy("tree", "leaf", "sub")).applyInArrow(rank, "ask long, id long, score double")
    merged = found.groupBy("ask", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("ask").orderBy("score", "id")
    top = merged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    each = queries.join(asked, "v").select(F.col("id").alias("query_id"), "ask").join(top, "ask").where(F.col("query_id") != F.col("id"))
    each = each.repartition("query_id").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    final = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return final.select("query_id", "rank", F.col("id").alias(key), "score")
