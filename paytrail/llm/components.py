"""Connected components of an edge table: forests in each task, then alternating star contraction.

Every task first replaces the edges that it has read by a forest, in which each node hangs on the least node that it is
joined with there. Forests that together have no more than ``one_task`` edges (16 bytes each) are joined by one task.
Larger ones go through rounds: each hangs every node on the least neighbour it knows (large star), then joins the hubs
(small star), until no edge changes. Rounds are aggregates and equi-joins; nothing is gathered on the driver but one count
and checksum per round, taken while the round's table is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from paytrail.plans.cut import cut


#: Edges that one task may join (they and its arrays take about 100 MB).
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of the edges that isn't the least of its component, with that one."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))  # a root hangs on a lesser one, so there is no cycle
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterator[pa.RecordBatch], held: int = ONE_TASK) -> Iterator[pa.RecordBatch]:
    """The forest of the task's edges; where it would have more than half of ``held``, several forests of parts of them."""
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    own, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    for part in batches:
        own.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
        size += part.num_rows
        if size >= held:
            own = [forest(*map(np.concatenate, zip(*own, strict=True)))]
            if (size := len(own[0][0])) > held // 2:
                yield batch(*own[0])
                own, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    yield batch(*forest(*map(np.concatenate, zip(*own, strict=True))))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _observed(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, with their number and a checksum."""
    seen = Observation()
    table = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "components")
    return table, seen.get


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``a``, ``b`` (integer nodes) -> ``node``, ``root`` (least node of its component), for every node that an edge of two
    different nodes has. Repeated and reversed edges don't matter; nulls are left out; no edges give no rows."""
    joined = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now, mark = _observed(joined.mapInArrow(_forests, "a long, b long"))
    if mark["n"] <= one_task:
        # at most ``one_task`` edges, as counted
        now = cut(now.coalesce(1).mapInArrow(_forests, "a long, b long"), "components")
    else:
        before = None
        while mark != before:
            before = mark
            now, mark = _observed(_small(_large(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
