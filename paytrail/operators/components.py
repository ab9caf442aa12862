"""Connected components of a link table: what the senders of a block, or the blocks of a stack, form.

Every task replaces the links that it has read by a forest, in which each node hangs on the least one that it is joined
with there. Forests that together have no more than ``one_task`` links are joined by one task; larger ones in rounds of
least labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut, cut

#: Links that one task may join.
ONE_TASK = 1_000_000


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all nodes, ascending, the least node of each one's component)."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))  # a root hangs on a lesser one
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _joiner(names: list[str], kind: pa.DataType, trees: bool, held: int = ONE_TASK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass that yields (node, root): of all nodes, or for ``trees`` only of those that aren't roots; then links come in
    lots of ``held``, so that a task's memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> pa.RecordBatch:
            nodes, roots = least_roots(*(np.concatenate([c.to_numpy(zero_copy_only=False) for c in col]) for col in zip(*own, strict=True)))
            keep = nodes != roots if trees else np.ones(len(nodes), dtype=bool)
            return pa.RecordBatch.from_arrays([pa.array(x[keep], kind) for x in (nodes, roots)], names=names)

        own, size = [], 0
        for b in batches:
            if b.num_rows:
                own.append((b.column(0), b.column(1)))
                size += b.num_rows
            if trees and size >= held:
                yield joined()
                own, size = [], 0
        if own:
            yield joined()

    return run


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``a``, ``b`` -> ``node``, ``root`` (least node it is connected with), for every node of a link between two nodes."""
    spark_kind = edges.schema["a"].dataType.simpleString()
    kind = pa.int64() if spark_kind == "bigint" else pa.string()
    links, n = counted_cut(edges.select("a", "b").where("a <> b").mapInArrow(_joiner(["a", "b"], kind, True), f"a {spark_kind}, b {spark_kind}"), "links")
    if n <= one_task:
        # at most ``one_task`` links, as counted
        return links.coalesce(1).mapInArrow(_joiner(["node", "root"], kind, False), f"node {spark_kind}, root {spark_kind}")
    return _rounds(links)


def _rounds(edges: DataFrame) -> DataFrame:
    """Each round takes the least label among the neighbours and then that label's own label, so a chain halves per round."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.withColumnRenamed("root", "was").join(around, "node").select("node", "was", F.least("was", "near").alias("root"))
        jump = step.join(label.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        now = cut(jump.select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        label = now.drop("was")
        if not now.where("root <> was").limit(1).count():
            return label
