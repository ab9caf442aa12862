"""Ordered greedy suppression: a set stays unless one that comes before it, and stays, covers most of it.

Sets are numbered in their order first, so all that follows compares longs. Equal sets share their fate: only the first of
them is compared, the others go wherever it goes, or to it. Which sets may cover another is found by a prefix filter: who
holds more than ``overlap`` of a set's n refs holds one of its rarest n - floor(overlap n), so only these are looked up, and
what they find is verified on the whole sets. Refs that many sets look up and hold are dealt over several tasks.

The order makes the choice sequential in principle; in rounds it is a plan of joins. A set is decided once every earlier set
that covers it is: it goes if one of them stays, else it stays. While the pairs are few (their number is checked) one task
takes them in order instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut, cut, settled

#: Pairs up to which one task takes the sets in order; more are decided in rounds.
FOLD_PAIRS = 500_000
#: Sets of one ref that a task meets; a ref that more sets hold is dealt over several.
HOT_REF = 4096


def in_order(sets: DataFrame) -> DataFrame:
    """``sets`` as a table with ``no``, a long that ascends in the order of ``rank``, then ``id``; a set's refs count once."""
    numbered = sets.withColumn("refs", F.array_distinct("refs")).orderBy("rank", "id").withColumn("no", F.monotonically_increasing_id())
    return cut(numbered, "sets")


def candidate_pairs(sets: DataFrame, overlap: float, hot_ref: int = HOT_REF) -> DataFrame:
    """``sup``, ``sub`` of sets (``no``, ``refs``; no two are equal) that share one of the rarest refs of ``sub``, which comes
    later; what covers a set is among them."""
    flat = sets.select("no", F.size("refs").alias("size"), F.explode("refs").alias("ref"))
    # one more than the refs that a set may lack; a hair less than the bound keeps rounding on the safe side
    known = flat.join(flat.groupBy("ref").agg(F.count("*").alias("f")), "ref").withColumn("need", F.floor(F.col("size") * overlap - 1e-9) + 1)
    lots = F.ceil(F.col("f") / hot_ref).cast("int")
    place = F.row_number().over(Window.partitionBy("no").orderBy("f", "ref"))
    rare = known.withColumn("place", place).where(F.col("place") <= F.col("size") - F.col("need") + 1)
    asks = rare.select(F.col("no").alias("sub"), "need", "ref", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    holds = known.select(F.col("no").alias("sup"), F.col("size").alias("held"), "ref", F.pmod("no", lots).cast("int").alias("lot"))
    return asks.join(holds, ["ref", "lot"]).where((F.col("sup") < F.col("sub")) & (F.col("held") >= F.col("need"))).select("sup", "sub").distinct()


def covering_pairs(sets: DataFrame, overlap: float) -> DataFrame:
    """``sup``, ``sub``: ``sup`` comes first and holds more than ``overlap`` of the refs of ``sub``."""
    own = lambda name: sets.select(F.col("no").alias(name), F.col("refs").alias(f"{name}_refs"))
    # the later set is the smaller one as a rule, so its refs travel
    met = candidate_pairs(sets, overlap).join(own("sub"), "sub").join(own("sup"), "sup")
    return met.where(F.size(F.array_intersect("sup_refs", "sub_refs")) / F.size("sub_refs") > overlap).select("sup", "sub")


def _fold(pairs: DataFrame) -> DataFrame:
    """``no``, ``absorber`` of the sets that go, taking all sets in order in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        sup, sub = (np.concatenate([b.column(i).to_numpy() for b in own] or [np.empty(0, np.int64)]) for i in (0, 1))
        order = np.lexsort((sup, sub))
        gone: dict[int, int] = {}
        for s, t in zip(sup[order].tolist(), sub[order].tolist(), strict=True):  # a set's earlier ones are decided, and come in order
            if t not in gone and s not in gone:
                gone[t] = s
        yield pa.RecordBatch.from_arrays([pa.array(list(gone), pa.int64()), pa.array(list(gone.values()), pa.int64())], names=["no", "absorber"])

    return pairs.coalesce(1).mapInArrow(run, "no long, absorber long")


def _rounds(pairs: DataFrame, n: int) -> DataFrame:
    """The same by rounds of joins: free sets (nothing open comes before them) stay, and what they cover goes."""
    gone, left = [], pairs
    # every round decides at least the first open set, so this ends
    while n:
        free = left.select(F.col("sup").alias("no")).distinct().join(left.select(F.col("sub").alias("no")), "no", "left_anti")
        lost = cut(left.join(free.withColumnRenamed("no", "sup"), "sup", "left_semi").select(F.col("sub").alias("no")).distinct(), "lost")
        gone.append(lost)
        rest = left.join(free.withColumnRenamed("no", "sup"), "sup", "left_anti")
        rest = rest.join(lost.withColumnRenamed("no", "sup"), "sup", "left_anti").join(lost.withColumnRenamed("no", "sub"), "sub", "left_anti")
        left, n = counted_cut(rest, "open")
    dropped = reduce(DataFrame.unionByName, gone) if gone else pairs.select(F.col("sub").alias("no")).limit(0)
    by = pairs.join(dropped.withColumnRenamed("no", "sup"), "sup", "left_anti")
    return by.groupBy(F.col("sub").alias("no")).agg(F.min("sup").alias("absorber"))


def absorbed(sets: DataFrame, overlap: float, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """``no``, ``absorber`` (the number of the first kept set that covers it) of the sets that go, of sets ``in_order``. Empty
    sets are covered by none, and with an ``overlap`` of 1 or more no set is."""
    if overlap >= 1:
        return sets.select("no", F.col("no").alias("absorber")).limit(0)
    own = sets.where(F.size("refs") > 0).select("no", F.array_sort("refs").alias("refs"))
    first = own.groupBy("refs").agg(F.min("no").alias("no"), F.count("*").alias("n"))
    first, kinds = counted_cut(first, "distinct-sets")
    pairs, n = counted_cut(covering_pairs(first.select("no", "refs"), overlap), "covers")
    gone = cut(_fold(pairs) if n <= fold_pairs else _rounds(pairs, n), "absorbed")
    again = own.join(first.where("n > 1").withColumnRenamed("no", "like").drop("n"), "refs").where("no <> like").select("no", "like")
    to = again.join(gone.withColumnRenamed("no", "like"), "like", "left").select("no", F.coalesce("absorber", "like").alias("absorber"))
    return gone.unionByName(to)


def keep_first(sets: DataFrame, overlap: float, fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """``id``, ``kept``, ``absorber`` (the first kept set that covers it) for sets with ``id``, ``rank``, ``refs``."""
    sets = in_order(sets.select("id", "rank", "refs"))
    name = sets.select(F.col("no").alias("absorber"), F.col("id").alias("by"))
    gone = settled(sets.sparkSession, lambda: absorbed(sets, overlap, fold_pairs), "gone")
    found = sets.join(gone, "no", "left").join(name, "absorber", "left")
    return found.select("id", F.col("absorber").isNull().alias("kept"), F.col("by").alias("absorber"))


def reconcile(candidates: DataFrame, precedence: tuple[str, ...], overlap: float) -> DataFrame:
    """``candidates`` with ``kept`` and ``absorber``: strongest shape first, then the larger, then by id."""
    order = F.create_map(*(x for k, p in enumerate(precedence) for x in (F.lit(p), F.lit(k))))
    ranked = candidates.select(F.col("candidate_id").alias("id"), F.struct(F.coalesce(order[F.col("pattern_type")], F.lit(len(precedence))).alias("a"), (-F.size("refs")).alias("b")).alias("rank"), "refs")
    return candidates.join(keep_first(ranked, overlap).withColumnRenamed("id", "candidate_id"), "candidate_id")
