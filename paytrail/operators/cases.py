"""Which cases a generated month plants: admissible ones that share no account, in order of priority, within a budget; and the
walks along payments that chained cases are made of."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import counted_cut, cut

from .evaluate import partition_of
from .windows import running_total

#: Shapes that a reporting threshold decides.
SENSITIVE = ("structuring", "deposit_send")
#: (case, account) rows up to which one task takes the cases in order; more are chosen in rounds.
FOLD_ROWS = 500_000


def admissible(shape: Column, aligned: Column, key: Column, selection: str = "any", partition: str | None = None) -> Column:
    """Whether a profile may plant a case. ``aligned`` takes every aligned case of the sensitive shapes and none that isn't,
    ``exclude_aligned`` none that is, ``any`` doesn't ask; all else goes by the anchor's partition, if one is named."""
    if selection not in ("any", "aligned", "exclude_aligned"):
        raise ValueError(f"no such selection: {selection}")
    own = F.lit(True) if partition is None else F.coalesce(partition_of(key) == partition, F.lit(False))
    sensitive, is_aligned = F.coalesce(shape.isin(*SENSITIVE), F.lit(False)), F.coalesce(aligned, F.lit(False))
    if selection == "aligned":
        return F.when(sensitive, is_aligned).otherwise(own)
    return F.when(sensitive & is_aligned, False).otherwise(own) if selection == "exclude_aligned" else own


def rotated(priority: Sequence[str], by: int) -> list[str]:
    """The priorities of a later month."""
    k = by % len(priority) if priority else 0
    return [*priority[k:], *priority[:k]]


def _fold(open_rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cases: dict[int, list[str]] = {}
        for b in batches:
            for no, account in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cases.setdefault(no, []).append(account)
        used: set[str] = set()
        chosen = []
        for no in sorted(cases):
            if used.isdisjoint(cases[no]):
                used.update(cases[no])
                chosen.append(no)
        yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64())], names=["no"])

    return open_rows.select("no", "account").coalesce(1).mapInArrow(run, "no long")


def _rounds(left: DataFrame, n: int) -> DataFrame:
    """In each round the cases that come first on all their accounts are chosen, and what shares an account with one goes. No
    pairs are made: a round is linear in the (case, account) rows, however many cases an account has."""
    found = []
    # the first open case is chosen in every round, so this ends
    while n:
        first = left.groupBy("account").agg(F.min("no").alias("first"))
        chosen = cut(left.join(first, "account").groupBy("no").agg(F.bool_and(F.col("no") == F.col("first")).alias("all")).where("all").select("no"), "chosen")
        found.append(chosen)
        taken = left.join(chosen, "no", "left_semi").select("account").distinct()
        gone = left.join(taken, "account", "left_semi").select("no").distinct()
        left, n = counted_cut(left.join(gone, "no", "left_anti"), "open-cases")
    return reduce(DataFrame.unionByName, found)


def independent(cases: DataFrame, order: list[Column], fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``cases`` (with ``accounts``) that share no account with an earlier one of ``order`` that stays; ``order`` must tell all
    cases apart. ``no`` ascends in it. A case without accounts stays."""
    numbered = cut(cases.orderBy(*order).withColumn("no", F.monotonically_increasing_id()), "cases")
    left, n = counted_cut(numbered.select("no", F.explode(F.array_distinct("accounts")).alias("account")), "case-accounts")
    if not n:
        return numbered
    chosen = _fold(left) if n <= fold_rows else _rounds(left, n)
    none = numbered.where(F.size("accounts") < 1).select("no")
    return numbered.join(chosen.unionByName(none), "no", "left_semi")


def select_cases(cases: DataFrame, total: int, priority: Sequence[str], share: float = 0.1, rotation: int = 0, min_size: int = 3, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """The cases to plant: ``place`` (from 1), ``case_id``, ``shape``, ``size``, ``running`` (rows planted so far).

    ``cases``: ``case_id``, ``shape``, ``size`` (rows), ``accounts``, of which too small ones and shapes outside ``priority`` are
    left out. Shapes come in the rotated order of ``priority``, larger cases first, ties by id; a case goes if it shares an
    account with one before it that stays. Cases are then taken in order as long as their rows are no more than ``share`` of
    the ``total`` rows of the month, up to the first that would pass it.
    """
    ranks = {p: k for k, p in enumerate(rotated(priority, rotation))}
    rank = F.create_map(*(x for p, k in ranks.items() for x in (F.lit(p), F.lit(k))))[F.col("shape")] if ranks else F.lit(None)
    able = cases.withColumn("rank", rank).where(F.col("rank").isNotNull() & (F.col("size") >= min_size))
    kept = independent(able, [F.col("rank"), F.desc("size"), F.col("case_id")], fold_rows)
    summed = running_total(kept.select("no", "case_id", "shape", "size"), [F.col("no")], {"running": F.col("size"), "place": F.lit(1)})
    return summed.where(F.col("running") <= F.floor(F.lit(total) * share + 1e-9)).select("place", "case_id", "shape", "size", "running")


def _first_payments(edges: DataFrame, max_hops: int) -> DataFrame:
    """``node``, ``outs``: of each account that pays the first payments to different receivers, one more than ``max_hops``."""
    firsts = edges.groupBy("sender_account", "receiver_account").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("sender_account").orderBy("pos"))
    return firsts.withColumn("place", place).where(F.col("place") <= max_hops + 1).groupBy(F.col("sender_account").alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("receiver_account").alias("to")))).alias("outs"))


def _begin(outs: DataFrame) -> DataFrame:
    return outs.select(F.col("node").alias("start"), "node", F.array("node").alias("visited"), F.array().cast("array<bigint>").alias("path"), F.lit(False).alias("closed"))


def _step(met: DataFrame) -> DataFrame:
    """Walks, joined with the ``outs`` of their nodes, one payment on."""
    step = met.withColumn("next", F.when(~F.col("closed"), F.get(F.filter("outs", lambda e: (e["to"] == F.col("start")) | ~F.array_contains("visited", e["to"])), F.lit(0))))
    moved = F.col("next").isNotNull()
    return step.select(
        "start", F.when(moved, F.col("next.to")).otherwise(F.col("node")).alias("node"), F.when(moved, F.concat("visited", F.array("next.to"))).otherwise(F.col("visited")).alias("visited"),
        F.when(moved, F.concat("path", F.array("next.pos"))).otherwise(F.col("path")).alias("path"), (F.col("closed") | (moved & (F.col("next.to") == F.col("start")))).alias("closed"),
    )


def _walks(outs: DataFrame, max_hops: int) -> DataFrame:
    walk = _begin(outs)
    for _ in range(max_hops):
        walk = _step(walk.join(outs, "node", "left"))
        # a walk that ended keeps its node, whose payments all lead to visited accounts
    return walk.select("start", "path", F.size("path").alias("hops"), "closed")


def walks(edges: DataFrame, max_hops: int = 10) -> DataFrame:
    """From each account that pays: ``start``, ``path`` (positions), ``hops``, ``closed``, walking on along the first payment whose
    receiver hasn't been visited, or is the start, where the walk ends.

    A walk has visited at most ``max_hops`` accounts, so the first receivers of an account, one more than that, always
    have its next step among them, however busy it is.
    """
    return _walks(cut(_first_payments(edges, max_hops), "first-payments"), max_hops)


#: Starts, those with the earliest first payments, that are tried before all others.
EARLY_STARTS = 2_000


def _early(outs: DataFrame, max_hops: int, starts: int) -> DataFrame:
    """The walks of ``max_hops`` payments from the ``starts`` with the earliest first payments. The walks are few and go to the table, which
    is never shuffled."""
    walk = _begin(outs.orderBy(F.get("outs", F.lit(0))["pos"]).limit(starts))
    for hop in range(1, max_hops + 1):
        walk = _step(outs.join(F.broadcast(walk), "node")).where(F.size("path") == hop)
    return walk.select("start", "path", F.size("path").alias("hops"), "closed")


def longest_walks(edges: DataFrame, most: int, min_hops: int = 3, max_hops: int = 10, early: int = EARLY_STARTS) -> DataFrame:
    """``place`` (from 1), ``start``, ``path``, ``hops``, ``closed`` of up to ``most`` walks, each the longest along payments that those
    before it haven't used; ties go to the start whose first payment is earlier. Ends before a walk of too few hops.

    No walk is longer than ``max_hops``, and a walk's first payment is its start's first. So once a walk from the ``early`` starts is as long, no
    later start can have a better one; else all starts are walked from. Of the first payments only those of accounts on a found walk change.
    """
    outs = cut(_first_payments(edges, max_hops), "first-payments")
    found, used, left, none = [], None, outs, None
    best_of = lambda rows, place: counted_cut(rows.orderBy(F.desc("hops"), F.get("path", F.lit(0))).limit(1).where(F.col("hops") >= min_hops).select(F.lit(place).alias("place"), "*"), "walk")
    for place in range(1, most + 1):
        best, n = best_of(_early(left, max_hops, early), place)
        if not n:
            best, n = best_of(_walks(left, max_hops), place)
        none = best if none is None else none
        if not n:
            break
        found.append(best)
        legs = best.select(F.explode("path").alias("pos"))  # ten positions at most
        used = legs if used is None else used.unionByName(legs)
        payers = F.broadcast(cut(edges.join(F.broadcast(used), "pos", "left_semi").select(F.col("sender_account")).distinct(), "payers"))
        again = cut(_first_payments(edges.join(payers, "sender_account", "left_semi").join(F.broadcast(used), "pos", "left_anti"), max_hops), "first-payments")
        left = outs.join(payers.withColumnRenamed("sender_account", "node"), "node", "left_anti").unionByName(again)
    return reduce(DataFrame.unionByName, found) if found else none
