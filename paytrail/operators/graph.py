"""Questions to the ledger as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import cut
from paytrail.plans.params import Params


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct ``node``, ``other`` pairs; ``in``: who pays the node, ``out``: whom it pays. An account isn't its own."""
    near, far = ("receiver_account", "sender_account") if direction == "in" else ("sender_account", "receiver_account")
    return edges.where("sender_account <> receiver_account").select(F.col(near).alias("node"), F.col(far).alias("other")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node``, ``payers``, ``payees`` of every account."""
    i = neighbours(edges, "in").groupBy("node").agg(F.count("*").alias("payers"))
    o = neighbours(edges, "out").groupBy("node").agg(F.count("*").alias("payees"))
    return i.join(o, "node", "full").select("node", F.coalesce("payers", F.lit(0)).alias("payers"), F.coalesce("payees", F.lit(0)).alias("payees"))


def hub_nodes(edges: DataFrame, min_in: int, min_out: int) -> DataFrame:
    return degrees(edges).where((F.col("payers") >= min_in) & (F.col("payees") >= min_out))


def multi_hop_layers(edges: DataFrame, roots: DataFrame, direction: str, depth: int = 3, params: Params = Params()) -> DataFrame:
    """``root``, ``level`` (from 1), ``account``, ``truncated``: breadth first from each root (``root``), each account at its
    nearest level. A level of more than ``max_frontier`` accounts isn't entered; the root is marked (level 0)."""
    next_to = neighbours(edges, direction)
    seen = roots.select("root", F.col("root").alias("account"))
    front, out = seen, roots.select("root", F.lit(0).alias("level"), F.col("root").alias("account"), F.lit(False).alias("truncated")).limit(0)
    for level in range(1, min(depth, params.max_depth) + 1):
        step = front.join(next_to, front["account"] == next_to["node"]).select("root", F.col("other").alias("account")).distinct().join(seen, ["root", "account"], "left_anti")
        step = cut(step, "levels")
        wide = step.groupBy("root").agg(F.count("*").alias("c")).where(F.lit(False) if params.max_frontier is None else F.col("c") > params.max_frontier).select("root")
        front = step.join(wide, "root", "left_anti")
        out = out.unionByName(front.select("root", F.lit(level).alias("level"), "account", F.lit(False).alias("truncated")))
        out = out.unionByName(wide.select("root", F.lit(0).alias("level"), F.col("root").alias("account"), F.lit(True).alias("truncated")))
        seen = seen.unionByName(front)
    return out


def edge_refs(edges: DataFrame) -> DataFrame:
    """``sender_account``, ``receiver_account``, ``refs`` in order of time."""
    return edges.groupBy("sender_account", "receiver_account").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "txn_ref"))), lambda x: x["txn_ref"]).alias("refs"))


def subgraph(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidate_id``, ``nodes`` and ``edges`` (in order of time) that its refs span; unknown refs are left out."""
    legs = candidates.select("candidate_id", F.explode("refs").alias("txn_ref")).join(edges, "txn_ref")
    entry = F.struct("us", "txn_ref", F.col("sender_account").alias("source"), F.col("receiver_account").alias("target"), F.col("amount").cast("double").alias("amount"), "payment_kind")
    found = legs.groupBy("candidate_id").agg(F.array_sort(F.collect_list(entry)).alias("edges"))
    nodes = F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"]))))
    return found.select("candidate_id", nodes.alias("nodes"), "edges")


def edge_lines(graph: DataFrame, most: int = 30) -> DataFrame:
    """``candidate_id``, ``lines``: one line per transfer, the first ``most`` and how many more there are."""
    line = F.transform(F.slice("edges", 1, most), lambda e: F.format_string("%s: %s -> %s %.2f (%s)", e["txn_ref"], e["source"], e["target"], e["amount"], e["payment_kind"]))
    more = F.when(F.size("edges") > most, F.array(F.concat(F.lit("and "), (F.size("edges") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return graph.select("candidate_id", F.array_join(F.concat(line, more), "\n").alias("lines"))


def to_dot(graph: DataFrame) -> DataFrame:
    """``candidate_id``, ``dot``: the subgraph in Graphviz's language."""
    body = F.transform("edges", lambda e: F.format_string('  "%s" -> "%s" [label="%.2f"];', e["source"], e["target"], e["amount"]))
    return graph.select("candidate_id", F.concat(F.lit("digraph candidate {\n"), F.array_join(body, "\n"), F.lit("\n}")).alias("dot"))
