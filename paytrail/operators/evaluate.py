"""Measures against labels, and the words for a shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe() -> Column:
    """A sentence about a candidate from ``pattern_type``, ``n`` and ``attributes``."""
    a = lambda k: F.coalesce(F.get_json_object("attributes", f"$.{k}"), F.lit("?"))
    text = lambda f, *c: F.format_string(f, *c)
    p = F.col("pattern_type")
    return (
        F.when(p == "gather_scatter", text("An account took in money from %s payers and sent it to %s payees, %s of the sum it received.", a("distinct_senders"), a("distinct_recipients"), a("conservation")))
        .when(p == "deposit_send", text("Cash came in %s time(s) and about as much left within %s hours.", a("pairs"), a("max_gap_hours")))
        .when(p == "layered_fan", text("%s outer accounts and %s intermediaries make a funnel of two layers (%s).", a("leaf_count"), a("branch_count"), a("direction")))
        .when(p == "bipartite", text("Senders %s all pay %s, in %s layer(s).", a("senders"), a("receivers"), a("layers")))
        .when(p == "cycle", text("Money moved on over %s hops and %s of it arrived.", a("hops"), a("retained_fraction")))
        .when(p == "scatter_gather", text("Money was split over %s accounts and met again at %s.", a("fan"), a("sink")))
        .when(p == "structuring", text("%s payments stay just under %s (%s).", F.col("n").cast("string"), a("threshold"), a("side")))
        .otherwise(text("%s payments form a %s.", F.col("n").cast("string"), F.replace(p, F.lit("_"), F.lit(" "))))
    )


def recall(found: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """Per shape: planted instances, those with at least ``share`` of their rows in one candidate's reach, and those that a
    candidate of their own shape covers so."""
    size = labels.groupBy("instance", "shape").agg(F.count("*").alias("size"))
    hits = found.select("candidate_id", "pattern_type", F.explode("refs").alias("txn_ref")).join(labels, "txn_ref")
    any_hit = hits.groupBy("instance").agg(F.countDistinct("txn_ref").alias("any"))
    named = hits.where("pattern_type = shape").groupBy("instance").agg(F.countDistinct("txn_ref").alias("named"))
    each = size.join(any_hit, "instance", "left").join(named, "instance", "left")
    ok = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) >= F.col("size") * share)
    return each.groupBy("shape").agg(F.count("*").alias("instances"), ok("any").alias("found"), ok("named").alias("named"))


def summary(recalled: DataFrame) -> DataFrame:
    """One row of what ``recall`` gives: ``instances``, ``recall``, ``named_recall``, and the ``weakest`` shape with its recall, the first by name of
    several."""
    share = F.col("found") / F.col("instances")
    low = F.min(F.struct(share.alias("share"), "shape"))
    total = recalled.agg(F.sum("instances").alias("instances"), F.sum("found").alias("f"), F.sum("named").alias("n"), low.alias("low"))
    return total.select("instances", F.round(F.col("f") / F.col("instances"), 6).alias("recall"), F.round(F.col("n") / F.col("instances"), 6).alias("named_recall"), F.col("low.shape").alias("weakest"), F.round("low.share", 6).alias("weakest_recall"))


def alert_volume(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows in a candidate, all rows, and their share."""
    flagged = found.select(F.explode("refs").alias("txn_ref")).agg(F.countDistinct("txn_ref").alias("flagged"))
    return flagged.crossJoin(edges.agg(F.count("*").alias("total"))).withColumn("share", F.round(F.col("flagged") / F.col("total"), 6))  # one row each


def partition_of(key: Column) -> Column:
    """Development or evaluation part of a key, by its hash."""
    return F.when(F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "dev").otherwise("eval")


def round_robin_batches(rows: DataFrame, key: str, batch: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, one of every batch in turn: by ``depth``, the place in the batch, then by batch; ``place``
    is where that puts a row. No batch can give more than ``most``, so the limit applies before batches meet."""
    depth = F.row_number().over(Window.partitionBy(key, batch).orderBy(*order))
    drawn = rows.withColumn("depth", depth).where(F.col("depth") <= most)
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("depth", batch))).where(F.col("place") <= most)


def query_text(shape: Column, words: dict[str, str], detail: Column, cross_border: Column) -> Column:
    """What to ask the corpus about a candidate: its shape in words, a detail, and whether it crosses a border."""
    known = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.concat_ws("; ", known[shape], detail, F.when(cross_border, "cross-border"))
