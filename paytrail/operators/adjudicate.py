"""From candidates to findings: retrieve, draft, gate, judge, loop, assemble.

A drafter and a judge are functions of DataFrames, so a hosted model plugs in as a ``mapInPandas``; the defaults are
deterministic. Only what is unresolved goes round again, and never more than ``max_loops`` times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.plans.cut import cut
from paytrail.plans.params import PRECEDENCE

from .evaluate import describe
from .report import gate

# Our own policy table: severity of each shape, from 1 (low) to 3 (high).
SEVERITY = {"structuring": 3, "cycle": 3, "deposit_send": 3, "bipartite": 2, "layered_fan": 2, "gather_scatter": 2, "scatter_gather": 2, "fan_in": 1, "fan_out": 1}


def bundles(candidates: DataFrame, obligations: DataFrame, indicators: DataFrame, n: int = 5) -> DataFrame:
    """Candidates with ``shown`` (chunk ids: all obligations of the shape, the best ``n`` indicators) and ``needs_law`` (no
    obligation resolved). ``obligations``: pattern_type, chunk_id (null: a miss); ``indicators``: pattern_type, chunk_id, rank."""
    law = obligations.groupBy("pattern_type").agg(F.array_sort(F.collect_set("chunk_id")).alias("law"))
    hints = indicators.where(F.col("rank") <= n).groupBy("pattern_type").agg(F.array_sort(F.collect_set("chunk_id")).alias("hints"))
    empty = F.array().cast("array<string>")
    # a row for each shape: dealt by shape, candidates would meet in nine tasks
    both = candidates.join(F.broadcast(law), "pattern_type", "left").join(F.broadcast(hints), "pattern_type", "left")
    return both.withColumns({"shown": F.array_distinct(F.concat(F.coalesce("law", empty), F.coalesce("hints", empty))), "needs_law": F.size(F.coalesce("law", empty)) == 0}).drop("law", "hints")


def plain_draft(rows: DataFrame, loop: int) -> DataFrame:
    """The default drafter: the shape in words, all that was shown as citations, severity by shape."""
    severity = F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (k, v)))[F.col("pattern_type")]
    risk = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), severity)
    return rows.withColumns({"narrative": F.concat(describe(), F.lit(" Rows: "), F.array_join(F.slice("refs", 1, 5), ", ")), "cited": F.col("shown"), "risk_level": risk})


def plain_judge(rows: DataFrame, loop: int) -> DataFrame:
    """The default judge: the detector's confidence, a little more for every round of evidence."""
    return rows.withColumn("judged", F.least(F.lit(1.0), F.col("confidence") + F.lit(0.15 * loop)))


def adjudicate(rows: DataFrame, draft: Callable = plain_draft, judge: Callable = plain_judge, accept: float = 0.75, max_loops: int = 2) -> DataFrame:
    """One finding per candidate: ``risk_level``, ``judged``, ``status`` and, where in doubt, ``notes``. A draft that cites
    what it wasn't shown fails before it is judged."""
    open_rows, done = rows, []
    for loop in range(max_loops + 1):
        checked = judge(gate(draft(open_rows, loop)), loop).withColumn("loops", F.lit(loop))
        good = F.col("faithful") & (F.col("judged") >= accept) & ~F.col("needs_law")
        checked = cut(checked.withColumn("good", good), "findings")
        last = loop == max_loops
        done.append(checked if last else checked.where("good"))
        if last or not checked.where("not good").limit(1).count():
            break
        open_rows = checked.where("not good").select(rows.columns)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    why = F.when(F.col("needs_law"), "no obligation resolved").when(~F.col("faithful"), "cites what it was not shown").otherwise("below the bar after every loop")
    return out.withColumns({"status": F.when(F.col("good"), "pending_review").otherwise("needs_review"), "notes": F.when(~F.col("good"), why)}).drop("good")


def assemble(findings: DataFrame, edges: DataFrame, bar: float = 0.9) -> DataFrame:
    """The report: one row, also for a clean batch (rating ``none``)."""
    sure = (F.col("risk_level") == "high") & (F.col("judged") >= bar) & (F.col("status") != "needs_review")
    some = F.count_if(F.col("risk_level").isin("high", "medium"))
    rating = F.when(F.count("*") == 0, "none").when(F.count_if(sure) > 0, "high").when(some > 0, "medium").otherwise("low")
    by = [F.count_if(F.col("pattern_type") == p).alias(p) for p in PRECEDENCE]
    body = findings.agg(rating.alias("risk_rating"), F.count("*").alias("findings"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), *by, F.array_sort(F.array_distinct(F.flatten(F.collect_set("cited")))).alias("sources"))
    period = edges.agg(F.date_format(F.min("ts"), "yyyy-MM").alias("period"), F.count("*").alias("rows"))
    words = F.format_string("%d finding(s) in %s over %d row(s); %d in doubt.", "findings", "period", "rows", "needs_review")
    return body.crossJoin(period).withColumn("summary", words).withColumn("clean", F.col("findings") == 0)  # one row each


def broken_invariants(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """What must be empty: findings in doubt without a note, and refs that the ledger doesn't hold."""
    mute = findings.where("status = 'needs_review' and notes is null").select(F.lit("note").alias("kind"), F.col("candidate_id").alias("what"))
    lost = findings.select(F.explode("refs").alias("txn_ref")).distinct().join(edges.select("txn_ref"), "txn_ref", "left_anti").select(F.lit("ref").alias("kind"), F.col("txn_ref").alias("what"))
    return mute.unionByName(lost)


def stages(edges: DataFrame, detect: Callable, reconcile: Callable, shown: Callable) -> Iterator[tuple[str, DataFrame]]:
    """The run, stage by stage, for a caller that shows progress; a clean batch ends after detection."""
    raw = cut(detect(edges), "raw")
    yield "detected", raw
    kept = cut(reconcile(raw).where("kept"), "kept")
    yield "reconciled", kept
    findings = adjudicate(shown(kept)) if kept.limit(1).count() else None
    if findings is not None:
        yield "findings", findings
        yield "report", assemble(findings, edges)
    else:
        none = kept.select("candidate_id", "pattern_type", F.lit("low").alias("risk_level"), F.lit(0.0).alias("judged"), F.lit("pending_review").alias("status"), F.array().cast("array<string>").alias("cited"))
        yield "report", assemble(none, edges)
