"""Findings, gates, reports, reviews, jobs and costs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a review may do in each state and where it leads; prices per million tokens (in, out).
STEPS = {("pending_review", "clear"): "cleared", ("pending_review", "escalate"): "escalated", ("needs_review", "clear"): "cleared", ("needs_review", "escalate"): "escalated", ("escalated", "approve"): "approved", ("escalated", "clear"): "cleared"}
PRICES = {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6)}
TXN_REF, CHUNK_ID = r"\b([A-Z]{2,5}\d{8,})\b", r"\b([a-z0-9][a-z0-9._-]*:[0-9a-f]{16})\b"


def invented(narrative: Column, pattern: str, known: Column) -> Column:
    """What a narrative cites that it was never shown, sorted."""
    return F.array_sort(F.array_distinct(F.array_except(F.regexp_extract_all(narrative, F.lit(pattern), F.lit(1)), known)))


def gate(drafts: DataFrame) -> DataFrame:
    """``drafts`` (``narrative``, ``cited``, ``shown``, ``refs``) with ``bad_ids``, ``bad_refs`` and ``faithful``."""
    cited = F.array_distinct(F.concat("cited", F.regexp_extract_all("narrative", F.lit(CHUNK_ID), F.lit(1))))
    out = drafts.withColumns({"bad_ids": F.array_sort(F.array_except(cited, F.col("shown"))), "bad_refs": invented(F.col("narrative"), TXN_REF, F.col("refs"))})
    return out.withColumn("faithful", (F.size("bad_ids") == 0) & (F.size("bad_refs") == 0))


def rating(findings: DataFrame, reports: DataFrame, bar: float = 0.9) -> DataFrame:
    """``report_id``, ``rating``: high needs a high finding of ``bar`` confidence that isn't in doubt."""
    sure = (F.col("risk_level") == "high") & (F.col("confidence") >= bar) & (F.col("status") != "needs_review")
    agg = findings.groupBy("report_id").agg(F.bool_or(sure).alias("sure"), F.bool_or(F.col("risk_level").isin("high", "medium")).alias("some"))
    return reports.select("report_id").join(agg, "report_id", "left").select("report_id", F.when(F.col("sure").isNull(), "none").when(F.col("sure"), "high").when(F.col("some"), "medium").otherwise("low").alias("rating"))


def review_fold(actions: DataFrame, start: str = "pending_review") -> DataFrame:
    """``finding_id``, ``status``, ``accepted``, ``refused``: the ordered actions (``seq``, ``action``) of each finding; a step
    that its state doesn't allow is refused and changes nothing."""
    table = F.create_map(*(F.lit(x) for (s, a), t in STEPS.items() for x in (f"{s}>{a}", t)))
    listed = actions.groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "action"))), lambda x: x["action"]).alias("acts"))
    zero = F.struct(F.lit(start).alias("status"), F.lit(0).alias("ok"), F.lit(0).alias("no"))

    def step(acc, act):
        to = F.try_element_at(table, F.concat_ws(">", acc["status"], act))
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["ok"] + F.when(to.isNull(), 0).otherwise(1)).alias("ok"), (acc["no"] + F.when(to.isNull(), 1).otherwise(0)).alias("no"))

    return listed.select("finding_id", F.aggregate("acts", zero, step).alias("f")).select("finding_id", "f.status", F.col("f.ok").alias("accepted"), F.col("f.no").alias("refused"))


def reusable_job(jobs: DataFrame) -> DataFrame:
    """The newest running or complete job of each batch digest."""
    order = Window.partitionBy("batch_sha256").orderBy(F.desc("submitted_at"), F.desc("job_id"))
    return jobs.where(F.col("status").isin("running", "complete")).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (``model``, ``tokens_in``, ``tokens_out``) with ``cost``, by the longest price name that the model is or starts
    with; null for an unknown model. The price list is a few rows, far below any broadcast bound."""
    fits = (F.col("model") == F.col("name")) | F.startswith(F.col("model"), F.concat(F.col("name"), F.lit("-")))
    models = usage.select("model").distinct().join(F.broadcast(prices), fits, "left").groupBy("model").agg(F.max_by(F.struct("per_in", "per_out"), F.length("name")).alias("p"))
    cost = (F.col("p.per_in") * F.col("tokens_in") + F.col("p.per_out") * F.col("tokens_out")) / 1_000_000
    return usage.join(models, "model").withColumn("cost", cost).drop("p")


def save_report(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: a report that is filed keeps its first text."""
    return new.join(existing.select("report_id"), "report_id", "left_anti")
