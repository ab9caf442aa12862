"""The rules-only baseline that the detectors are measured against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Reporting and record-keeping thresholds, the band under the first, and the counterparty limit.
REPORT, BAND, RECORD, PARTIES = 10_000, 8_000, 3_000, 8


def _sides(edges: DataFrame) -> DataFrame:
    """Each row once per account it touches; both sides, so a self-transfer counts twice."""
    side = F.explode(F.array(F.struct(F.col("sender_account").alias("account"), F.col("receiver_account").alias("other")), F.struct(F.col("receiver_account").alias("account"), F.col("sender_account").alias("other"))))
    return edges.select("txn_ref", "amount", "ts", side.alias("s")).select("txn_ref", "amount", F.to_date("ts").alias("day"), "s.*")


def baseline_alerts(edges: DataFrame) -> DataFrame:
    """``rule``, ``txn_ref``, ``account``: every alert of R1 to R5."""
    a = F.col("amount")
    rules = F.array_compact(F.array(F.when(a >= REPORT, "R1").when(a >= BAND, "R2"), F.when(a >= RECORD, "R5")))
    single = edges.select(F.explode(rules).alias("rule"), "txn_ref", F.col("sender_account").alias("account"))
    sides = _sides(edges)
    days = sides.groupBy("account", "day").agg(F.sum("amount").alias("t"), F.count("*").alias("c")).where((F.col("t") >= REPORT) & (F.col("c") > 1)).select("account", "day")
    busy = sides.groupBy("account").agg(F.countDistinct("other").alias("d")).where(F.col("d") >= PARTIES).select("account")
    daily = sides.join(days, ["account", "day"], "left_semi").select(F.lit("R3").alias("rule"), "txn_ref", "account")
    wide = sides.join(busy, "account", "left_semi").select(F.lit("R4").alias("rule"), "txn_ref", "account")
    return single.unionByName(daily).unionByName(wide)
