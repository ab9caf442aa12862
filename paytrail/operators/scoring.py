"""From member rows to candidates: measures, confidence, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.plans.params import DAY_US, Params


def confidence(params: Params, minimum: int, threshold: Column | None = None) -> Column:
    """Score in [0, 1] over ``n``, ``mean``, ``sd``, ``total``, ``first_us`` and ``last_us``."""
    w = params.weights
    spread = F.when((F.col("n") < 2) | (F.col("mean") == 0), 0.0).otherwise(F.coalesce(F.col("sd") / F.col("mean"), F.lit(0.0)))
    tight = F.greatest(F.lit(0.0), 1 - F.least(spread, F.lit(1.0)))
    members = F.when(F.col("n") <= minimum, 0.0).otherwise(F.least(F.lit(1.0), (F.col("n") - minimum) / F.lit(float(max(minimum, 1)))))
    span = (F.col("last_us") - F.col("first_us")) / F.lit(float(DAY_US))
    compact = F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(span / F.lit(float(params.window_days)), F.lit(1.0))))
    ratio = F.lit(0.5) if threshold is None else F.least(F.lit(1.0), F.col("total").cast("double") / threshold.cast("double") / 2)
    value = w.tightness * tight + w.member_count * members + w.compactness * compact + w.aggregate * ratio
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4)


def candidate_id(pattern: str, anchor: Column, refs: Column) -> Column:
    """Shape, anchor and ten hex digits over the sorted refs: equal for every run over the same rows."""
    return F.concat_ws(":", F.lit(pattern), anchor, F.substring(F.sha2(F.array_join(F.array_sort(refs), "|"), 256), 1, 10))


def summarise(members: DataFrame, keys: list[str], pattern: str, minimum: int, params: Params, *extra: Column, threshold: str | None = None) -> DataFrame:
    """One candidate per ``keys`` (which include ``anchor``) over member rows with ``txn_ref``, ``amount``, ``us``."""
    amount = F.col("amount").cast("double")
    found = members.groupBy(*keys).agg(
        F.array_sort(F.collect_set("txn_ref")).alias("refs"), F.count("*").alias("n"), F.sum("amount").alias("total"), F.avg(amount).alias("mean"),
        F.stddev_samp(amount).alias("sd"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), *extra,
    )
    score = confidence(params, minimum, F.col(threshold) if threshold else None)
    return found.withColumns({"confidence": score, "pattern_type": F.lit(pattern), "candidate_id": candidate_id(pattern, F.col("anchor"), F.col("refs"))}).drop("mean", "sd")


def as_candidates(found: DataFrame) -> DataFrame:
    """The common shape of all detectors; what only one has goes to ``attributes``, as JSON."""
    common = ["candidate_id", "pattern_type", "anchor", "refs", "n", "total", "first_us", "last_us", "confidence"]
    rest = [c for c in found.columns if c not in common]
    return found.select(*common, (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("attributes"))
