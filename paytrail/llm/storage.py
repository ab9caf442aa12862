"""How these operators keep tables and batches: shared tables are those of ``paytrail.plans.cut``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paytrail.plans.cut import cut


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Have Spark hand texts to Python in Arrow batches of about ``size`` bytes, whatever their length. The setting is the
    session's and stays, since results are lazy and run after the operator has returned; a smaller one is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(name, str(size))


def free_name(base: str, *frames: DataFrame) -> str:
    """``base``, with underscores behind it until none of the frames has such a column, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base
