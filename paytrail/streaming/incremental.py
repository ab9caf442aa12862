"""Batch files as they arrive: an extension of the monthly run, which audits each file once however often it is delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.sources import mt103


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``file``, ``text``, ``digest``, ``arrived`` of the logs that appear in ``folder``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(folder)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select(F.col("path").alias("file"), text.alias("text"), F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("arrived"))


def audit_stream(stream: DataFrame, checkpoint: str, audit: Callable[[DataFrame, int], None], late: str = "31 days"):
    """Start the query. Files with known bytes are dropped for as long as the watermark remembers them; the rest are parsed
    and handed to ``audit`` (rows, batch number), with whose idempotence a replayed batch is safe."""
    once = stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["digest"])

    def each(batch: DataFrame, number: int) -> None:
        audit(mt103.ingest(batch.select("file", "text"))[0], number)

    return once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
