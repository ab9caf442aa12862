"""What written tables leave on disk."""

import os
import time

import pytest
from pyspark.sql import functions as F

from paytrail.operators import detectors, greedy
from paytrail.plans import cut

from .test_detectors import edges


def shuffle_files(spark) -> int:
    every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum("/shuffle_" in f for f in every.split("\n"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(cut.SWEEP, None)
    with cut.owned() as own:
        table = cut.cut(spark.range(0, 10_000, 1, 8).groupBy((F.col("id") % 100).alias("k")).count(), "swept")
        end = time.time() + 20
        while shuffle_files(spark) > before and time.time() < end:  # the files go a moment after the job
            time.sleep(0.2)
        assert shuffle_files(spark) <= before and table.count() == 100 and spark.conf.get(cut.SWEEP, None) == was
    cut.release(spark, own)


def test_the_setting_comes_back_when_the_last_writer_is_done(spark):
    spark.conf.set(cut.SWEEP, "false")
    try:
        with cut._swept(spark):
            with cut._swept(spark):
                pass
            assert spark.conf.get(cut.SWEEP) == "true"
        assert spark.conf.get(cut.SWEEP) == "false"
    finally:
        spark.conf.unset(cut.SWEEP)


def test_helper_tables_go_with_the_result(spark):
    with cut.owned() as own:
        helpers = []

        def make(fail=False):
            helpers.append(cut.cut(spark.range(5), "helper").inputFiles()[0])
            if fail:
                raise ValueError
            return spark.read.parquet(os.path.dirname(helpers[-1]))

        out = cut.settled(spark, make, "result")
        with pytest.raises(ValueError):
            cut.settled(spark, lambda: make(True), "result")
        assert out.count() == 5 and len(own) == 1 and not any(os.path.exists(h.removeprefix("file:").replace("//", "/")) for h in helpers)
        e = edges(spark, [("a", "b", 100, 0), ("b", "c", 90, 1), ("c", "a", 80, 2), *((f"s{i}", "hub", 100, i) for i in range(4))])
        raw = detectors.detect_raw(e)
        assert len(own) == 10 and raw.count() > 0  # one for each shape
        assert greedy.keep_first(raw.select(F.col("candidate_id").alias("id"), F.lit(0).alias("rank"), "refs"), 0.6).count() == raw.count() and len(own) == 12
    cut.release(spark, own)
