"""The results store: Parquet tables that only grow, and views of their latest state."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .report import STEPS, reusable_job, save_report

SCHEMAS = {
    "reports": "report_id string, run_id string, period string, generated_at timestamp, risk_rating string, clean boolean, report_json string",
    "findings": "finding_id string, report_id string, candidate_id string, pattern_type string, risk_level string, confidence double, status string, ordinal int, saved_at timestamp, version string",
    "commits": "report_id string, version string, committed_at timestamp",
    "reviews": "review_id string, finding_id string, action string, reviewer string, at timestamp, note string",
    "jobs": "job_id string, batch_name string, batch_sha256 string, status string, submitted_at timestamp, finished_at timestamp, report_id string, error string, changed_at timestamp",
}


class InvalidTransition(ValueError):
    """A review that the finding's state doesn't allow."""


def with_retry(write: Callable[[], None], attempts: int = 3, pause: float = 0.5) -> None:
    """Run a write, again after a growing pause while it fails; the last failure is raised."""
    for k in range(attempts):
        try:
            return write()
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(pause * 2**k)


class Store:
    """Tables below ``root``. Rows are never changed: reports keep their first text, a finding's state follows from its
    reviews, a job's is its newest row, and a report's findings are those of its newest commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """A table, with the columns it has gained; missing nullable columns read as null."""
        wanted = T.StructType.fromDDL(SCHEMAS[name])
        try:
            df = self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], wanted)
        return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in df.columns))

    def append(self, name: str, rows: DataFrame) -> None:
        fixed = rows.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(SCHEMAS[name])))
        with_retry(lambda: fixed.write.mode("append").parquet(f"{self.root}/{name}"))

    def save(self, reports: DataFrame, findings: DataFrame) -> str:
        """File reports, once, and their findings, anew each time; returns the version.

        The two tables have no transaction in common, so findings are written under a version that nobody reads yet, then the
        reports, and last a row in ``commits`` for each report, in one file. Whoever reads sees the findings of the commit
        before until then, and never a part of them; a save that fails leaves rows that no commit names, and can be repeated.
        """
        version = uuid.uuid4().hex
        self.append("findings", findings.withColumns({"saved_at": F.current_timestamp(), "version": F.lit(version)}))
        self.append("reports", save_report(self.read("reports"), reports))
        filed = self.read("findings").where(F.col("version") == version).select("report_id").unionByName(reports.select("report_id")).distinct()
        self.append("commits", filed.select("report_id", F.lit(version).alias("version"), F.current_timestamp().alias("committed_at")).coalesce(1))
        return version

    def committed(self) -> DataFrame:
        """``report_id``, ``version`` of the newest commit of each report; ties by version."""
        return self.read("commits").groupBy("report_id").agg(F.max_by("version", F.struct("committed_at", "version")).alias("version"))

    def reports(self) -> DataFrame:
        """Filed reports, but for those whose first save hasn't come to its commit."""
        begun = self.read("findings").where("version is not null").select("report_id").distinct()
        return self.read("reports").join(begun.join(self.committed(), "report_id", "left_anti"), "report_id", "left_anti")

    def findings(self) -> DataFrame:
        """Findings of each report's newest commit, with the state that their reviews lead to. Rows of before there were commits
        count where their report has none."""
        newest = self.committed().withColumnRenamed("version", "now")
        rows = self.read("findings").join(newest, "report_id", "left").where(F.col("version").eqNullSafe(F.col("now"))).drop("now")
        one = Window.partitionBy("finding_id").orderBy(F.desc("saved_at"), "report_id", "candidate_id")
        own = rows.withColumn("rn", F.row_number().over(one)).where("rn = 1").drop("rn", "version")
        listed = self.read("reviews").groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "review_id", "action"))), lambda x: x["action"]).alias("acts"))
        table = F.create_map(*(F.lit(x) for (s, a), t in STEPS.items() for x in (f"{s}>{a}", t)))
        fold = F.aggregate(F.coalesce("acts", F.array().cast("array<string>")), F.col("status"), lambda s, a: F.coalesce(F.try_element_at(table, F.concat_ws(">", s, a)), s))
        return own.join(listed, "finding_id", "left").withColumn("status", fold).drop("acts")

    def report(self, report_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the report's row, its findings in order, the history of their reviews, oldest first)."""
        own = self.findings().where(F.col("report_id") == report_id)
        history = self.read("reviews").join(own.select("finding_id"), "finding_id", "left_semi")
        return self.reports().where(F.col("report_id") == report_id), own.orderBy("ordinal", "finding_id"), history.orderBy("at", "review_id")

    def review(self, finding_id: str, action: str, reviewer: str, note: str = "") -> str:
        """Append a review; returns the new state."""
        now = self.findings().where(F.col("finding_id") == finding_id).select("status").head()
        if now is None:
            raise KeyError(finding_id)
        if (now["status"], action) not in STEPS:
            raise InvalidTransition(f"cannot {action} a finding that is {now['status']}")
        row = self.spark.range(1).select(F.expr("uuid()").alias("review_id"), F.lit(finding_id).alias("finding_id"), F.lit(action).alias("action"), F.lit(reviewer).alias("reviewer"), F.current_timestamp().alias("at"), F.lit(note).alias("note"))
        self.append("reviews", row)
        return STEPS[now["status"], action]

    def listing(self, period: str | None = None, limit: int = 50) -> DataFrame:
        """Newest reports first, with the number of findings and of those in doubt."""
        counts = self.findings().groupBy("report_id").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))
        rows = self.reports().drop("report_json")
        rows = rows.where(F.col("period") == period) if period else rows
        return rows.join(counts, "report_id", "left").fillna(0, ["findings", "needs_review"]).orderBy(F.desc("generated_at"), "report_id").limit(limit)

    def submit(self, job_id: str, batch_name: str, digest: str) -> str:
        """The id of a running or complete job for the same bytes, else of a new one."""
        same = reusable_job(self.jobs().where(F.col("batch_sha256") == digest)).select("job_id").head()
        if same:
            return same["job_id"]
        now = F.current_timestamp()
        self.append("jobs", self.spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(batch_name).alias("batch_name"), F.lit(digest).alias("batch_sha256"), F.lit("running").alias("status"), now.alias("submitted_at"), F.lit(None).alias("finished_at"), F.lit(None).alias("report_id"), F.lit(None).alias("error"), now.alias("changed_at")))
        return job_id

    def finish(self, job_id: str, report_id: str | None = None, error: str | None = None) -> None:
        own = self.jobs().where(F.col("job_id") == job_id)
        done = {"status": F.lit("failed" if error else "complete"), "finished_at": F.current_timestamp(), "report_id": F.lit(report_id), "error": F.lit(error), "changed_at": F.current_timestamp()}
        self.append("jobs", own.withColumns(done))

    def jobs(self) -> DataFrame:
        newest = Window.partitionBy("job_id").orderBy(F.desc("changed_at"), F.desc("finished_at"), F.desc("status"))
        return self.read("jobs").withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


class BackendMismatch(ValueError):
    """Vectors of one encoder were asked of a table that another one filled."""


class ChunkTable:
    """Chunks with vectors, by id. Rows are appended with the time of their upsert; the newest of an id counts."""

    def __init__(self, spark: SparkSession, path: str, backend: str, dimension: int):
        self.spark, self.path, self.backend, self.dimension = spark, path, backend, dimension

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def upsert(self, chunks: DataFrame) -> None:
        """``chunks``: ``chunk_id``, ``embedding`` and any metadata."""
        self._guard()
        wrong = chunks.where(F.size("embedding") != self.dimension).limit(1).count()
        if wrong:
            raise BackendMismatch(f"vectors must have {self.dimension} components")
        out = chunks.withColumns({"backend": F.lit(self.backend), "upserted_at": F.current_timestamp()})
        with_retry(lambda: out.write.mode("append").parquet(self.path))

    def _guard(self) -> None:
        rows = self._rows()
        other = rows.where(F.col("backend") != self.backend).select("backend").head() if rows is not None else None
        if other:
            raise BackendMismatch(f"filled by {other['backend']}, not {self.backend}")

    def read(self) -> DataFrame:
        self._guard()
        rows = self._rows()
        if rows is None:
            raise FileNotFoundError(self.path)
        newest = Window.partitionBy("chunk_id").orderBy(F.desc("upserted_at"))
        return rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn", "backend", "upserted_at")

    def get(self, ids: list[str]) -> DataFrame:
        return self.read().where(F.col("chunk_id").isin(*ids))

    def counts(self, *by: str) -> DataFrame:
        """Chunks by every one of the columns and in all, as grouping sets."""
        return self.read().groupingSets([*([c] for c in by), []], *by).agg(F.count("*").alias("n"))
