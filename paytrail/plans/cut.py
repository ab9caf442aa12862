"""Cutting lineage: tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so a lost executor costs no
recomputation. The folder is the cluster's setting; only a local master may fall back to a temporary folder.

Results are lazy and read these tables, so who stores a result decides when they go: what is written inside ``owned()``
belongs to its caller, who hands the list to ``release`` once the result is stored. All else goes when the process ends.
``settled`` writes a result whose own helper tables go at once.

A written table needs its shuffles no more, so while tables are written Spark is told to remove the shuffle files of what
has ended; else they'd stay until the driver's collector happens to find them, and a long run fills the disks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_left: list[str] = []
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)
#: Has Spark remove an execution's shuffle files at its end.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: list[tuple[str | None, int]] = [(None, 0)]
_gate = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; for ``local[*]`` without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="paytrail-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


@contextmanager
def owned() -> Iterator[list[str]]:
    """The paths that this thread writes inside the block belong to the list it gets."""
    paths: list[str] = []
    mark = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(mark)


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    own = _owner.get()
    if own is None:
        if not _left:
            atexit.register(_release_left)
        own = _left
    own.append(path)
    return path


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """``SWEEP`` holds while any thread is inside; the last one out puts back what was set. A frame of the caller that runs twice would miss its
    shuffle files, so it doesn't stay on."""
    with _gate:
        was, n = _writing[0]
        if not n:
            was = spark.conf.get(SWEEP, None)
            spark.conf.set(SWEEP, "true")
        _writing[0] = was, n + 1
    try:
        yield
    finally:
        with _gate:
            was, n = _writing[0]
            _writing[0] = was, n - 1
            if n == 1:
                spark.conf.unset(SWEEP) if was is None else spark.conf.set(SWEEP, was)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its plan is a scan from there on."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with _swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, as a table; the tables that ``make`` wrote for it go once it is written, or has failed."""
    own: list[str] = []
    try:
        with owned() as own:
            df = make()
        return cut(df, label)
    finally:
        release(spark, own)


def counted_cut(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The same with the number of rows, counted while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return table, seen.get["n"]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove the paths through Hadoop's file system layer, once all results that read them have been stored."""
    while paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _release_left() -> None:
    """At the end of the process; without a session only what the driver's own file system reaches can go."""
    spark = SparkSession.getActiveSession()
    with suppress(Exception):  # the JVM may be gone
        if spark is not None:
            release(spark, _left)
    for path in _left:
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
