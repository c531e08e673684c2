"""Stage tables: intermediate results written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at a time: long texts make large batches, held by the worker and by the JVM.
BATCH_ROWS = 2000

_own_dir: list[str] = []
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="sylva-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stages/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _held(spark: SparkSession, settings: dict[str, str]):
    """While it holds, the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def short_shuffles(spark: SparkSession):
    """While it holds, the files of an action's shuffles go when the action ends, and not when the driver collects garbage."""
    return _held(spark, {CLEANUP: "true"})


def stage_table(df: DataFrame, label: str, files: int | None = None, batch: int = BATCH_ROWS) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing.

    files: for small results, merge the partitions of the last step to at most so many files. batch: rows that go to a
    Python worker at a time.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, label)
    with _held(spark, {CLEANUP: "true", BATCH: str(batch)}):
        (df if files is None else df.coalesce(files)).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def free(*tables: DataFrame | None) -> None:
    """Delete stage tables that nothing will read any more. What is not a stage table is left alone."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)):
            jvm = table.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows (counted), else as it is: then the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
