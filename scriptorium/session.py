"""Session construction and lineage cutting.

Cluster deployments pass their own configuration; ``get_session`` only fills
in settings that are unset, so a cluster's ``spark.checkpoint.dir`` and
shuffle sizing always win.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "scriptorium") -> SparkSession:
    """Return the active session, or build one. Settings that the launcher
    (spark-submit, spark-defaults) already made are left as they are."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    wanted = dict(_DEFAULTS)
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master:
        wanted["spark.master"] = master
    SparkContext._ensure_initialized()  # the JVM knows --conf and spark-defaults
    launched = SparkConf(loadDefaults=True)
    builder = SparkSession.builder.appName(app_name)
    for key, value in wanted.items():
        if not launched.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir`` (or set
    on the context). A folder every executor can reach cannot be guessed, so
    an unset one is an error; tests set their own in ``conftest.py``."""
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shuffle_slots(df: DataFrame) -> int:
    """The session's shuffle partition count: how far a hot group is spread."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


TASK_ROWS = 500_000       # narrow rows of one task where a join or grouping multiplies them


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` by ``keys`` in enough partitions that ``rows`` rows come to about ``task_rows`` a task. Where
    the session's shuffle partitions are enough, Spark's own exchange is left to do it."""
    n = -(-rows // task_rows)
    return df.repartition(n, *keys) if n > shuffle_slots(df) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives
    executor loss) and return a DataFrame reading from it. Set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have Spark remove
    the files when the DataFrame goes out of scope."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_folders: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def landing(spark: SparkSession) -> Iterator[str]:
    """While it lasts, ``landed`` writes to a folder of this run, which is deleted at
    the end: results that go on must be cut from it (``cut_lineage``) before."""
    folder = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.remove(folder)
        _delete(spark, folder)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution begun while it lasts are deleted at its end, not when the driver's memory
    happens to be collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def landed(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again. For
    loops of joins: a checkpointed DataFrame keeps the planner's size estimate, the product of the joined
    sides, which grows from round to round; a table has the size of its files. ``options`` go to the writer."""
    spark = df.sparkSession
    folder = _folders[-1] if _folders else f"{checkpoint_dir(spark)}/landed"
    path = f"{folder}/{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
