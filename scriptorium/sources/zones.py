"""Zone sources and sinks.

The original exchanges whole JSON arrays between stages and keeps a dated
copy plus a ``latest`` copy of each. Here a zone is a parquet dataset
partitioned by ``dt``: the dated snapshot is a partition and "latest" is the
greatest partition, not a second copy. The storage scheme comes from the path
(``s3a://``, ``abfss://``, ``hdfs://`` or local), so one code path serves
every store.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_papers(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read JSON array files of paper records with an explicit schema.

    Each file is one JSON array, read whole (one task per file, as with
    ``multiLine``) and exploded with its position. Arrival order is (file, pos):
    both columns are kept, so no window runs over files or records. Land once and
    continue from parquet (``write_zone``)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(F.from_json("value", ArrayType(schema))).alias("pos", "r")).select(
        "file", F.col("pos").cast("long").alias("pos"), "r.*")


def zone_path(root: str, zone: str) -> str:
    return os.path.join(root, zone)


def write_zone(df: DataFrame, root: str, zone: str, date: str) -> str:
    """S3: write ``df`` as the ``dt=date`` snapshot of a zone; other dates are
    kept (dynamic partition overwrite). Returns the zone path."""
    path = zone_path(root, zone)
    (df.withColumn("dt", F.lit(date)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path))
    return path


def snapshots(spark: SparkSession, root: str, zone: str) -> list[str]:
    """The dates of a zone's snapshots, ascending, from the folder listing alone."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(zone_path(root, zone))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(n[3:] for n in names if n.startswith("dt="))


def read_zone(spark: SparkSession, root: str, zone: str, date: str | None = None) -> DataFrame:
    """The snapshot of ``date``, or the latest one; a date that was never
    written falls back to the latest. The dates come from the folder listing, so
    only one partition's files are ever opened."""
    dates = snapshots(spark, root, zone)
    if not dates:
        raise FileNotFoundError(f"no snapshot of zone {zone} under {root}")
    chosen = date if date in dates else dates[-1]
    return spark.read.parquet(f"{zone_path(root, zone)}/dt={chosen}")


def write_mart(df: DataFrame, path: str) -> str:
    """Full refresh of a mart table: the rows are staged beside the table and
    swapped in by renames once the write has succeeded, so a failed write leaves the
    old table as it was. For JDBC sinks use ``df.write.jdbc(..., mode="overwrite")``
    with ``truncate=true``."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda suffix: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + suffix)
    table, staged, old = at(""), at("__staged"), at("__old")
    fs = table.getFileSystem(conf)
    df.write.mode("overwrite").parquet(staged.toString())
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(table):
        fs.rename(table, old)
    if not fs.rename(staged, table):
        if fs.exists(old):
            fs.rename(old, table)
        raise OSError(f"could not swap {staged.toString()} in")
    if fs.exists(old):
        fs.delete(old, True)
    return path


def stamp(df: DataFrame) -> DataFrame:
    """Add the load timestamp ``last_updated``."""
    return df.withColumn("last_updated", F.current_timestamp())
