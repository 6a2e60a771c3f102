"""S1 for large files: one JSON array of objects, read in byte ranges by many tasks.

A JSON array on one line can't be split at line ends, so one task would parse the whole file. Here
closing braces are the separators of the text reader, which splits files by bytes whatever the
separator is; a piece is what stands between two of them. Whether a piece begins inside a string follows
from the number of quotes before it, and how deep it stands from the braces
outside strings. Both are sums, so each is settled in two steps: totals per byte range, then
running sums inside each range. What a piece would open is counted for both
possible starts before the start is known. A piece that brings the depth back to 0 ends a record.

Pieces are written once as a table in the checkpoint folder (the text is read once) and the records put
together from there; the array need not fit in a task, one record must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.session import landed


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier pieces of the file. One row a byte range is
    summed over the file, the pieces of a range among themselves."""
    rows = rows.withColumn("_v", value)
    ranges = rows.groupBy("file", "block").agg(F.sum("_v").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return rows.join(ranges, ["file", "block"]).withColumn(name, F.col("_ahead") + F.col("_own")).drop("_v", "_own", "_ahead")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece, value, quotes, opens_out, opens_in): the file cut at closing braces, with the
    braces a piece opens if it begins outside, or inside, a string."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")            # no escaped quotes are left
    parts = F.split(plain, '"', -1)
    text = lambda odd: F.array_join(F.filter("parts", lambda _, i: i % 2 == odd), "")
    return raw.withColumn("parts", parts).select(
        "file", "block", "piece", "value", (F.size("parts") - 1).alias("quotes"),
        _count(text(0), "{").alias("opens_out"), _count(text(1), "{").alias("opens_in"))


def read_papers_split(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, pos, fields of ``schema``), as ``zones.read_papers`` gives for arrays of objects, but with as many
    tasks as the files have byte ranges (``spark.sql.files.maxPartitionBytes``). A record that is
    no valid JSON has null fields; the others are unharmed."""
    rows = _before(landed(pieces(spark, path)), F.col("quotes"), "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    ends_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    rows = rows.withColumns({"opens": F.when(inside, F.col("opens_in")).otherwise(F.col("opens_out")),
                             "closes": F.when(ends_inside, 0).otherwise(1)})
    rows = _before(landed(rows.drop("quotes", "opens_out", "opens_in", "quotes_before")), F.col("opens") - F.col("closes"), "depth")
    after = F.col("depth") + F.col("opens") - F.col("closes")
    # the pieces after the last record of a file close nothing: there the depth is 0 and no brace opens
    rows = rows.withColumn("ends", ((F.col("depth") + F.col("opens") > 0) & (after == 0)).cast("int")).drop("closes")
    rows = _before(landed(rows), F.col("ends"), "pos").filter(F.col("depth") + F.col("opens") > 0)
    records = rows.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "piece", "value"))).alias("p"))
    body = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    body = F.regexp_replace(body, r"^[\s,\[﻿]+", "")          # what stands between two records
    return records.select("file", F.col("pos").cast("long").alias("pos"), F.from_json(body, schema).alias("r")).select("file", "pos", "r.*")
