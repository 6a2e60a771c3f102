"""Sharding by histogram sort, in DataFrame operations only.

Rows have a 128-bit key: the hash of the text, then the hash of the id. Shard
boundaries are found by counting exact bytes below candidate keys: a round probes
2^BITS evenly spaced keys inside the interval of every boundary that is still too
far from its target, and narrows the interval to the cell that holds the target.
A boundary is settled when a probe is within the tolerance, or when its cell can't
be split. Only the rows inside open intervals are counted in a round, and a round
sends at most 2^BITS sums a boundary to the driver, whatever the input's size. Then
rows are exchanged once, by shard and bucket, and numbered.

Equal texts are neighbours in key order, so a group of them stays in one shard
unless it is larger than the tolerance lets a shard differ.

Defined results: a null text has size 1 and the key and checksum of an empty one;
a null id sorts as an id of its own; rows repeated with one id and text share a
key, hence a shard; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import slots, table
from scriptorium.session import cut_lineage

SHARDS = 16
TOLERANCE = 0.001         # of a shard's mean bytes, on either side of a boundary's target
BITS = 12                 # key bits settled by a round
LOW, SPAN = -(1 << 63), 1 << 64


@dataclass
class Boundary:
    """A boundary's target in bytes and the cell that holds it: keys whose first
    ``depth`` bits are those of ``at`` (a pair of signed 64-bit numbers)."""

    target: int
    at: tuple[int, int] = (LOW, LOW)
    depth: int = 0
    below: int = 0        # bytes before the cell
    done: bool = False


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key (k1, k2)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("k1"), F.xxhash64("doc_id").alias("k2"))


def _inside(b: Boundary) -> Column:
    """Rows in a boundary's cell."""
    if b.depth == 0:
        return F.lit(True)
    if b.depth < 64:
        return F.col("k1").between(b.at[0], b.at[0] + (1 << (64 - b.depth)) - 1)
    if b.depth == 64:
        return F.col("k1") == b.at[0]
    return (F.col("k1") == b.at[0]) & F.col("k2").between(b.at[1], b.at[1] + (1 << (128 - b.depth)) - 1)


def _cell(depth: int) -> Column:
    """A row's cell number inside the cell of the given depth: the next BITS bits."""
    key, used = ("k1", depth) if depth < 64 else ("k2", depth - 64)
    take = min(BITS, 64 - used)
    return F.shiftrightunsigned(F.shiftleft(F.col(key).bitwiseXOR(F.lit(LOW)), used), 64 - take)


def _histogram(rows: DataFrame, cells: list[Boundary]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Exact bytes a sub-cell of each open cell, in key order."""
    number, which = F.lit(None).cast("long"), F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(cells))):
        number = F.when(_inside(b), _cell(b.depth)).otherwise(number)
        which = F.when(_inside(b), F.lit(i)).otherwise(which)
    sums = (rows.select(which.alias("which"), number.alias("cell"), "size").filter("which is not null")
            .groupBy("which", "cell").agg(F.sum("size").alias("bytes")).collect())
    out: dict = {}
    for r in sums:
        out.setdefault(r["which"], []).append((r["cell"], r["bytes"]))
    return {i: sorted(v) for i, v in out.items()}


def boundaries(rows: DataFrame, total: int, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The shards - 1 keys at which a new shard begins."""
    slack = tolerance * total / shards
    found = [Boundary(total * s // shards) for s in range(1, shards)]
    while any(not b.done for b in found):
        cells = list({(b.at, b.depth): b for b in found if not b.done}.values())
        sums = _histogram(rows, cells)
        by_cell = {(b.at, b.depth): sums.get(i, []) for i, b in enumerate(cells)}
        for b in found:
            if not b.done:
                _narrow(b, by_cell[b.at, b.depth], slack)
    return [b.at for b in found]


def _narrow(b: Boundary, sums: list[tuple[int, int]], slack: float) -> None:
    level, used = (0, b.depth) if b.depth < 64 else (1, b.depth - 64)
    take = min(BITS, 64 - used)
    width = 1 << (64 - used - take)

    def key(cell: int) -> tuple[int, int]:
        at = b.at[level] + cell * width
        return (at, LOW) if level == 0 else (b.at[0], at)

    upto = b.below
    for cell, size in sums:
        if upto + size >= b.target:
            before, after = b.target - upto, upto + size - b.target
            last = b.depth + take == 128
            if min(before, after) <= slack or last:
                b.done = True
                b.at = key(cell) if before <= after else _next(key(cell), level, width)
            else:
                b.at, b.below, b.depth = key(cell), upto, b.depth + take
            return
        upto += size
    b.done = True  # no bytes at all: any key will do


def _next(at: tuple[int, int], level: int, width: int) -> tuple[int, int]:
    """The first key after a cell."""
    top = LOW + SPAN - 1
    if level == 0:
        return (at[0] + width, LOW) if at[0] + width <= top else (top, top)
    if at[1] + width <= top:
        return at[0], at[1] + width
    return (at[0] + 1, LOW) if at[0] < top else (top, top)


def histogram_sort(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = cut_lineage(keyed(docs))
    total = rows.agg(F.sum("size")).first()[0] or 0
    shard = F.lit(0)
    for k1, k2 in boundaries(rows, total, shards, tolerance) if total else []:
        shard = shard + ((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))).cast("int")
    buckets = max(1, -(-4 * slots(docs) // shards))  # pieces of a shard that are numbered apart
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("k2", "k1"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("k1", "k2")
    # at most shards * buckets rows, fixed by the session's partition count
    return (placed.withColumn("row", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort(table(spark, sf_dir, "documents", "doc_id", "text"))
