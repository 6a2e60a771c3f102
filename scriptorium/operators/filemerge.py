"""S5 on stored tables: a copy-on-write merge that rewrites only the files it must.

A table is a list of files, each with the range of its keys' places and a Bloom
filter of them. The place of a key is the key itself (one whole-number column) or its
64-bit hash; files are written in ranges of it, so a batch of new or recent keys meets few
of them. A merge asks, with joins only, which files may hold a key of the batch:

1. place ranges are cut into tiles; a key's tile finds the files that cover it;
2. of these, the files whose range holds the place and whose filter has all the key's bits.

Filters have no false negatives, so every row to be updated is in a file found. Those
files are read, merged with the batch by ``upsert`` and written anew, inserted rows
with them; all others keep their names. The new list of files becomes visible by one
commit of the ``MartSet``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from scriptorium.operators.upsert import laid_over, one_per_key
from scriptorium.session import landed
from scriptorium.sources.martset import MartSet

PROBES = 3                # bits of a key in a filter
BITS_A_KEY = 16           # with 3 probes: about 1 key in 190 is taken for one that is there
TILES = 4096              # of the whole range of places
FIRST_ASKED = 64          # one key in so many asks first; only files that none of these finds are asked about all keys
_FILES = "file string, lo long, hi long, keys long, bits long, words string"


def place_of(df: DataFrame, keys: list[str]) -> Column:
    """Where a key stands among the files; a null key stands first."""
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(F.col(keys[0]).cast("long"), F.lit(-(1 << 63)))
    return F.xxhash64(*keys)


def _probes(df: DataFrame, keys: list[str], bits: str) -> DataFrame:
    """Adds ``probe``, a bit of the filter, one row per bit of a key."""
    hashes = F.array(*[F.xxhash64(*keys, F.lit(i)) for i in range(PROBES)])
    return df.withColumn("_hash", F.explode(hashes)).withColumn("probe", F.pmod("_hash", F.col(bits))).drop("_hash")


def store(mart_set: MartSet, table: str, df: DataFrame, keys: list[str], files: int | None = None) -> DataFrame:
    """Writes rows as files in ranges of their places: ``files`` of them, or as many as their
    size asks for. Returns the files' index:
    (file, lo, hi, keys, bits, words), ``words`` naming the folder of their filters."""
    folder = mart_set.new_folder(table)
    placed = df.withColumn("_place", place_of(df, keys))
    placed = placed.repartitionByRange(files, "_place") if files else placed.repartitionByRange("_place")
    placed.sortWithinPartitions("_place").drop("_place").write.parquet(f"{folder}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    named = stored.select(F.col("_metadata.file_path").alias("file"), *keys).withColumn("_place", place_of(df, keys))
    sizes = named.groupBy("file").agg(F.min("_place").alias("lo"), F.max("_place").alias("hi"), F.count(F.lit(1)).alias("keys"))
    index = landed(sizes.withColumn("bits", F.greatest(F.lit(64), F.col("keys") * BITS_A_KEY)).withColumn("words", F.lit(f"{folder}/words")))
    bits = _probes(named.join(index.select("file", "bits"), "file"), keys, "bits")
    words = bits.groupBy("file", F.shiftright("probe", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(probe & 63 as int))")).alias("set"))
    words.write.parquet(f"{folder}/words")
    return index


def files_of(mart_set: MartSet, table: str, number: int | None = None) -> DataFrame:
    """The index of a stored table's files."""
    entry = mart_set.manifest(number)[table]
    return mart_set.spark.read.schema(_FILES).parquet(entry["files"])


def _entry(mart_set: MartSet, table: str, index: DataFrame, df: DataFrame, keys: list[str]) -> dict:
    path = mart_set.new_folder(f"{table}_files")
    index.write.parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return {"files": path, "schema": schema, "keys": keys}


def create(mart_set: MartSet, table: str, df: DataFrame, keys: list[str], files: int | None = None) -> int:
    """Puts a table under merge: writes its files and commits. Other tables stay."""
    start = mart_set.latest()
    return mart_set.publish({**mart_set.manifest(start), table: first_entry(mart_set, table, df, keys, files)}, start)


def touched(index: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """(file): the files that may hold a key of ``batch``."""
    spark = index.sparkSession
    ends = index.agg(F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi")).first()
    if ends["lo"] is None:
        return index.select("file")
    width = max((ends["hi"] - ends["lo"]) / TILES, 1.0)
    tile = lambda c: F.floor((F.col(c).cast("double") - F.lit(ends["lo"])) / width)
    covers = index.withColumn("tile", F.explode(F.sequence(tile("lo"), tile("hi"))))
    asked = batch.select(*keys, place_of(batch, keys).alias("_place")).distinct().withColumn("tile", tile("_place"))
    near = (asked.join(covers, "tile").filter(F.col("_place").between(F.col("lo"), F.col("hi")))
            .select(*keys, "file", "bits", "words"))
    few = F.pmod(F.xxhash64(*keys, F.lit(PROBES)), F.lit(FIRST_ASKED)) == 0
    first = landed(_found(near.filter(few), keys))
    others = _found(near.filter(~few).join(first, "file", "left_anti"), keys)
    return first.unionByName(others)


def _found(near: DataFrame, keys: list[str]) -> DataFrame:
    """(file): the files whose filter has all bits of one of the keys that ``near`` (keys, file, bits, words) asks it for."""
    spark = near.sparkSession
    probes = landed(_probes(near, keys, "bits").withColumn("word", F.shiftright("probe", 6)))
    folders = [r["words"] for r in probes.select("words").distinct().collect()]  # one a commit
    if not folders:
        return near.select("file").limit(0)
    words = spark.read.parquet(*folders)
    bit = F.expr("shiftleft(1L, cast(probe & 63 as int))")
    there = probes.join(words, ["file", "word"]).filter(F.col("set").bitwiseAND(bit) != 0)
    key = F.xxhash64(*keys)
    return (there.groupBy("file", key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= PROBES)
            .select("file").distinct())


def merged(mart_set: MartSet, table: str, entries: dict, updates: DataFrame, update_cols: list[str], order: str | None = None) -> dict:
    """The entry of the table with ``updates`` merged in: files are written, nothing is published."""
    entry = entries[table]
    batch = landed(one_per_key(updates, entry["keys"], order))
    return merged_in(mart_set, table, entries, batch, update_cols, hits(mart_set, entry, batch))


def hits(mart_set: MartSet, entry: dict, batch: DataFrame) -> DataFrame:
    """(file), stored: the table's files that may hold a key of ``batch``."""
    return landed(touched(mart_set.spark.read.schema(_FILES).parquet(entry["files"]), batch, entry["keys"]))


def merged_in(mart_set: MartSet, table: str, entries: dict, batch: DataFrame, update_cols: list[str], hit: DataFrame) -> dict:
    """``merged`` for a stored batch of one row per key whose files (``hits``) are known."""
    entry = entries[table]
    keys, spark = entry["keys"], mart_set.spark
    index = spark.read.schema(_FILES).parquet(entry["files"])
    names = [r["file"] for r in hit.collect()]  # files to be rewritten
    empty = spark.createDataFrame([], entry["schema"])
    base = spark.read.schema(entry["schema"]).parquet(*names) if names else empty
    fresh = store(mart_set, table, empty.unionByName(laid_over(base, batch, keys, update_cols)), keys)
    columns = ["file", "lo", "hi", "keys", "bits", "words"]
    kept = index.join(hit, "file", "left_anti")
    return _entry(mart_set, table, kept.select(*columns).unionByName(fresh.select(*columns)), empty, keys)


def merge(mart_set: MartSet, table: str, updates: DataFrame, update_cols: list[str], order: str | None = None) -> int:
    """S5 into a stored table, as one commit: the table then equals ``upsert(table, updates)``.
    Ties in the batch are settled as ``upsert`` does. Returns the commit's number."""
    start = mart_set.latest()
    entries = mart_set.manifest(start)
    return mart_set.publish({**entries, table: merged(mart_set, table, entries, updates, update_cols, order)}, start)


def rows_with_keys(mart_set: MartSet, entry: dict, batch: DataFrame, hit: DataFrame | None = None) -> DataFrame:
    """The stored rows whose key is in ``batch``, from the files that may hold one (``hit``, if known)."""
    keys, spark = entry["keys"], mart_set.spark
    names = [r["file"] for r in (hits(mart_set, entry, batch) if hit is None else hit).collect()]
    if not names:
        return spark.createDataFrame([], entry["schema"])
    return spark.read.schema(entry["schema"]).parquet(*names).join(batch.select(*keys).distinct(), keys, "left_semi")


def first_entry(mart_set: MartSet, table: str, df: DataFrame, keys: list[str], files: int | None = None) -> dict:
    """The entry of a new table; nothing is published."""
    return _entry(mart_set, table, store(mart_set, table, df, keys, files), df, keys)
