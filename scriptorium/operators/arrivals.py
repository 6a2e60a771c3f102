"""D1, W1, W4 as records arrive: batches join groups that earlier batches made.

The original's two dictionaries are tables here, kept in a ``MartSet``: DOI -> first
record that registered it, title -> first DOI-less record with it. A batch's records
follow those of all earlier ones in ``seq``, so a registry entry always precedes them and
never changes: a batch appends what is new and looks the rest up by joins that read
the keys of the batch only. Groups hold ids (first record, first record with
an abstract, number of records) and are merged file by file. One commit a batch carries all
of it; k batches in arrival order give what one full run gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import filemerge as FM
from scriptorium.session import cut_lineage, landing
from scriptorium.sources.martset import MartSet

_KEYS = ["group_kind", "group_key"]


def _first(known: DataFrame | None, fresh: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at) for the keys of ``fresh``, the registry's entry before the batch's own."""
    if known is None:
        return fresh
    return known.join(fresh.select(key), key, "left_semi").unionByName(fresh).groupBy(key).agg(F.min(at).alias(at))


def batch_keys(records: DataFrame, titles: DataFrame | None, dois: DataFrame | None, seq: str = "seq"
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W1 of a batch after the registries ``titles`` (tkey, t0) and ``dois`` (doi, d0): (keys, first
    records by title, by DOI). A record without DOI and title has null keys, as in ``dedupe.group_keys``."""
    r = records.select(F.col(seq).alias("seq"), F.nullif(F.col("doi"), F.lit("")).alias("doi"),
                       F.nullif(F.lower(F.coalesce("title", F.lit(""))), F.lit("")).alias("tkey"))
    alone = F.concat(F.lit("\0"), F.col("seq").cast("string"))  # a key of its own for a row without one
    # every title of the batch is looked up; only DOI-less records register theirs
    own = (r.filter("tkey is not null").groupBy("tkey").agg(F.min(F.when(F.col("doi").isNull(), F.col("seq"))).alias("t0")))
    t0 = _first(titles, own, "tkey", "t0").filter("t0 is not null")
    r = (r.withColumn("_t", F.coalesce("tkey", alone)).join(t0.withColumnRenamed("tkey", "_t"), "_t", "left")
         .withColumn("absorbed", F.coalesce(F.col("t0") < F.col("seq"), F.lit(False))))
    own = r.filter("doi is not null").groupBy("doi").agg(F.min(F.when(~F.col("absorbed"), F.col("seq"))).alias("d0"))
    d0 = _first(dois, own, "doi", "d0").filter("d0 is not null")
    r = r.withColumn("_d", F.coalesce("doi", alone)).join(d0.withColumnRenamed("doi", "_d"), "_d", "left")
    by_doi = F.col("doi").isNotNull() & (F.coalesce("d0", F.col("seq") + 1) <= F.col("seq"))
    kind = F.when(by_doi, F.lit("doi")).when(F.col("tkey").isNotNull(), F.lit("title"))
    key = F.when(by_doi, F.col("doi")).when(F.col("tkey").isNotNull(), F.col("tkey"))
    return r.select(F.col("seq").alias(seq), kind.alias("group_kind"), key.alias("group_key")), t0, d0


class PaperRegistry:
    """The groups of all records that have arrived, in ``mart_set``: tables records, titles,
    dois, groups and arrived (the last ``seq``)."""

    def __init__(self, mart_set: MartSet, seq: str = "seq"):
        self.set, self.seq = mart_set, seq

    def _table(self, entries: dict, name: str) -> DataFrame | None:
        return self.set.open(entries[name]) if name in entries else None

    def arrive(self, records: DataFrame) -> DataFrame:
        """Takes a batch in, as one commit. Returns its (seq, group_kind, group_key). A batch whose
        ``seq`` doesn't follow the last one's was taken before or is out of order: ValueError."""
        start = self.set.latest()
        entries = self.set.manifest(start)
        arrived = self._table(entries, "arrived")
        last = arrived.agg(F.max("last_seq")).first()[0] if arrived is not None else None
        ends = records.agg(F.min(self.seq).alias("lo"), F.max(self.seq).alias("hi")).first()
        if ends["lo"] is None:
            return records.select(self.seq, F.lit(None).cast("string").alias("group_kind"), F.lit(None).cast("string").alias("group_key"))
        if last is not None and ends["lo"] <= last:
            raise ValueError(f"records up to {last} have arrived; this batch begins at {ends['lo']}")
        spark = records.sparkSession
        with landing(spark):
            titles, dois = self._table(entries, "titles"), self._table(entries, "dois")
            keys, t0, d0 = batch_keys(records, titles, dois, self.seq)
            keys, t0, d0 = cut_lineage(keys), cut_lineage(t0), cut_lineage(d0)
            new_titles = t0 if titles is None else t0.join(titles.select("tkey"), "tkey", "left_anti")
            new_dois = d0 if dois is None else d0.join(dois.select("doi"), "doi", "left_anti")
            has = records.select(self.seq, (F.coalesce("abstract", F.lit("")) != "").alias("has"))
            picks = (keys.filter("group_kind is not null").join(has, self.seq).groupBy(*_KEYS)
                     .agg(F.min(self.seq).alias("first_seq"), F.min(F.when(F.col("has"), F.col(self.seq))).alias("abs_seq"),
                          F.count(F.lit(1)).alias("group_size")))
            new = {**entries, "records": self.set.longer(entries, "records", records),
                   "titles": self.set.longer(entries, "titles", new_titles), "dois": self.set.longer(entries, "dois", new_dois),
                   "arrived": self.set.write(spark.createDataFrame([(ends["hi"],)], "last_seq long"), "arrived")}
            if "groups" in entries:
                picks = cut_lineage(picks)
                old = FM.rows_with_keys(self.set, entries["groups"], picks)
                both = old.unionByName(picks).groupBy(*_KEYS).agg(F.min("first_seq").alias("first_seq"), F.min("abs_seq").alias("abs_seq"),
                                                                  F.sum("group_size").alias("group_size"))
                new["groups"] = FM.merged(self.set, "groups", entries, both, ["first_seq", "abs_seq", "group_size"])
            else:
                new["groups"] = FM.first_entry(self.set, "groups", picks, _KEYS)
            self.set.publish(new, start)
        return keys

    def groups(self) -> DataFrame:
        return self.set.read("groups")

    def survivors(self) -> DataFrame:
        """D1 + W4 over all that has arrived, as ``dedupe.dedupe_papers`` gives it."""
        records = self.set.read("records")
        picks = self.groups().withColumn("abs_seq", F.coalesce("abs_seq", "first_seq"))
        abstracts = records.select(F.col(self.seq).alias("abs_seq"), "abstract")
        return (picks.withColumnRenamed("first_seq", self.seq).join(records.drop("abstract"), self.seq)
                .join(abstracts, "abs_seq").drop("abs_seq"))
