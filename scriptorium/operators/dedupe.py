"""Paper deduplication (D1, W1, W4, U1, A10) and author merge.

The original walks the records in arrival order (``seq``) with two
dictionaries. Its outcome has a closed form, computed here with two grouped
minima joined back (no iteration, no per-row state):

* ``t0``  = min seq over DOI-less records with this lower(title);
* ``absorb`` = ``t0 < seq`` (never when the title is empty);
* ``d0``  = min seq over records of this DOI that are not absorbed;
* group = ('doi', doi) when the DOI is present and ``seq >= d0``; else
  ('title', lower(title)) when the title is present; else the record is dropped.

Empty DOI strings count as missing. Grouped minima (not windows) are used so a
hot title or DOI aggregates partially before its shuffle; the join back of a
hot key is split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X


def group_keys(records: DataFrame, seq: str = "seq") -> DataFrame:
    """W1, narrow: (seq, group_kind, group_key) per record; only ids, DOIs and titles
    are shuffled. Rows without a join key get one of their own (their seq), so
    missing DOIs and titles don't meet in one partition."""
    r = records.select(F.col(seq).alias("seq"), F.nullif(F.col("doi"), F.lit("")).alias("_doi"),
                       F.nullif(F.lower(F.coalesce("title", F.lit(""))), F.lit("")).alias("_tkey"))
    alone = F.concat(F.lit("\0"), F.col("seq").cast("string"))
    t0 = (r.filter(F.col("_doi").isNull() & F.col("_tkey").isNotNull())
          .groupBy(F.col("_tkey").alias("_tj")).agg(F.min("seq").alias("_t0")))
    r = (r.withColumn("_tj", F.coalesce("_tkey", alone)).join(t0, "_tj", "left")
         .withColumn("_absorb", F.coalesce(F.col("_t0") < F.col("seq"), F.lit(False))))
    d0 = (r.filter(F.col("_doi").isNotNull() & ~F.col("_absorb"))
          .groupBy(F.col("_doi").alias("_dj")).agg(F.min("seq").alias("_d0")))
    r = r.withColumn("_dj", F.coalesce("_doi", alone)).join(d0, "_dj", "left")
    by_doi = F.col("_doi").isNotNull() & F.col("_d0").isNotNull() & (F.col("seq") >= F.col("_d0"))
    kind = F.when(by_doi, F.lit("doi")).when(F.col("_tkey").isNotNull(), F.lit("title"))
    key = F.when(by_doi, F.col("_doi")).when(F.col("_tkey").isNotNull(), F.col("_tkey"))
    return r.select(F.col("seq").alias(seq), kind.alias("group_kind"), key.alias("group_key"))


def dedupe_group(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``group_kind`` ('doi' | 'title') and ``group_key``; rows that
    the original drops get nulls."""
    return records.join(group_keys(records, seq), seq)


def _author_rows(grouped: DataFrame, seq: str) -> DataFrame:
    return (grouped.select("group_kind", "group_key", seq, F.posexplode("authors_struct").alias("pos", "a"))
            .select("group_kind", "group_key", seq, "pos", F.col("a.name").alias("name"),
                    F.col("a.openalex_id").alias("openalex_id"))
            .withColumn("author_key", X.author_key("openalex_id", "name")))


def merge_authors_long(grouped: DataFrame, seq: str = "seq") -> DataFrame:
    """D2 in long form: for groups of more than one record, the union of their
    authors by X5 key, first occurrence winning, in order of first appearance
    (seq, pos). Rows (group_kind, group_key, first_seq, first_pos, name,
    openalex_id); (first_seq, first_pos) is the list order.

    Never gathers a group into one task: the first occurrence per (group,
    author key) is a partial minimum of one number (seq, pos), and the order is
    carried as a column, not computed by a window over the group."""
    sizes = grouped.groupBy("group_kind", "group_key").agg(F.count(F.lit(1)).alias("_n"))
    multi = grouped.join(sizes.filter(F.col("_n") > 1), ["group_kind", "group_key"], "left_semi")
    rows = _author_rows(multi, seq).withColumn("_at", X.place(seq, "pos"))
    firsts = (rows.groupBy("group_kind", "group_key", "author_key").agg(F.min("_at").alias("_at"))
              .select("_at"))
    return (rows.join(firsts, "_at")
            .select("group_kind", "group_key", F.col(seq).alias("first_seq"), F.col("pos").alias("first_pos"),
                    "name", "openalex_id"))


def dedupe_papers(records: DataFrame, seq: str = "seq", with_authors: bool = False) -> DataFrame:
    """D1 + W4 + U1: one survivor per group: the first record's fields, abstract =
    the first non-empty abstract in arrival order (else the first record's). Adds
    ``group_kind``, ``group_key``, ``group_size``. Survivor order (U1): see
    ``survivor_order``. ``with_authors`` also merges authors (D2) of groups of more
    than one record into arrays and rebuilds ``authors_text`` (X4); the long form,
    ``merge_authors_long``, gathers nothing and is the one for large groups.

    Groups are reduced to record ids (hash aggregates on ``seq``); full records and
    abstracts are joined once, by ``seq``."""
    filled = records.select(seq, (F.coalesce("abstract", F.lit("")) != "").alias("_has"))
    picks = (group_keys(records, seq).filter(F.col("group_kind").isNotNull()).join(filled, seq)
             .groupBy("group_kind", "group_key")
             .agg(F.min(seq).alias(seq), F.min(F.when(F.col("_has"), F.col(seq))).alias("_abs_seq"),
                  F.count(F.lit(1)).alias("group_size")))
    abstracts = records.select(F.col(seq).alias("_abs_seq"), F.col("abstract").alias("_abs"))
    # a group without a non-empty abstract keeps its first record's
    picks = picks.withColumn("_abs_seq", F.coalesce("_abs_seq", F.col(seq)))
    out = (picks.join(records.drop("abstract"), seq).join(abstracts, "_abs_seq")
           .withColumnRenamed("_abs", "abstract").drop("_abs_seq"))
    if with_authors and "authors_struct" in records.columns:
        g = records.select(seq, "authors_struct").join(group_keys(records, seq), seq).filter(F.col("group_kind").isNotNull())
        packed = (merge_authors_long(g, seq).groupBy("group_kind", "group_key")
                  .agg(F.sort_array(F.collect_list(F.struct("first_seq", "first_pos", "name", "openalex_id"))).alias("_m")))
        merged = F.transform("_m", lambda x: F.struct(x["name"].alias("name"), x["openalex_id"].alias("openalex_id")))
        out = (out.join(packed, ["group_kind", "group_key"], "left")
               .withColumn("authors_struct", F.coalesce(merged, F.col("authors_struct")))
               .withColumn("authors_text", F.when(F.col("_m").isNotNull(), X.authors_text("authors_struct"))
                           .otherwise(F.col("authors_text") if "authors_text" in records.columns
                                      else X.authors_text("authors_struct")))
               .drop("_m"))
    return out


def survivor_order(survivors: DataFrame, seq: str = "seq") -> DataFrame:
    """DOI groups first, then title groups, each by first arrival."""
    return survivors.orderBy(F.when(F.col("group_kind") == "doi", 0).otherwise(1), F.col(seq))


def dedupe_metrics(records: DataFrame, seq: str = "seq") -> DataFrame:
    """A10: input records, merged records (hit an existing group) and final
    survivors; dropped records (no DOI, empty title) are neither."""
    g = group_keys(records, seq)
    per = (g.filter(F.col("group_kind").isNotNull())
           .groupBy("group_kind", "group_key").agg(F.count(F.lit(1)).alias("n")))
    total = records.agg(F.count(F.lit(1)).alias("original_papers"))
    groups = per.agg(F.count(F.lit(1)).alias("final_unique_papers"),
                     F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_merged"))
    return _one_row(total, groups)


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two one-row aggregates without a cross join: tag, union, fold."""
    cols_a, cols_b = a.columns, b.columns
    ua = a.select(*[F.col(c).cast("long").alias(c) for c in cols_a],
                  *[F.lit(None).cast("long").alias(c) for c in cols_b])
    ub = b.select(*[F.lit(None).cast("long").alias(c) for c in cols_a],
                  *[F.col(c).cast("long").alias(c) for c in cols_b])
    return ua.unionByName(ub).agg(*[F.max(c).alias(c) for c in cols_a + cols_b])
