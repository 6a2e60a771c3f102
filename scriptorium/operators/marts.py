"""Load-time marts (M1-M7) with the joins J1-J4 and keyed picks W2/W3.

Input is the topic step's output, one row per paper record:
``results(seq, doi, title, abstract, authors_struct, year, venue,
citation_count, cluster_id, cluster_label, predicted_multi_labels,
topic_keywords, topic_distribution)``; ``seq`` is the record's position in
the input (arrival order). Natural keys replace database sequences: papers by
``doi``, authors by X5 ``author_key``, topics by ``topic_id``.

"First wins" / "last wins" per key reduce each key to the number of its first or
last record (a hash aggregate that works partially before the shuffle, so a key
holding a third of all rows never gathers in one task); the record's values are
joined back by that number. No text passes through an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X

EXTERNAL = "External"


def _picked(df: DataFrame, keys: list[str], order: list[str], cols: list[str], best) -> DataFrame:
    """Per key, the values of the row with the best ``order`` (one or two whole
    numbers that are unique within a key)."""
    at = F.col(order[0]) if len(order) == 1 else X.place(*order)
    rows = df.select(*keys, at.alias("_at"), *cols)
    picks = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best("_at").alias("_best"))
    same = F.col("_at") == F.col("_best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(picks, same).select(*keys, *cols)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Per key, the values of the row with the smallest ``order``."""
    return _picked(df, keys, order, cols, F.min)


def last_per_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Per key, the values of the row with the largest ``order``."""
    return _picked(df, keys, order, cols, F.max)


def _defaults(results: DataFrame) -> DataFrame:
    """Missing topic fields default as in the loader: outlier id and label."""
    return (results.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(X.OUTLIER_TOPIC_ID)))
            .withColumn("cluster_label", F.coalesce("cluster_label", F.lit(X.OUTLIER_LABEL))))


def topic_dim(results: DataFrame) -> DataFrame:
    """M1: one row per cluster id; the last record wins; name = X7 of its label;
    keywords = its topic keywords."""
    r = (_defaults(results)
         .withColumn("name", X.label_name("cluster_label"))
         .withColumn("keywords", F.coalesce("topic_keywords", F.array().cast("array<string>"))))
    return (last_per_key(r, ["cluster_id"], ["seq"], ["name", "keywords"])
            .withColumnRenamed("cluster_id", "topic_id"))


def rejected_papers(results: DataFrame) -> DataFrame:
    """Records without a DOI: the paper table requires one; kept as a side output."""
    return results.filter(F.col("doi").isNull())


def paper_dim(results: DataFrame) -> DataFrame:
    """M2: one row per DOI; upsert semantics, so the last record's title, year,
    abstract and citations win; ``url`` is '' (never collected); ``venue`` is
    carried. Records without DOI go to ``rejected_papers``."""
    r = (results.filter(F.col("doi").isNotNull())
         .withColumn("title", F.coalesce("title", F.lit("")))
         .withColumn("abstract", F.coalesce("abstract", F.lit("")))
         .withColumn("citation_count", F.coalesce("citation_count", F.lit(0))))
    return (last_per_key(r, ["doi"], ["seq"], ["title", "year", "abstract", "citation_count", "venue"])
            .withColumn("url", F.lit("")))


def _authorships(results: DataFrame) -> DataFrame:
    """(seq, pos, name, openalex_id, author_key) per listed author."""
    return (results.select("seq", "doi", F.posexplode("authors_struct").alias("pos", "a"))
            .select("seq", "doi", "pos", F.col("a.name").alias("name"), F.col("a.openalex_id").alias("openalex_id"))
            .withColumn("author_key", X.author_key("openalex_id", "name")))


def roster_faculty(roster: DataFrame) -> DataFrame:
    """J1 lookup: lower(name) -> faculty; on repeated names the last roster row
    wins (``roster`` carries its own ``seq``)."""
    r = roster.withColumn("name_key", F.lower("name"))
    return last_per_key(r, ["name_key"], ["seq"], ["faculty"])


def author_dim(results: DataFrame, roster: DataFrame, home: str) -> DataFrame:
    """M3: one row per author key; the first occurrence (seq, pos) gives name
    and external id; faculty from the roster by lower(name) (J1); institution
    is ``home`` if a faculty was found, else 'External'."""
    a = first_per_key(_authorships(results), ["author_key"], ["seq", "pos"], ["name", "openalex_id"])
    fac = roster_faculty(roster)
    return (a.join(fac, F.lower(a["name"]) == fac["name_key"], "left")
            .select("author_key", "openalex_id", "name", "faculty",
                    F.when(F.coalesce(F.col("faculty"), F.lit("")) != "", F.lit(home))
                     .otherwise(F.lit(EXTERNAL)).alias("institution"),
                    F.lit(None).cast("string").alias("email")))


def paper_authors(results: DataFrame) -> DataFrame:
    """M6: distinct (doi, author_key) bridge, for papers with a DOI."""
    return (_authorships(results).filter(F.col("doi").isNotNull())
            .select("doi", "author_key").distinct())


def loaded(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Only rows of papers that were loaded, matched by DOI."""
    return rows.join(papers.select("doi"), "doi", "left_semi")


def interactions(results: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """M7: one interaction per paper (DOI), the last record wins: primary topic,
    distribution and multi-labels. With ``topics`` (topic_id), the primary topic is
    looked up there (J4): an id the topic table lacks becomes null."""
    r = (_defaults(results).filter(F.col("doi").isNotNull())
         .withColumn("topic_distribution", F.coalesce("topic_distribution", F.array().cast("array<double>")))
         .withColumn("predicted_multi_labels",
                     F.coalesce("predicted_multi_labels", F.array().cast("array<string>"))))
    last = last_per_key(r, ["doi"], ["seq"], ["cluster_id", "topic_distribution", "predicted_multi_labels"])
    if topics is not None:
        known = topics.select(F.col("topic_id").alias("cluster_id"), F.lit(True).alias("_known"))
        last = (last.join(known, "cluster_id", "left")
                .withColumn("cluster_id", F.when(F.col("_known"), F.col("cluster_id"))).drop("_known"))
    return last.withColumnRenamed("cluster_id", "primary_topic_id")


def faculty_topic_stat(results: DataFrame, authors: DataFrame) -> DataFrame:
    """M4: per (faculty, topic): papers and citations. A record counts once per
    distinct faculty among its authors; the outlier topic is included; a null
    citation count counts as 0. ``authors`` is M3's output."""
    r = (_defaults(results).filter(F.col("doi").isNotNull())
         .select("seq", "authors_struct", F.col("cluster_id").alias("topic_id"),
                 F.coalesce("citation_count", F.lit(0)).alias("citations")))
    fac = authors.filter(F.coalesce(F.col("faculty"), F.lit("")) != "").select("author_key", "faculty")
    # each author row carries its record's topic and citations, so the records
    # are read once (no join back to them)
    listed = (r.select("seq", "topic_id", "citations", F.explode("authors_struct").alias("a"))
              .select("seq", "topic_id", "citations", X.author_key("a.openalex_id", "a.name").alias("author_key")))
    per_record = listed.join(fac, "author_key").select("seq", "topic_id", "citations", "faculty").distinct()
    return (per_record.groupBy("faculty", "topic_id")
            .agg(F.count(F.lit(1)).alias("total_papers"), F.sum("citations").alias("total_citations")))


def yearly_topic_stat(results: DataFrame) -> DataFrame:
    """M5: per (year, topic): records; null and 0 years skipped."""
    r = _defaults(results).filter(F.col("doi").isNotNull() & F.col("year").isNotNull() & (F.col("year") != 0))
    return (r.groupBy("year", F.col("cluster_id").alias("topic_id"))
            .agg(F.count(F.lit(1)).alias("total_papers")))


def coauthor_edges_from_results(results: DataFrame) -> DataFrame:
    """G1 over the load input: distinct (paper, author) pairs, then unordered
    author pairs per paper weighted by shared papers."""
    from scriptorium.operators.network import coauthor_edges
    bridge = paper_authors(results).select(F.col("doi").alias("paper_id"), F.col("author_key").alias("author_id"))
    return coauthor_edges(bridge)
