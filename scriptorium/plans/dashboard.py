"""Dashboard queries.

Inputs are the loaded tables: ``author(author_id, name, faculty,
institution)``, ``paper(paper_id, ...)``, ``paper_author(paper_id,
author_id)``, ``topic(topic_id, name, keywords)`` and
``yearly_stat(year, topic_id, total_papers)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import OUTLIER_TOPIC_ID, year_text


def home(authors: DataFrame, institution: str) -> DataFrame:
    """authors of the home institution."""
    return authors.filter(F.col("institution") == institution)


def external(authors: DataFrame, institution: str) -> DataFrame:
    """F3 complement, nulls included (an ORM ``exclude`` keeps NULL rows)."""
    return authors.filter(~F.col("institution").eqNullSafe(institution))


def real_topics(topic: DataFrame) -> DataFrame:
    """every topic but the outlier."""
    return topic.filter(F.col("topic_id") != OUTLIER_TOPIC_ID)


def works_per_author(authors: DataFrame, paper_author: DataFrame) -> DataFrame:
    """A2: works per author, authors without works included with 0.

    The bridge is aggregated first (partial aggregation before the shuffle, so
    a prolific author does not make a hot partition), then joined to authors."""
    counts = paper_author.groupBy("author_id").agg(F.count("paper_id").alias("works_count"))
    return (authors.join(counts, "author_id", "left")
            .withColumn("works_count", F.coalesce("works_count", F.lit(0)).cast("long")))


def top_authors(authors: DataFrame, paper_author: DataFrame, institution: str, limit: int = 5) -> DataFrame:
    """L2: home authors by works count, descending, first ``limit`` (ties by id).
    ``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition top-k,
    never a full sort."""
    return (works_per_author(home(authors, institution), paper_author)
            .orderBy(F.desc("works_count"), F.asc("author_id"))
            .limit(limit)
            .select(F.col("author_id").alias("id"), "name", "works_count", "faculty"))


def dashboard_summary(paper: DataFrame, authors: DataFrame, topic: DataFrame, institution: str) -> DataFrame:
    """A1: one row: papers, home authors, topics except the outlier.

    The three inputs are tagged and unioned (no shuffle), then a single global
    aggregate counts each tag; partial aggregation keeps the final exchange at
    one row per input partition."""
    tagged = (paper.select(F.lit(0).alias("k"))
              .unionByName(home(authors, institution).select(F.lit(1).alias("k")))
              .unionByName(real_topics(topic).select(F.lit(2).alias("k"))))
    return tagged.agg(F.count_if(F.col("k") == 0).alias("total_papers"),
                      F.count_if(F.col("k") == 1).alias("total_authors"),
                      F.count_if(F.col("k") == 2).alias("total_clusters"))


def all_topics(topic: DataFrame) -> DataFrame:
    """Topics except the outlier, by topic id."""
    return real_topics(topic).select("topic_id", "name", "keywords").orderBy("topic_id")


def trend_rows(yearly_stat: DataFrame, topic: DataFrame) -> DataFrame:
    """Yearly stat rows with the topic name (topic is a bounded dimension)."""
    return (yearly_stat.join(topic.select("topic_id", "name"), "topic_id")
            .select(year_text("year").alias("year"), F.col("year").alias("year_num"),
                    "topic_id", "name", "total_papers"))


def domain_trends_long(yearly_stat: DataFrame, topic: DataFrame) -> DataFrame:
    """U4 in long form: one row per (year, topic name). Same-named topics
    overwrite one another in the original; the last in (year) order wins, which
    for a stable year order is the last row written -- we take the highest
    topic id as a deterministic stand-in."""
    rows = trend_rows(yearly_stat, topic)
    return (rows.groupBy("year", "year_num", "name")
            .agg(F.max_by("total_papers", "topic_id").alias("total_papers")))


def domain_trends(yearly_stat: DataFrame, topic: DataFrame, names: list[str] | None = None,
                  zero_fill: bool = True) -> DataFrame:
    """U4 + U5: one row per year (ascending), one column per topic name.

    ``names`` fixes the pivot columns, which spares Spark the extra job that
    finds the distinct values; the topic dimension is bounded, so when omitted
    the names are taken from it. U5 fills absent cells with 0."""
    long = domain_trends_long(yearly_stat, topic)
    if names is None:
        names = [r["name"] for r in topic.select("name").distinct().orderBy("name").collect()]
    wide = long.groupBy("year", "year_num").pivot("name", names).agg(F.first("total_papers"))
    if zero_fill:
        wide = wide.fillna(0, subset=names)
    return wide.orderBy("year_num").drop("year_num")


def series_keywords(names: DataFrame, topic: DataFrame, name_col: str = "name") -> DataFrame:
    """Each series name with its topic keywords, matched on the trimmed name;
    an unknown name gets an empty list. Of same-named topics the highest id
    stands."""
    t = topic.groupBy(F.trim("name").alias("_key")).agg(F.max_by("keywords", "topic_id").alias("keywords"))
    return (names.join(t, F.trim(F.col(name_col)) == F.col("_key"), "left")
            .select(*names.columns, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))
