"""Author profiles (Q3): totals (A6), topic profile (A7) and its chart.

Written for all authors at once; one author is a filter on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.plans.papers import chart_arrays

TOP_TOPICS = 6


def author_totals(authors: DataFrame, bridge: DataFrame, papers: DataFrame) -> DataFrame:
    """Per author: papers and citations (null citations count 0); authors
    without papers get zeros. Aggregated on the bridge side first."""
    pc = (bridge.join(papers.select("paper_id", F.coalesce("citation_count", F.lit(0)).alias("c")), "paper_id")
          .groupBy("author_id").agg(F.count(F.lit(1)).alias("total_papers"), F.sum("c").alias("total_citations")))
    return (authors.select("author_id").join(pc, "author_id", "left")
            .select("author_id", F.coalesce("total_papers", F.lit(0)).cast("long").alias("total_papers"),
                    F.coalesce("total_citations", F.lit(0)).cast("long").alias("total_citations")))


def author_profile_sums(bridge: DataFrame, interaction: DataFrame) -> DataFrame:
    """Per author, the element-wise sum of the distributions of their papers
    divided by the number of their papers *having* a (non-empty) distribution.
    Long form (author_id, topic_id = index, prob). Partial aggregation on
    (author, index) before the shuffle."""
    dist = interaction.filter(F.size("topic_distribution") > 0).select("paper_id", "topic_distribution")
    ap = bridge.select("author_id", "paper_id").join(dist, "paper_id")
    n = ap.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_dist"))
    sums = (ap.select("author_id", F.posexplode("topic_distribution").alias("topic_id", "p"))
            .groupBy("author_id", "topic_id").agg(F.sum("p").alias("total")))
    return sums.join(n, "author_id").select("author_id", "topic_id", "total", (F.col("total") / F.col("n_dist")).alias("prob"))


def author_profile(bridge: DataFrame, interaction: DataFrame, topic: DataFrame, n: int = TOP_TOPICS) -> DataFrame:
    """Q3 chart: the ``n`` largest summed entries (ties by index), then unknown
    topics and sums <= 0 dropped; probability = round(sum / papers, 4).
    (author_id, rank, topic_id, subject, probability)."""
    s = author_profile_sums(bridge, interaction)
    w = Window.partitionBy("author_id").orderBy(F.desc("total"), F.asc("topic_id"))
    top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.join(topic.select("topic_id", F.col("name").alias("subject")), "topic_id")
            .filter(F.col("total") > 0)
            .select("author_id", "rank", "topic_id", "subject", X.round4("prob").alias("probability")))


def author_record(authors: DataFrame, bridge: DataFrame, papers: DataFrame, interaction: DataFrame, topic: DataFrame,
                  author_id=None) -> DataFrame:
    """Q3 / F8, the full record: id, external id, name, institution, faculty, totals
    and chart; one id is a filter (empty = not found)."""
    a, own = authors, bridge
    if author_id is not None:
        a, own = (x.filter(F.col("author_id") == F.lit(author_id)) for x in (authors, bridge))
    chart = chart_arrays(author_profile(own, interaction, topic), "author_id")
    return (a.join(author_totals(a, own, papers), "author_id").join(chart, "author_id", "left")
            .select("author_id", "openalex_id", "name", "institution", "faculty", "total_papers", "total_citations",
                    F.coalesce("chart_subjects", F.array().cast("array<string>")).alias("chart_subjects"),
                    F.coalesce("chart_probabilities", F.array().cast("array<double>")).alias("chart_probabilities")))
