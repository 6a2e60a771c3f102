"""Paper search, cards and detail (Q1, Q2) with F6-F9, J5-J9, L3-L5, L8, L9.

Loaded tables: ``paper(paper_id, doi, title, year, citation_count, ...)``,
``paper_author(paper_id, author_id)``, ``author(author_id, name,
institution, ...)``, ``interaction(paper_id, primary_topic_id,
topic_distribution, predicted_multi_labels)``, ``topic(topic_id, name,
keywords)`` (bounded: one row per topic, broadcast).

Filters run first, the page is cut next, and only then are the page's rows
(at most ``size``) joined with their authors and topics.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.network import scope_by_topics
from scriptorium.session import cut_lineage

DETAIL_FLOOR = 0.01   # paper chart: keep probabilities above this
CHART_FLOOR = 0.02    # dashboard chart: keep probabilities above this
TOP_TOPICS = 6
SEEK_ROWS = 4096      # rows a page may skip by a top-k
SEEK_BINS = 4096      # bins of one counting pass towards a deeper page


def papers_of(papers: DataFrame, bridge: DataFrame, author_id) -> DataFrame:
    """papers of one author (semi-join on the bridge)."""
    mine = bridge.filter(F.col("author_id") == F.lit(author_id)).select("paper_id")
    return papers.join(mine, "paper_id", "left_semi")


def _icontains(col: Column | str, text: str) -> Column:
    """Case-insensitive containment, no LIKE wildcards (``%`` and ``_`` are
    literal, as in an escaped ORM ``icontains``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.contains(F.upper(c), F.lit(text.upper()))


def search_papers(papers: DataFrame, bridge: DataFrame, authors: DataFrame, text: str) -> DataFrame:
    """papers whose title or any author's name contains ``text``,
    case-insensitively; each paper once (semi-joins, no ``distinct``)."""
    by_author = bridge.join(authors.filter(_icontains("name", text)).select("author_id"), "author_id", "left_semi")
    by_title = papers.filter(_icontains("title", text)).select("paper_id")
    hits = by_title.unionByName(by_author.select("paper_id"))
    return papers.join(hits, "paper_id", "left_semi")


def card_order(papers: DataFrame) -> DataFrame:
    """L3: year desc (nulls first), citations desc (nulls first), id."""
    return papers.orderBy(F.desc_nulls_first("year"), F.desc_nulls_first("citation_count"), F.asc("paper_id"))


@dataclass(frozen=True)
class PageInfo:
    current_page: int
    total_pages: int
    total_items: int
    page_size: int
    has_next: bool
    has_previous: bool


def clamp_page(number, total_items: int, size: int) -> PageInfo:
    """L4: pages = max(1, ceil(n / size)); a page that is not an integer is 1;
    an out-of-range page (beyond the last, or < 1) is the last page."""
    pages = max(1, math.ceil(total_items / size))
    try:
        p = int(number)
    except (TypeError, ValueError, OverflowError):
        p = 1
    if p < 1 or p > pages:
        p = pages
    return PageInfo(p, pages, total_items, size, p < pages, p > 1)


def page(df: DataFrame, number, size: int) -> tuple[DataFrame, PageInfo]:
    """L4 in L3 order: one count action, then the page. However deep it lies, the
    rows before it are counted, not gathered: see ``seek``."""
    info = clamp_page(number, df.count(), size)
    rest, skip = seek(df, (info.current_page - 1) * size)
    return card_order(rest).offset(skip).limit(size), info


def order_keys() -> list[Column]:
    """L3 as ascending whole numbers: nulls (first in descending order) are the largest."""
    null_first = F.lit((1 << 31) - 1)
    return [-F.coalesce(F.col("year"), null_first).cast("long"),
            -F.coalesce(F.col("citation_count"), null_first).cast("long"), F.col("paper_id").cast("long")]


def seek(df: DataFrame, offset: int) -> tuple[DataFrame, int]:
    """(rows, skip): the rows from some point of the L3 order on, and how many of
    them still precede position ``offset``, at most ``SEEK_ROWS``.

    The point is found by counts: the range of the first key is cut into ``SEEK_BINS``
    equal bins, the bin that holds the position is cut again until it is one value,
    then the next key takes over inside it. Each pass is one grouped count of at
    most ``SEEK_BINS`` rows, so no pass sorts or gathers rows."""
    keys, cell, skip = order_keys(), F.lit(True), offset
    before = F.lit(False)  # rows that surely precede the position
    for key in keys:
        while skip > SEEK_ROWS:
            inside = df.filter(cell & ~before)
            ends = inside.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
            if ends["lo"] is None or ends["lo"] == ends["hi"]:
                break
            width = -(-(ends["hi"] - ends["lo"] + 1) // SEEK_BINS)
            bin_no = F.floor((key - F.lit(ends["lo"])) / F.lit(width))
            counts = sorted((r["b"], r["n"]) for r in inside.groupBy(bin_no.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
            for b, n in counts:
                if skip < n:
                    break
                skip -= n
            start = ends["lo"] + b * width
            before = before | (cell & (key < F.lit(start)))
            cell = cell & (key >= F.lit(start)) & (key < F.lit(start + width))
    return df.filter(~before), skip


def page_info_frame(spark, info: PageInfo) -> DataFrame:
    return spark.createDataFrame([tuple(info.__dict__.values())],
                                 "current_page int, total_pages int, total_items long, page_size int, "
                                 "has_next boolean, has_previous boolean")


def label_topics(interaction: DataFrame, topic: DataFrame) -> DataFrame:
    """Per paper, the topics named by its multi-labels, in label order:
    X8 parses the id, unknown ids and unparsable labels are skipped.
    Returns (paper_id, topic_ids, topic_names) and, when ``topic`` has keywords,
    topic_keywords (each topic's keywords joined by ', ')."""
    with_keywords = "keywords" in topic.columns
    t = topic.select("topic_id", "name", *([F.array_join("keywords", ", ").alias("kw")] if with_keywords else []))
    parts = ["i", "topic_id", "name"] + ["kw"] * with_keywords
    ex = (interaction.select("paper_id", F.posexplode_outer("predicted_multi_labels").alias("i", "label"))
          .filter(F.col("i").isNotNull())
          .withColumn("topic_id", X.label_topic_id("label"))
          .filter(F.col("topic_id").isNotNull())
          .join(t, "topic_id"))
    return (ex.groupBy("paper_id")
            .agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("_t"))
            .select("paper_id", F.col("_t.topic_id").alias("topic_ids"), F.col("_t.name").alias("topic_names"),
                    *([F.col("_t.kw").alias("topic_keywords")] if with_keywords else [])))


def with_authors(papers: DataFrame, bridge: DataFrame, authors: DataFrame) -> DataFrame:
    """Author names (and ids, institutions) gathered per paper, by author id."""
    a = (bridge.join(papers.select("paper_id"), "paper_id", "left_semi")
         .join(authors.select("author_id", "name", "institution"), "author_id"))
    g = (a.groupBy("paper_id")
         .agg(F.sort_array(F.collect_list(F.struct("author_id", "name", "institution"))).alias("_a")))
    return (papers.join(g, "paper_id", "left")
            .withColumn("authors", F.coalesce(F.col("_a.name"), F.array().cast("array<string>")))
            .withColumn("author_ids", F.coalesce(F.col("_a.author_id"), F.array().cast("array<bigint>")))
            .withColumn("author_institutions", F.coalesce(F.col("_a.institution"), F.array().cast("array<string>")))
            .drop("_a"))


def paper_cards(papers: DataFrame, bridge: DataFrame, authors: DataFrame, interaction: DataFrame,
                topic: DataFrame, number=1, size: int = 12, topic_names: list[str] | None = None,
                text: str | None = None, author_id=None,
                interaction_of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, PageInfo]:
    """Q1: filter (F7, F5, F6), order (L3), page (L4), then attach authors
    and label topics (J8, J5: papers without interaction get none). Where
    interactions are derived, ``interaction_of`` derives those of the page only."""
    p = papers
    if author_id is not None:
        p = papers_of(p, bridge, author_id)
    if topic_names:
        p = scope_by_topics(p, interaction, topic, topic_names)
    if text:
        p = search_papers(p, bridge, authors, text)
    cut, info = page(p, number, size)
    # at most ``size`` rows, joined twice below: materialise once (checkpoint
    # in the shared folder) instead of re-running the filters and top-k
    cut = cut_lineage(cut)
    detailed = with_authors(cut, bridge, authors)
    mine = (interaction_of(cut.select("paper_id")) if interaction_of
            else interaction.join(cut.select("paper_id"), "paper_id", "left_semi"))
    topics = label_topics(mine, topic)
    out = (detailed.join(topics, "paper_id", "left")
           .select(F.col("paper_id").alias("id"), "title", "year",
                   F.coalesce("topic_ids", F.array().cast("array<int>")).alias("topic_ids"),
                   F.coalesce("topic_names", F.array().cast("array<string>")).alias("topic_names"),
                   F.coalesce("topic_keywords", F.array().cast("array<string>")).alias("topic_keywords"),
                   "authors", "citation_count", "doi"))
    return out, info


def top_topics(dist_rows: DataFrame, topic: DataFrame, key: str, n: int = TOP_TOPICS) -> DataFrame:
    """L5 + J9 on long rows ``(key, topic_id, prob)``: the ``n`` largest (ties
    by index), *then* unknown topics dropped, so fewer than ``n`` may remain.
    A group has at most one row per topic, so the window is bounded."""
    w = Window.partitionBy(key).orderBy(F.desc("prob"), F.asc("topic_id"))
    ranked = dist_rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.join(topic.select("topic_id", F.col("name").alias("subject")), "topic_id")


def distribution_rows(interaction: DataFrame, floor: float = DETAIL_FLOOR) -> DataFrame:
    """F9 (paper): (paper_id, topic_id = index, prob) for prob > floor."""
    return (interaction.select("paper_id", F.posexplode_outer("topic_distribution").alias("topic_id", "prob"))
            .filter(F.col("prob") > floor))


def detail_chart(interaction: DataFrame, topic: DataFrame) -> DataFrame:
    """Q2 chart: (paper_id, rank, topic_id, subject, probability = round 4)."""
    top = top_topics(distribution_rows(interaction), topic, "paper_id")
    return top.select("paper_id", "rank", "topic_id", "subject", X.round4("prob").alias("probability"))


def chart_profile(chart: DataFrame, key: str, floor: float = CHART_FLOOR, n: int = TOP_TOPICS) -> DataFrame:
    """Front-end chart: probabilities above ``floor``, best ``n``, percent =
    round(probability * 100)."""
    w = Window.partitionBy(key).orderBy(F.desc("probability"), F.asc("rank"))
    return (chart.filter(F.col("probability") > floor)
            .withColumn("chart_rank", F.row_number().over(w)).filter(F.col("chart_rank") <= n)
            .withColumn("percent", F.round(F.col("probability") * 100).cast("int")))


def home_first(paper_authors_rows: DataFrame, home: str, bucket: int = 1024) -> DataFrame:
    """Author list with home authors first, order kept inside each part.
    Input (paper_id, pos, author_id, name, institution); adds ``display_pos``
    (ties of position broken by author id).

    Skew-safe rank: rows are ranked inside (paper, part, pos // bucket) -- a
    window bounded by the bucket -- and offset by the counts of the earlier
    buckets of the same part (a prefix sum over one row per bucket) and, for
    the external part, by the paper's number of home authors. A paper with a
    huge author list is thus spread over many tasks."""
    r = (paper_authors_rows
         .withColumn("_ext", (~F.col("institution").eqNullSafe(home)).cast("int"))
         .withColumn("_b", F.floor(F.col("pos") / bucket)))
    in_bucket = Window.partitionBy("paper_id", "_ext", "_b").orderBy(F.asc("pos"), F.asc("author_id"))
    counts = r.groupBy("paper_id", "_ext", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("paper_id", "_ext").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    homes = counts.filter(F.col("_ext") == 0).groupBy("paper_id").agg(F.sum("_n").alias("_homes"))
    ranked = r.withColumn("_r", F.row_number().over(in_bucket) - 1)
    return (ranked.join(offsets.select("paper_id", "_ext", "_b", "_off"), ["paper_id", "_ext", "_b"])
            .join(homes, "paper_id", "left")
            .withColumn("display_pos", (F.col("_r") + F.col("_off")
                                        + F.when(F.col("_ext") == 1, F.coalesce("_homes", F.lit(0)))
                                        .otherwise(F.lit(0))).cast("int"))
            .drop("_ext", "_b", "_r", "_off", "_homes"))


def paper_detail(papers: DataFrame, bridge: DataFrame, authors: DataFrame, interaction: DataFrame,
                 topic: DataFrame, paper_id=None) -> DataFrame:
    """Q2 / F8: detail rows (all papers, or one id: an empty result means not
    found): fields, label topics, authors."""
    p = papers if paper_id is None else papers.filter(F.col("paper_id") == F.lit(paper_id))
    d = with_authors(p, bridge, authors)
    t = label_topics(interaction.join(p.select("paper_id"), "paper_id", "left_semi"), topic)
    return d.join(t, "paper_id", "left")


def chart_arrays(chart: DataFrame, key: str) -> DataFrame:
    """A chart's rows as two arrays per key, best first: at most ``TOP_TOPICS`` each."""
    return (chart.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "subject", "probability"))).alias("_c"))
            .select(key, F.col("_c.subject").alias("chart_subjects"), F.col("_c.probability").alias("chart_probabilities")))


def paper_record(papers: DataFrame, bridge: DataFrame, authors: DataFrame, interaction: DataFrame,
                 topic: DataFrame, paper_id=None) -> DataFrame:
    """Q2, the full record: the paper's own fields, its authors with id and
    institution, its label topics with keywords, and its chart. All papers, or one
    id (an empty result means not found)."""
    p = papers if paper_id is None else papers.filter(F.col("paper_id") == F.lit(paper_id))
    ids = p.select("paper_id")
    mine = interaction if paper_id is None else interaction.join(ids, "paper_id", "left_semi")
    empty, none = F.array().cast("array<string>"), F.array().cast("array<double>")
    out = (with_authors(p, bridge, authors).join(label_topics(mine, topic), "paper_id", "left")
           .join(chart_arrays(detail_chart(mine, topic), "paper_id"), "paper_id", "left"))
    return out.select("paper_id", "doi", "title", "abstract", "year", "venue", "url", "citation_count", "author_ids", "authors",
                      "author_institutions", F.coalesce("topic_ids", F.array().cast("array<int>")).alias("topic_ids"),
                      F.coalesce("topic_names", empty).alias("topic_names"),
                      F.coalesce("topic_keywords", empty).alias("topic_keywords"),
                      F.coalesce("chart_subjects", empty).alias("chart_subjects"),
                      F.coalesce("chart_probabilities", none).alias("chart_probabilities"))
