"""Co-authorship network (G1-G3) with its scope and counts (L1, F5, J10-J12,
A3-A5, X9).

Pairs are formed on the *distinct* paper-author bridge by a self equi-join; the
per-pair weight is a partial aggregate. A paper with n authors yields n(n-1)/2
pairs; that output is the edge table itself, so it is not capped. A paper's
authors are dealt into hash blocks of about ``PAIR_BLOCK`` and the join key is
(paper, block, block), so no task makes more than about ``PAIR_BLOCK`` squared
pairs of one key, however long an author list is. The number of tasks follows the
bridge's rows and, of edges, the pairs, so a task's memory doesn't grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.session import cut_lineage, dealt

EXTERNAL_GROUP = "External Partner"
EXTERNAL = "External"
PAIR_BLOCK = 512          # authors of a paper joined with each other under one key, about


def author_pairs(bridge: DataFrame, paper_col: str = "paper_id", author_col: str = "author_id", rows_in: int = 0) -> DataFrame:
    """Unordered author pairs (a < b) per paper of a distinct bridge, of ``rows_in`` rows if given.

    Every unordered pair of a paper's blocks (i <= j) is one join key: block i on
    the left, block j on the right."""
    rows = dealt(bridge.select(F.col(paper_col).alias("_p"), F.col(author_col).alias("_a")), rows_in, "_p")
    sizes = rows.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("_n")).filter("_n > 0")
    blocks = rows.join(sizes, "_p").withColumn("_b", F.pmod(F.xxhash64("_a"), F.col("_n")).cast("int"))
    # a paper of one block pairs its authors in one row; only larger papers meet block by block
    listed = blocks.filter("_n = 1").groupBy("_p").agg(F.sort_array(F.collect_list("_a")).alias("_l"))
    begun = listed.select("_p", "_l", F.posexplode("_l").alias("_i", "a"))
    paired = begun.select("_p", "a", F.explode(F.slice("_l", F.col("_i") + 2, F.size("_l"))).alias("b")).filter("a < b")
    blocks = blocks.filter("_n > 1")
    left = blocks.select(F.col("_p"), F.col("_a").alias("x"), F.col("_b").alias("_i"),
                        F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_j"))
    right = blocks.select(F.col("_p"), F.col("_a").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"),
                         F.col("_b").alias("_j"))
    key = ["_p", "_i", "_j"]
    large = (dealt(left, rows_in, *key).join(dealt(right, rows_in, *key), key).filter((F.col("_i") < F.col("_j")) | (F.col("x") < F.col("y")))
            .select("_p", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return paired.unionByName(large).withColumnRenamed("_p", paper_col)


def pair_counts(bridge: DataFrame, paper_col: str = "paper_id") -> tuple[int, int]:
    """Rows of a distinct bridge and the author pairs of its papers: a few papers of many authors may hold most pairs."""
    n = F.count(F.lit(1))
    sizes = bridge.groupBy(paper_col).agg(n.alias("n"))
    rows, pairs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")), F.lit(0))).first()
    return rows, int(pairs) // 2


PAIRS_PER_ROW = 16        # pairs that a row of a task's blocks makes, where tasks follow the pairs


def coauthor_edges(bridge: DataFrame, paper_col: str = "paper_id", author_col: str = "author_id") -> DataFrame:
    """G1: (author_a, author_b, weight) with author_a < author_b and weight =
    number of shared papers."""
    # stored, since its rows must be counted
    rows = cut_lineage(bridge.select(paper_col, author_col).distinct())
    n, pairs = pair_counts(rows, paper_col)
    return (dealt(author_pairs(rows, paper_col, author_col, max(n, pairs // PAIRS_PER_ROW)), max(2 * n, pairs), "a", "b")
            .groupBy(F.col("a").alias("author_a"), F.col("b").alias("author_b"))
            .agg(F.count(F.lit(1)).alias("weight")))


def scope_by_topics(papers: DataFrame, interaction: DataFrame, topic: DataFrame,
                    names: list[str] | None) -> DataFrame:
    """papers whose primary topic name is one of ``names`` or one of whose
    multi-labels contains a name, case-insensitively (per label). Each paper
    once: the test is a row predicate over a one-row-per-paper join.

    ``interaction(paper_id, primary_topic_id, predicted_multi_labels)``;
    ``topic(topic_id, name)`` is a bounded dimension."""
    if not names:
        return papers
    up = [n.upper() for n in names]
    info = (interaction.join(topic.select(F.col("topic_id").alias("primary_topic_id"),
                                                      F.col("name").alias("_primary_name")),
                             "primary_topic_id", "left")
            .select("paper_id", "_primary_name", "predicted_multi_labels"))
    name_hit = F.col("_primary_name").isin(names)
    label_hit = F.exists(F.coalesce("predicted_multi_labels", F.array().cast("array<string>")),
                         lambda l: F.exists(F.array(*[F.lit(u) for u in up]),
                                            lambda u: F.contains(F.upper(l), u)))
    hits = info.filter(name_hit | label_hit).select("paper_id")
    return papers.join(hits, "paper_id", "left_semi")


def newest(papers: DataFrame, limit: int | None = 200) -> DataFrame:
    """L1: the ``limit`` newest papers, year descending with nulls first (as a
    PostgreSQL descending sort), ties by id. Plans as TakeOrderedAndProject. None:
    all papers, unordered."""
    if limit is None:
        return papers
    return papers.orderBy(F.desc_nulls_first("year"), F.asc("paper_id")).limit(limit)


def authors_in(scope: DataFrame, bridge: DataFrame, authors: DataFrame) -> DataFrame:
    """J10 + A3: authors having a paper in the scope, with
    ``relevant_paper_count`` = their distinct papers in the scope."""
    sb = bridge.join(scope.select("paper_id"), "paper_id", "left_semi")
    counts = (sb.select("author_id", "paper_id").distinct()
              .groupBy("author_id").agg(F.count(F.lit(1)).alias("relevant_paper_count")))
    return authors.join(counts, "author_id")


def home_collaborators(pairs: DataFrame, is_home: DataFrame) -> DataFrame:
    """A4: distinct home collaborators per external author, from mixed pairs.
    ``is_home(author_id, home BOOLEAN)``."""
    h = is_home.select("author_id", "home")
    p = (pairs.join(h.select(F.col("author_id").alias("a"), F.col("home").alias("ha")), "a")
         .join(h.select(F.col("author_id").alias("b"), F.col("home").alias("hb")), "b"))
    mixed = p.filter(F.col("ha") != F.col("hb")).select(
        F.when(F.col("ha"), F.col("b")).otherwise(F.col("a")).alias("author_id"),
        F.when(F.col("ha"), F.col("a")).otherwise(F.col("b")).alias("partner"))
    return mixed.groupBy("author_id").agg(F.count_distinct("partner").alias("home_collaborators"))


def author_network(papers: DataFrame, bridge: DataFrame, authors: DataFrame, home: str,
                   limit: int | None = 200, topic_names: list[str] | None = None,
                   interaction: DataFrame | None = None, topic: DataFrame | None = None,
                   min_home_collaborators: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scoped author network -> (nodes, links, totals).

    Scope = the ``limit`` newest papers (optionally in the topic scope), or with
    None all of them; it is
    deterministic (id tie-break), so every use sees the same papers. Nodes: all
    home authors of the scope, plus external authors with at least
    ``min_home_collaborators`` distinct home co-authors in the scope. Links:
    author pairs in the scope, weight = shared scope papers, both ends kept.
    Totals: external authors found and qualified.
    """
    if topic_names:
        papers = scope_by_topics(papers, interaction, topic, topic_names)
    scope = newest(papers.select("paper_id", "year"), limit).select("paper_id")
    # The scoped bridge and its authors are used by every later step:
    # materialise each once in the shared checkpoint folder (reliable, survives
    # executor loss), so the large bridge and author tables are scanned once,
    # not once per reference.
    whole = bridge.select("paper_id", "author_id").distinct()
    sb = cut_lineage(whole if limit is None and not topic_names else whole.join(scope, "paper_id", "left_semi"))
    involved = cut_lineage(authors_in(scope, sb, authors))
    is_home = involved.select("author_id", F.col("institution").eqNullSafe(home).alias("home"))
    n = sb.count() if limit is None else 0
    pairs = author_pairs(sb, rows_in=n)
    links_all = dealt(pairs, 2 * n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    collab = home_collaborators(pairs, is_home)

    home_nodes = involved.filter(F.col("institution").eqNullSafe(home)).select(
        F.col("author_id"), "name", X.node_size("relevant_paper_count").alias("val"),
        F.lit(home).alias("group"), "institution", "faculty")
    externals = involved.filter(~F.col("institution").eqNullSafe(home)).join(collab, "author_id", "left")
    qualified = externals.filter(F.coalesce("home_collaborators", F.lit(0)) >= min_home_collaborators)
    ext_nodes = qualified.select(
        F.col("author_id"), "name", X.node_size("relevant_paper_count").alias("val"),
        F.lit(EXTERNAL_GROUP).alias("group"),
        F.when(F.coalesce("institution", F.lit("")) != "", F.col("institution"))
         .otherwise(F.lit(EXTERNAL)).alias("institution"),
        F.lit(None).cast("string").alias("faculty"))
    node_ids = home_nodes.select("author_id").unionByName(ext_nodes.select("author_id"))
    nodes = home_nodes.unionByName(ext_nodes).withColumn("id", F.col("author_id").cast("string"))

    links = (links_all
             .join(node_ids.withColumnRenamed("author_id", "a"), "a", "left_semi")
             .join(node_ids.withColumnRenamed("author_id", "b"), "b", "left_semi")
             .select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"),
                     "weight"))
    totals = externals.agg(
        F.count(F.lit(1)).alias("total_external_found"),
        F.count_if(F.coalesce("home_collaborators", F.lit(0)) >= min_home_collaborators)
         .alias("qualified_external_count"))
    return nodes.select("id", "name", "val", "group", "institution", "faculty"), links, totals


def edge_class(links: DataFrame, nodes: DataFrame, home: str) -> DataFrame:
    """A link is 'internal' when both ends are home nodes, else 'external'."""
    g = nodes.select("id", (F.col("group") == home).alias("_h"))
    return (links.join(g.select(F.col("id").alias("source"), F.col("_h").alias("_hs")), "source", "left")
            .join(g.select(F.col("id").alias("target"), F.col("_h").alias("_ht")), "target", "left")
            .select("source", "target", "weight",
                    F.when(F.coalesce("_hs", F.lit(False)) & F.coalesce("_ht", F.lit(False)), F.lit("internal"))
                     .otherwise(F.lit("external")).alias("edge_class")))
