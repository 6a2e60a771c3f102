"""Bindings of the scholarly tables to the shared test tables.

Suppliers stand for authors, nations of region 1 for home faculties, orders
for papers, line items for authorships, part brands for topics, documents for
raw paper text and embeddings for document vectors. Every binding is a plain
DataFrame plan over the parquet files, so its work grows with the data.

Broadcast policy: only ``nation`` (25 rows by construction) carries an explicit
``broadcast``. Everything else, the topic dimension included, is left to AQE, which
broadcasts a side only after measuring it against
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.sources.tables import by_key, read

# Fixed values of the bindings.
HOME_INSTITUTION = "Home University"
EXTERNAL_INSTITUTION = "External"
HOME_REGION = 1
OUTLIER_SHARE = 0.3      # a paper whose best share is below this is an outlier
TOP_TERMS = 15


def authors(spark: SparkSession, d: str) -> DataFrame:
    """Author table: id, name, faculty (home only), institution (home, external
    or null for every fifth non-home supplier)."""
    s = read(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    home = F.col("n_regionkey") == HOME_REGION
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias("author_id"),
                    F.col("s_name").alias("name"),
                    F.when(home, F.col("n_name")).alias("faculty"),
                    F.when(home, F.lit(HOME_INSTITUTION))
                     .when(F.col("s_suppkey") % 5 == 0, F.lit(None).cast("string"))
                     .otherwise(F.lit(EXTERNAL_INSTITUTION)).alias("institution")))


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Paper table: id, doi, title, year (null for every 97th), citations."""
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("paper_id"),
        F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"),
        F.concat(F.col("o_orderpriority"), F.lit(" order "), k.cast("string")).alias("title"),
        F.when(k % 97 == 0, F.lit(None).cast("int"))
         .otherwise(F.year("o_orderdate").cast("int")).alias("year"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citation_count"),
    )


def authorships(spark: SparkSession, d: str) -> DataFrame:
    """Raw authorship rows (paper, author, position); pairs may repeat."""
    return read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber").select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"),
        F.col("l_linenumber").alias("pos"))


def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paper-author bridge (the many-to-many table)."""
    return authorships(spark, d).select("paper_id", "author_id").distinct()


def topic_shares(spark: SparkSession, d: str, papers: DataFrame | None = None) -> DataFrame:
    """(paper, topic, share): quantity share of each brand in an order. ``papers``
    (paper_id) limits the line items before anything is computed from them.

    A paper has at most one row a topic, so the per-paper window is bounded
    whatever the skew of the line items."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    if papers is not None:
        li = li.join(papers.select(F.col("paper_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    p = read(spark, d, "part", "p_partkey", "p_brand")
    q = (li.join(p, li.l_partkey == p.p_partkey)
         .groupBy(F.col("l_orderkey").alias("paper_id"),
                  _topic_of("p_brand").alias("topic_id"))
         .agg(F.sum("l_quantity").alias("q")))
    total = F.sum("q").over(_by_paper())
    return q.select("paper_id", "topic_id", (F.col("q") / total).alias("share"))


def _topic_of(brand: str):
    """Topic id of a part brand: Brand#1 is topic 0."""
    return F.substring(brand, 7, 10).cast("int") - 1


def _by_paper():
    from pyspark.sql import Window
    return Window.partitionBy("paper_id")


def paper_topics(spark: SparkSession, d: str, papers: DataFrame | None = None) -> DataFrame:
    """One row per paper with shares: primary topic (outlier -1 when the best
    share is below OUTLIER_SHARE; ties to the lower topic id), its share, and the
    dense ``topic_distribution``, one slot a topic id up to the largest there is.

    One aggregation per paper: the best (share, -topic) struct and the sparse
    shares collected into a map, expanded row-locally to the dense array."""
    s = topic_shares(spark, d, papers)
    g = s.groupBy("paper_id").agg(
        F.max(F.struct(F.col("share"), (-F.col("topic_id")).alias("neg_topic"))).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("topic_id", "share"))).alias("m"),
    )
    best_topic = -F.col("best.neg_topic")
    last = read(spark, d, "part", "p_brand").agg(F.max(_topic_of("p_brand"))).scalar()
    return g.withColumn("_last", last).select(
        "paper_id",
        F.when(F.col("best.share") < OUTLIER_SHARE, F.lit(-1)).otherwise(best_topic).alias("topic_id"),
        F.col("best.share").alias("share"),
        F.transform(F.sequence(F.lit(0), F.col("_last")),
                    lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))).alias("topic_distribution"),
    )


def topic_names(spark: SparkSession, d: str) -> DataFrame:
    """topic_id and name of every topic, the outlier included; no keywords are ranked."""
    names = read(spark, d, "part", "p_brand").distinct().select(_topic_of("p_brand").alias("topic_id"),
                                                                F.col("p_brand").alias("name"))
    return names.unionByName(spark.range(1).select(F.lit(-1).alias("topic_id"), F.lit(X.OUTLIER_LABEL).alias("name")))


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic dimension: topic_id, name (``Brand#{t+1}``), keywords (the 15 most
    frequent words of the brand's part names, ties by word); plus the outlier
    topic with no keywords. One row per brand, so it is a bounded dimension."""
    from scriptorium.operators.topics import top_terms
    p = read(spark, d, "part", "p_brand", "p_name")
    words = (p.select("p_brand", F.explode(F.split("p_name", " ")).alias("term"))
             .groupBy("p_brand", "term").agg(F.count(F.lit(1)).cast("double").alias("score")))
    kw = top_terms(words, "p_brand", n=TOP_TERMS)
    dim = kw.select(_topic_of("p_brand").alias("topic_id"),
                    F.col("p_brand").alias("name"), "keywords")
    outlier = spark.range(1).select(F.lit(-1).alias("topic_id"), F.lit(X.OUTLIER_LABEL).alias("name"),
                                    F.array().cast("array<string>").alias("keywords"))
    return dim.unionByName(outlier)


def interactions(spark: SparkSession, d: str, papers: DataFrame | None = None) -> DataFrame:
    """Paper-topic interaction: primary topic, distribution and multi-labels
    (T6 with the topic names of ``topics``), of all papers or of ``papers``."""
    from scriptorium.operators.topics import multi_labels
    pt = paper_topics(spark, d, papers)
    labelled = multi_labels(pt, topic_names(spark, d), id_col="topic_id", dist_col="topic_distribution")
    return labelled.select("paper_id", F.col("topic_id").alias("primary_topic_id"),
                           "topic_distribution", "predicted_multi_labels")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Clean-zone paper records from documents: every third has no DOI, every
    fourth an empty abstract; title = first line."""
    t = read(spark, d, "documents", "doc_id", "text", "source", "lang")
    k = F.col("doc_id")
    return t.select(
        k.alias("seq"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.md5("text")).alias("doi"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("abstract"),
        "source", "lang",
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Document vectors with a label and an assigned topic (every tenth is an
    outlier)."""
    e = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", "embedding", "label",
                    F.when(F.col("vec_id") % 10 == 0, F.lit(-1)).otherwise(F.col("label")).alias("topic_id"))


def roster(spark: SparkSession, d: str) -> DataFrame:
    """Author roster (staff list): home authors, every second name upper-cased
    so that faculty lookup by lower(name) is exercised."""
    a = authors(spark, d).filter(F.col("faculty").isNotNull())
    return a.select(F.col("author_id").alias("seq"),
                    F.when(F.col("author_id") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
                    "institution", "faculty", F.lit(None).cast("string").alias("email"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Topic-step output records (the load input), one per paper: authors in
    line order (repeats kept; every seventh supplier has no external id), topic
    id, label, multi-labels, keywords and distribution; papers without line
    items have no authors and no topic."""
    li = authorships(spark, d)
    s = read(spark, d, "supplier", "s_suppkey", "s_name")
    auth = (li.join(s, li.author_id == s.s_suppkey)
            .groupBy("paper_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                "pos",
                F.col("s_name").alias("name"),
                F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("A"), F.col("s_suppkey").cast("string"))).alias("openalex_id"),
            ))).alias("_a"))
            .select("paper_id", F.transform("_a", lambda x: F.struct(x["name"].alias("name"),
                                                                      x["openalex_id"].alias("openalex_id")))
                    .alias("authors_struct")))
    inter = interactions(spark, d)
    top = topics(spark, d)
    names = top.select("topic_id", "name", "keywords")
    p = papers(spark, d)
    return (p.join(auth, "paper_id", "left")
            .join(inter, "paper_id", "left")
            .join(names, inter.primary_topic_id == names.topic_id, "left")
            .select(F.col("paper_id").alias("seq"), "doi", "title", F.lit("").alias("abstract"),
                    F.coalesce("authors_struct", F.array().cast("array<struct<name:string,openalex_id:string>>"))
                     .alias("authors_struct"),
                    "year", F.lit(None).cast("string").alias("venue"), "citation_count",
                    X.authors_text(F.coalesce("authors_struct",
                                              F.array().cast("array<struct<name:string,openalex_id:string>>")))
                     .alias("authors_text"),
                    F.col("primary_topic_id").alias("cluster_id"),
                    F.when(F.col("primary_topic_id").isNotNull(), X.cluster_label("primary_topic_id", "name"))
                     .alias("cluster_label"),
                    "predicted_multi_labels",
                    F.when(F.col("primary_topic_id") == -1, F.array().cast("array<string>"))
                     .otherwise(F.col("keywords")).alias("topic_keywords"),
                    "topic_distribution"))


def _doc_authors(spark: SparkSession, d: str, raw: bool) -> DataFrame:
    """Authors of a document: the line items of the order with the document's
    id, in line order. Every sixth supplier's display name carries non-ASCII
    letters, every seventh has no external id, even lines upper-case the name
    and every eleventh raw display name is empty."""
    ids = read(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "paper_id")
    li = authorships(spark, d).join(ids, "paper_id", "left_semi")
    s = read(spark, d, "supplier", "s_suppkey", "s_name")
    k = F.col("s_suppkey")
    disp = (F.when(k % 11 == 0, F.lit(""))
            .when(k % 6 == 0, F.concat(F.lit("José "), F.col("s_name")))
            .when(F.col("pos") % 2 == 0, F.upper("s_name"))
            .otherwise(F.col("s_name")))
    oid = F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("A"), k.cast("string")))
    rows = li.join(s, li.author_id == s.s_suppkey).select("paper_id", "pos", disp.alias("name"), oid.alias("id"))
    if raw:
        item = F.struct(F.struct(F.col("id").alias("id"), F.col("name").alias("display_name")).alias("author"))
    else:
        item = F.struct(X.clean_text("name").alias("name"), F.col("id").alias("openalex_id"))
    return (rows.filter(F.lit(raw) | (F.col("name") != ""))
            .groupBy("paper_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("x")))).alias("_a"))
            .select(F.col("paper_id").alias("doc_id"), F.col("_a.x").alias("authors")))


def _indexed(texts: str) -> Column:
    """word -> sorted positions over the blank-separated tokens of the array ``texts`` (null when it is
    empty), row by row: a token never becomes a row."""
    pairs = F.flatten(F.transform(texts, lambda t: F.transform(F.split(t, " "), lambda w, p: F.struct(w.alias("w"), p.alias("p")))))
    return F.when(F.size(texts) > 0, F.map_from_entries(X.runs(pairs)))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, abstract_inverted_index): word -> positions of the document's
    blank-separated tokens. Whole texts are shuffled once, by document; the index
    is made row by row (a document is one row, bounded by its text)."""
    t = by_key(read(spark, d, "documents", "doc_id", "text").filter("text is not null"), "doc_id")
    texts = t.groupBy("doc_id").agg(F.collect_list("text").alias("_texts"))
    return texts.select("doc_id", _indexed("_texts").alias("abstract_inverted_index"))


def raw_works(spark: SparkSession, d: str) -> DataFrame:
    """Landed work items (the works API shape) from documents: a DOI URL for
    two thirds, title = first line, authorships from line items, year, venue,
    inverted-index abstract (null for every fourth), citations.

    A document's index is made beside its row, from all texts of its id, so neither
    an index nor a second copy of the text is shuffled or joined."""
    from pyspark.sql import Window
    t = by_key(read(spark, d, "documents", "doc_id", "text", "source", "n_chars"), "doc_id")
    k = F.col("doc_id")
    a = _doc_authors(spark, d, raw=True)
    # rows without an id have no index; gathering their texts would give each of them all
    own = F.collect_list(F.when(k % 4 != 0, F.col("text"))).over(Window.partitionBy("doc_id"))
    rows = t.join(a, "doc_id", "left").withColumn("_texts", own)
    doi = F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://doi.org/"), F.md5("text")))
    return (rows.select(
                    k.alias("seq"), doi.alias("doi"),
                    F.when(k % 17 == 0, F.lit(None).cast("string"))
                     .otherwise(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("title"),
                    F.coalesce("authors", F.array().cast(
                        "array<struct<author:struct<id:string,display_name:string>>>")).alias("authorships"),
                    (F.lit(2000) + k % 25).cast("int").alias("publication_year"),
                    F.col("source").alias("venue_name"),
                    _indexed("_texts").alias("abstract_inverted_index"),
                    (F.col("n_chars") % 100).cast("int").alias("cited_by_count")))


def clean_docs(spark: SparkSession, d: str) -> DataFrame:
    """Clean records for dedupe: ``docs`` plus cleaned authors from line items."""
    a = _doc_authors(spark, d, raw=False)
    dd = docs(spark, d)
    return (dd.join(a, dd.seq == a.doc_id, "left")
            .select("seq", "doi", "title", "abstract",
                    F.coalesce("authors", F.array().cast("array<struct<name:string,openalex_id:string>>"))
                     .alias("authors_struct")))


def staff(spark: SparkSession, d: str) -> DataFrame:
    """Staff rows of the staff API shape from suppliers of home nations:
    first/last names from the supplier name (every eleventh last name
    missing), padded e-mails (every third missing), own faculty (every fourth
    empty) and the requested faculty."""
    s = read(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read(spark, d, "nation", "n_nationkey", "n_name")
    k = F.col("s_suppkey")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .select(k.alias("seq"),
                    F.concat(F.lit(" "), F.split_part("s_name", F.lit("#"), F.lit(1))).alias("First_Name_En"),
                    F.when(k % 11 == 0, F.lit(None).cast("string"))
                     .otherwise(F.split_part("s_name", F.lit("#"), F.lit(2))).alias("Last_Name_En"),
                    F.when(k % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit(" s"), k.cast("string"), F.lit("@example.org "))).alias("Email"),
                    F.when(k % 4 == 0, F.lit("")).otherwise(F.col("n_name")).alias("Faculty_Name_En"),
                    F.lit("Requested Faculty").alias("faculty_en")))
