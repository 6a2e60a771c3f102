"""The whole batch run as one composition of DataFrames: landed works and document
vectors in, marts out.

raw works -> S9, F1 clean -> D1 dedupe with merged authors -> F2 model-ready ->
T4 outlier reassignment -> T1/T2 keywords of the topics *after* the move -> J13
labels -> T7 enrichment -> M1-M7 and G1 -> S4 one commit. Clean records, survivors and
results are read by several later steps, so each is materialised once in the shared
checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import dedupe as DD
from scriptorium.operators import marts as M
from scriptorium.operators import topics as T
from scriptorium.session import cut_lineage
from scriptorium.sources import ingest as I
from scriptorium.sources.martset import MartSet
from scriptorium.sources.zones import stamp


@dataclass(frozen=True)
class Marts:
    """The load tables of one run."""

    topics: DataFrame
    papers: DataFrame
    rejected: DataFrame
    authors: DataFrame
    paper_authors: DataFrame
    interactions: DataFrame
    faculty_topic_stat: DataFrame
    yearly_topic_stat: DataFrame
    coauthor_edges: DataFrame


def results(raw: DataFrame, vectors: DataFrame, threshold: float = T.OUTLIER_THRESHOLD) -> DataFrame:
    """The load input of raw works (with ``seq``) and vectors ``(vec_id = seq,
    embedding, topic_id)``; a paper without a vector is an outlier."""
    clean = cut_lineage(I.clean_papers(I.works_from_raw(raw)))
    papers = cut_lineage(T.topic_docs(DD.dedupe_papers(clean, with_authors=True)))
    moved = T.reassign_outliers(vectors, threshold).select(F.col("vec_id").alias("seq"), F.col("new_topic_id"))
    near = T.centroid_distribution(vectors).select(F.col("vec_id").alias("seq"), "topic_distribution")
    assign = cut_lineage(
        papers.select("seq").join(moved, "seq", "left").join(near, "seq", "left")
        .select("seq", F.coalesce("new_topic_id", F.lit(X.OUTLIER_TOPIC_ID)).alias("cluster_id"),
                F.coalesce("topic_distribution", F.array().cast("array<double>")).alias("topic_distribution")))
    docs = papers.select("seq", "doc").join(assign.select("seq", F.col("cluster_id").alias("topic_id")), "seq")
    ids = assign.filter(F.col("cluster_id") != X.OUTLIER_TOPIC_ID).select(F.col("cluster_id").alias("topic_id")).distinct()
    keywords = T.topic_keywords(T.topic_terms(docs, text_col="doc", tasks=T.text_tasks(papers, "doc")), ids)
    labels = cut_lineage(T.topic_labels(keywords))
    return cut_lineage(T.enrich(papers.drop("doc"), assign, labels))


def marts(loaded: DataFrame, roster: DataFrame, home: str) -> Marts:
    """M1-M7 and G1 over the load input."""
    authors = M.author_dim(loaded, roster, home)
    topics = M.topic_dim(loaded)
    return Marts(topics=topics, papers=M.paper_dim(loaded), rejected=M.rejected_papers(loaded), authors=authors,
                 paper_authors=M.paper_authors(loaded), interactions=M.interactions(loaded, topics),
                 faculty_topic_stat=M.faculty_topic_stat(loaded, authors),
                 yearly_topic_stat=M.yearly_topic_stat(loaded), coauthor_edges=M.coauthor_edges_from_results(loaded))


def refresh(marts_: Marts, mart_set: MartSet) -> int:
    """All tables of a run as one commit; the faculty statistics carry their load
    time. Returns the commit's number. A run that fails leaves the last commit as it was."""
    tables = {f.name: getattr(marts_, f.name) for f in fields(marts_)}
    tables["faculty_topic_stat"] = stamp(tables["faculty_topic_stat"])
    return mart_set.refresh(tables)


def run(raw: DataFrame, vectors: DataFrame, roster: DataFrame, home: str, mart_set: MartSet) -> int:
    """The whole run: raw works, vectors and the roster in, the tables of ``mart_set`` out."""
    return refresh(marts(results(raw, vectors), roster, home), mart_set)
