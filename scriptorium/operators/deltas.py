"""M4, M5 and G1 kept up by signed deltas.

A batch of results replaces papers (by DOI, the last record wins) and adds new ones. The
statistics are sums over papers, so the replaced papers' contributions are taken off,
the new ones' added, and counts that reach zero dropped; no other paper is read. The
contributions come from the same functions as a full rebuild. The stored results are
merged file by file, and one commit carries them and the statistics.

The author dimension is given: a changed roster moves contributions of papers
outside the batch, so it asks for ``rebuild``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import filemerge as FM
from scriptorium.operators import marts as M
from scriptorium.operators.upsert import one_per_key
from scriptorium.session import landed, landing
from scriptorium.sources.martset import MartSet

#: table -> its keys and its sums
SUMS = {
    "faculty_topic_stat": (["faculty", "topic_id"], ["total_papers", "total_citations"]),
    "yearly_topic_stat": (["year", "topic_id"], ["total_papers"]),
    "coauthor_edges": (["author_a", "author_b"], ["weight"]),
}


def contributions(results: DataFrame, authors: DataFrame) -> dict[str, DataFrame]:
    """M4, M5, G1 over some papers."""
    return {"faculty_topic_stat": M.faculty_topic_stat(results, authors), "yearly_topic_stat": M.yearly_topic_stat(results),
            "coauthor_edges": M.coauthor_edges_from_results(results)}


def signed_sum(table: str, parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """The parts' sums by key, each with its sign; rows of no papers are dropped."""
    keys, sums = SUMS[table]
    rows = None
    for sign, df in parts:
        part = df.select(*keys, *[(F.col(c) * sign).alias(c) for c in sums])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).filter(F.col(sums[0]) != 0)


def start(mart_set: MartSet, results: DataFrame, authors: DataFrame) -> int:
    """First load: the last record per DOI, and its statistics. Other tables stay."""
    at = mart_set.latest()
    with landing(mart_set.spark):
        papers = landed(_last(results))
        entries = {"results": FM.first_entry(mart_set, "results", papers, ["doi"])}
        for name, df in contributions(papers, authors).items():
            entries[name] = mart_set.write(df, name)
        return mart_set.publish({**mart_set.manifest(at), **entries}, at)


def _last(results: DataFrame) -> DataFrame:
    return one_per_key(results.filter("doi is not null").withColumn("_at", F.col("seq")), ["doi"], "_at").select(*results.columns)


def apply(mart_set: MartSet, batch: DataFrame, authors: DataFrame) -> int:
    """Merges a batch of results into the stored ones and their statistics, as one
    commit. Applied twice, a batch replaces itself. Returns the commit's number."""
    at = mart_set.latest()
    entries = mart_set.manifest(at)
    with landing(mart_set.spark):
        fresh = landed(_last(batch))
        hit = FM.hits(mart_set, entries["results"], fresh)
        replaced = landed(FM.rows_with_keys(mart_set, entries["results"], fresh, hit))
        new = {"results": FM.merged_in(mart_set, "results", entries, fresh, [c for c in fresh.columns if c != "doi"], hit)}
        added, gone = contributions(fresh, authors), contributions(replaced, authors)
        for name in SUMS:
            old = mart_set.open(entries[name])
            new[name] = mart_set.write(signed_sum(name, [(1, old), (1, added[name]), (-1, gone[name])]), name)
        return mart_set.publish({**entries, **new}, at)


def rebuild(mart_set: MartSet, authors: DataFrame) -> int:
    """The statistics of all stored results anew, as one commit."""
    at = mart_set.latest()
    entries = mart_set.manifest(at)
    tables = contributions(mart_set.open(entries["results"]), authors)
    return mart_set.publish({**entries, **{name: mart_set.write(df, name) for name, df in tables.items()}}, at)
