"""Registered queries over stored, incrementally kept tables, and the density clusters.

Each one writes its tables to a folder of its own in the shared checkpoint folder, works on
them as a user would (commits, merges, batches) and returns what they hold at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import registry as R
from scriptorium.functions import text as X
from scriptorium.operators import arrivals as A
from scriptorium.operators import deltas as DL
from scriptorium.operators import density as DN
from scriptorium.operators import filemerge as FM
from scriptorium.operators import marts as M
from scriptorium.operators import namesearch as NS
from scriptorium.operators import network as G
from scriptorium.operators import textindex as TI
from scriptorium.operators import topicmerge as TM
from scriptorium.operators import topics as T
from scriptorium.oracle_sql import HOME, with_views
from scriptorium.plans import batch as BATCH
from scriptorium.plans import pageindex as PI
from scriptorium.plans import papers as P
from scriptorium.registry import register
from scriptorium.session import cut_lineage, dealt, landing
from scriptorium.sources import bindings as B
from scriptorium.sources.martset import MartSet


#: Queries whose result is read back from a checkpoint: their last plan says nothing of their work.
STORED = {"upsert_files", "dedupe_papers_batches", "stat_deltas", "batch_faculty_topic_stat", "paper_search_indexed",
          "paper_search_author_indexed", "paper_cards_last_indexed", "density_topics", "reduced_topics"}


def _stored(spark: SparkSession, work: Callable[[MartSet], DataFrame]) -> DataFrame:
    """The rows that ``work`` leaves in a set of tables, which is deleted afterwards."""
    with landing(spark) as folder:
        return cut_lineage(work(MartSet(spark, f"{folder}/marts")))


# --------------------------------------------------------------- S5 on files

@register("upsert_files", with_views(R.UPSERT_SQL, "f_paper"))
def q_upsert_files(spark, d):
    base, updates = R.upsert_inputs(spark, d)

    def work(marts):
        FM.create(marts, "papers", base, ["paper_id"])
        FM.merge(marts, "papers", updates, ["title", "citation_count"], order="seq")
        return marts.read("papers")

    return _stored(spark, work)


# ------------------------------------------------------- dedupe, three batches

@register("dedupe_papers_batches", R.SQL["dedupe_papers"])
def q_dedupe_papers_batches(spark, d):
    records = B.clean_docs(spark, d).select("seq", "doi", "title", "abstract")
    ends = records.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()

    def work(marts):
        registry, third = A.PaperRegistry(marts), (ends["hi"] - ends["lo"]) // 3 + 1
        for i in range(3):
            lo = ends["lo"] + i * third
            registry.arrive(records.filter((F.col("seq") >= lo) & (F.col("seq") < lo + third)))
        return registry.survivors().select("group_kind", "group_key", "group_size", "seq", "doi", "title", "abstract")

    return _stored(spark, work)


# ----------------------------------------------- statistics after a correction

_DELTA_SQL = {
    "results": R.RESULTS_SQL,
    "ad": R.AUTHOR_DIM_SQL,
    "r2": """select seq, doi, case when seq % 3 = 0 then list_filter(authors_struct, lambda a: a.openalex_id is not null)
                         else authors_struct end as authors_struct,
                    case when seq % 3 = 0 then year + 1 else year end as year,
                    case when seq % 3 = 0 then citation_count + 5 else citation_count end as citation_count,
                    case when seq % 6 = 0 then -1 else coalesce(cluster_id, -1) end as topic_id from results""",
    "a2": """select distinct seq, coalesce(nullif(a.openalex_id, ''), lower(a.name)) as author_key
             from (select seq, unnest(authors_struct) as a from r2) u""",
}


@register("stat_deltas", with_views("""
    select 'faculty_topic_stat' as stat, faculty as a, cast(topic_id as varchar) as b, count(*) as n,
           cast(sum(coalesce(citation_count, 0)) as bigint) as citations
    from (select distinct seq, faculty from a2 join ad using (author_key) where coalesce(faculty, '') <> '') f join r2 using (seq)
    group by 2, 3
    union all
    select 'yearly_topic_stat', cast(year as varchar), cast(topic_id as varchar), count(*), null
    from r2 where year is not null and year <> 0 group by 2, 3
    union all
    select 'coauthor_edges', x.author_key, y.author_key, count(*), null
    from a2 x join a2 y on x.seq = y.seq and x.author_key < y.author_key group by 2, 3""", *R.RESULTS_VIEWS, extra=_DELTA_SQL))
def q_stat_deltas(spark, d):
    """All papers loaded, then a batch that corrects every third one."""
    results = cut_lineage(B.results(spark, d).select("seq", "doi", "authors_struct", "year", "citation_count", "cluster_id", "cluster_label"))
    authors = cut_lineage(M.author_dim(results, B.roster(spark, d), HOME).select("author_key", "faculty"))
    batch = results.filter(F.col("seq") % 3 == 0).select(
        "seq", "doi", F.filter("authors_struct", lambda a: a["openalex_id"].isNotNull()).alias("authors_struct"),
        (F.col("year") + 1).alias("year"), (F.col("citation_count") + 5).alias("citation_count"),
        F.when(F.col("seq") % 6 == 0, F.lit(-1)).otherwise(F.col("cluster_id")).alias("cluster_id"), "cluster_label")

    def work(marts):
        DL.start(marts, results, authors)
        DL.apply(marts, batch, authors)
        out = None
        for name, (keys, sums) in DL.SUMS.items():
            total = F.col(sums[1]) if len(sums) > 1 else F.lit(None).cast("long")
            part = marts.read(name).select(F.lit(name).alias("stat"), F.col(keys[0]).cast("string").alias("a"),
                                           F.col(keys[1]).cast("string").alias("b"), F.col(sums[0]).alias("n"), total.alias("citations"))
            out = part if out is None else out.unionByName(part)
        return out

    return _stored(spark, work)


# --------------------------------------------------------- the batch run, landed

@register("batch_faculty_topic_stat", R.batch_sql(f"""
    select f.faculty, a.topic_id, count(*) as total_papers, cast(sum(coalesce(p.citation_count, 0)) as bigint) as total_citations
    from (select distinct x.seq, r.faculty from bas x
          join (select author_key, arg_min(name, seq * 1e9 + o) as name from bas group by 1) n using (author_key)
          join (select lower(name) as name_key, arg_max(faculty, seq) as faculty from ({R.ROSTER_SQL}) r group by 1) r
               on lower(n.name) = r.name_key
          where coalesce(r.faculty, '') <> '') f
    join bp p using (seq) join ba a using (seq) group by 1, 2"""))
def q_batch_faculty_topic_stat(spark, d):
    """Read back from the committed set."""
    def work(marts):
        BATCH.run(B.raw_works(spark, d), B.vectors(spark, d), B.roster(spark, d), HOME, marts)
        return marts.read("faculty_topic_stat").drop("last_updated")

    return _stored(spark, work)


# ------------------------------------------------------------ unscoped, by text

@register("home_collaborators_all", with_views("""
    select e.author_id, count(distinct h.author_id) as home_collaborators
    from f_paper_author x join f_author e using (author_id)
    join f_paper_author y on y.paper_id = x.paper_id join f_author h on h.author_id = y.author_id
    where e.institution is distinct from 'Home University' and h.institution is not distinct from 'Home University'
    group by 1""", "f_paper_author", "f_author"))
def q_home_collaborators_all(spark, d):
    authors = B.authors(spark, d)
    home = authors.select("author_id", F.col("institution").eqNullSafe(HOME).alias("home"))
    return G.home_collaborators(G.author_pairs(B.paper_authors(spark, d)), home)


@register("scope_by_topic_text", R.SQL["scope_by_topics"])
def q_scope_by_topic_text(spark, d):
    """F5 with its names as the text a caller sends: split at commas, trimmed, empty ones dropped."""
    names = spark.range(1).select(X.split_names(F.lit(" Brand#1,, brand#7 ,")).alias("names")).first()["names"]
    return G.scope_by_topics(B.papers(spark, d), B.interactions(spark, d), B.topic_names(spark, d), names).select("paper_id", "title")


def _indexed_search(text):
    def query(spark, d):
        papers, authors = B.papers(spark, d).select("paper_id", "title"), B.authors(spark, d).select("author_id", "name")

        def work(marts):
            TI.build(marts, "titles", papers, "paper_id", "title")
            TI.build(marts, "names", authors, "author_id", "name")
            found = TI.search_papers(marts, text, B.paper_authors(spark, d))
            return papers.join(found, "paper_id", "left_semi")

        return _stored(spark, work)
    return query


register("paper_search_indexed", R.SQL["paper_search"])(_indexed_search(R.SEARCH_TEXT))
register("paper_search_author_indexed", R.SQL["paper_search_author"])(_indexed_search(R.SEARCH_AUTHOR))


@register("paper_cards_last_indexed", R.SQL["paper_cards_last"])
def q_paper_cards_last_indexed(spark, d):
    """The last page, looked up in the stored page index."""
    def work(marts):
        PI.build(marts, B.papers(spark, d))
        found, _ = PI.page(marts, 999999, 12)
        cards, _ = P.paper_cards(found, B.paper_authors(spark, d), B.authors(spark, d), B.interactions(spark, d), B.topics(spark, d),
                                 interaction_of=lambda ids: B.interactions(spark, d, ids), number=1, size=12)
        return cards

    return _stored(spark, work)


# ------------------------------------------------------------ J14, misspelt names

_MISSPELT = """select author_id, case when author_id % 3 = 0 then upper(name) when author_id % 3 = 1 then substr(name, 1, 3) || substr(name, 5)
                       else replace(name, '#', '# ') || 'x' end as name from f_author"""


@register("near_names", with_views("""
    select a.name as name, c.name as candidate, cast(levenshtein(a.name, c.name) as int) as distance
    from (select distinct lower(name) as name from m) a join (select distinct lower(name) as name from cands) c
         on levenshtein(a.name, c.name) <= 2""", "f_author", extra={"m": _MISSPELT, "cands": R.CANDIDATES_SQL}))
def q_near_names(spark, d):
    return NS.near_names(_misspelt(spark, d), R.candidates_of(spark, d))


@register("resolve_misspelt", with_views("""
    select author_id, name, openalex_id from m left join (
        select k, candidate_id as openalex_id from (
            select a.k, c.candidate_id, row_number() over (partition by a.k order by levenshtein(a.k, lower(c.name)), c.rank, c.candidate_id) as rn
            from (select distinct lower(name) as k from m) a
            join (select name, min(struct_pack(r := rank, c := candidate_id)).r as rank,
                         min(struct_pack(r := rank, c := candidate_id)).c as candidate_id from cands group by 1) c
                 on levenshtein(a.k, lower(c.name)) <= 2) x where rn = 1) b on lower(name) = k""",
                                         "f_author", extra={"m": _MISSPELT, "cands": R.CANDIDATES_SQL}))
def q_resolve_misspelt(spark, d):
    return NS.resolve_near(_misspelt(spark, d), R.candidates_of(spark, d)).select("author_id", "name", "openalex_id")


def _misspelt(spark, d):
    a, k, name = B.authors(spark, d).select("author_id", "name"), F.col("author_id"), F.col("name")
    return a.select("author_id", F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.concat(F.substr(name, F.lit(1), F.lit(3)), F.substr(name, F.lit(5))))
                    .otherwise(F.concat(F.replace(name, F.lit("#"), F.lit("# ")), F.lit("x"))).alias("name"))


# --------------------------------------------------------------------- T3, T4

@register("density_topics")
def q_density_topics(spark, d):
    """T3, T4 (rows only): density clusters of all vectors, their strengths, and the noise moved to
    the topic of the nearest mean vector where its cosine allows."""
    vectors = B.vectors(spark, d).select("vec_id", "embedding")
    found = DN.density_clusters(vectors)
    topics = vectors.join(found.select("vec_id", F.col("cluster_id").alias("topic_id")), "vec_id")
    moved = T.reassign_outliers(topics).select("vec_id", "new_topic_id")
    return found.join(moved, "vec_id")


# --------------------------------------------------------------- T2, fewer topics

@register("reduced_topics")
def q_reduced_topics(spark, d):
    """T2 (rows only): the fixture's topics as at most five, with the keywords of the merged ones."""
    terms = cut_lineage(R.topic_terms_of(spark, d))
    sizes = B.vectors(spark, d).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    rows = terms.count()
    mapping = TM.reduce_topics(dealt(terms, rows, "term"), sizes, 5)
    ids = mapping.filter(F.col("topic_id") != X.OUTLIER_TOPIC_ID).select(F.col("new_topic_id").alias("topic_id")).distinct()
    words = T.topic_keywords(TM.merged_terms(terms, mapping, rows=rows), ids).withColumnRenamed("topic_id", "new_topic_id")
    return mapping.join(words, "new_topic_id", "left")
