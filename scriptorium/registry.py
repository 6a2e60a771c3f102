"""Registered queries: one Spark plan and, where SQL can express it, one
DuckDB oracle statement per operator of the inventory.

Every query reads the shared test tables of ``sf_dir`` (through
``scriptorium.sources.bindings``) over their whole extent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.oracle_sql import HOME, with_views
from scriptorium.operators import marts as M
from scriptorium.operators import network as G
from scriptorium.plans import dashboard as D
from scriptorium.session import cut_lineage
from scriptorium.sources import bindings as B

QueryFn = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ dashboard (Q4)

@register("top_authors", with_views("""
    select a.author_id as id, a.name, coalesce(c.works_count, 0) as works_count, a.faculty
    from f_author a left join (select author_id, count(paper_id) as works_count
                               from f_paper_author group by 1) c using (author_id)
    where a.institution = 'Home University'
    order by works_count desc, id limit 5""", "f_author", "f_paper_author"))
def q_top_authors(spark, d):
    return D.top_authors(B.authors(spark, d), B.paper_authors(spark, d), HOME)


@register("works_per_author", with_views("""
    select a.author_id, a.name, a.faculty, a.institution, coalesce(c.works_count, 0) as works_count
    from f_author a left join (select author_id, count(paper_id) as works_count
                               from f_paper_author group by 1) c using (author_id)""",
                                         "f_author", "f_paper_author"))
def q_works_per_author(spark, d):
    return D.works_per_author(B.authors(spark, d), B.paper_authors(spark, d))


@register("dashboard_summary", with_views("""
    select (select count(*) from f_paper) as total_papers,
           (select count(*) from f_author where institution = 'Home University') as total_authors,
           (select count(*) from f_topic where topic_id <> -1) as total_clusters""",
                                          "f_paper", "f_author", "f_topic"))
def q_dashboard_summary(spark, d):
    return D.dashboard_summary(B.papers(spark, d), B.authors(spark, d), B.topic_names(spark, d), HOME)


@register("all_topics", with_views("""
    select topic_id, name, keywords from f_topic where topic_id <> -1 order by topic_id""", "f_topic"))
def q_all_topics(spark, d):
    return D.all_topics(B.topics(spark, d))


@register("external_authors", with_views("""
    select author_id, name, institution from f_author
    where institution is distinct from 'Home University'""", "f_author"))
def q_external_authors(spark, d):
    return D.external(B.authors(spark, d), HOME).select("author_id", "name", "institution")


# Yearly stat over the bound tables: papers with a primary topic (M5 rule).
_YEARLY_SQL = """
    select p.year, t.topic_id, count(*) as total_papers
    from f_paper p join f_pt t using (paper_id)
    where p.year is not null and p.year <> 0
    group by 1, 2"""


def _yearly(spark, d):
    pt = B.paper_topics(spark, d).select("paper_id", "topic_id")
    p = B.papers(spark, d).select("paper_id", "year")
    return (p.join(pt, "paper_id")
            .filter(F.col("year").isNotNull() & (F.col("year") != 0))
            .groupBy("year", "topic_id").agg(F.count(F.lit(1)).alias("total_papers")))


@register("yearly_topic_stat", with_views(_YEARLY_SQL, "f_paper", "f_pt"))
def q_yearly_topic_stat(spark, d):
    return _yearly(spark, d)


def _trend_names() -> list[str]:
    # the test tables' 25 brands: DuckDB needs the pivot's columns spelled out
    return [f"Brand#{i}" for i in range(1, 26)] + ["Outlier / Noise"]


def _domain_trends_sql() -> str:
    cols = ",\n           ".join(
        f"coalesce(max(case when name = '{n}' then total_papers end), 0) as \"{n}\"" for n in _trend_names())
    return with_views(f"""
    select cast(y.year as varchar) as year,
           {cols}
    from ({_YEARLY_SQL}) y join f_topic t using (topic_id)
    group by y.year order by y.year""", "f_paper", "f_pt", "f_topic")


@register("domain_trends", _domain_trends_sql())
def q_domain_trends(spark, d):
    return D.domain_trends(_yearly(spark, d), B.topic_names(spark, d))


@register("domain_trends_long", with_views(f"""
    select cast(y.year as varchar) as year, y.year as year_num, t.name, max(y.total_papers) as total_papers
    from ({_YEARLY_SQL}) y join f_topic t using (topic_id) group by 2, 3""", "f_paper", "f_pt", "f_topic"))
def q_domain_trends_long(spark, d):
    return D.domain_trends_long(_yearly(spark, d), B.topic_names(spark, d))


@register("series_keywords", with_views("""
    select s.name, coalesce(t.keywords, cast([] as varchar[])) as keywords
    from (select distinct ' ' || name || ' ' as name from f_topic
          union all select 'Unknown topic') s
    left join f_topic t on trim(s.name) = trim(t.name)""", "f_topic"))
def q_series_keywords(spark, d):
    t = B.topics(spark, d)
    names = (t.select(F.concat(F.lit(" "), "name", F.lit(" ")).alias("name")).distinct()
             .unionByName(spark.range(1).select(F.lit("Unknown topic").alias("name"))))
    return D.series_keywords(names, t)


# ------------------------------------------------------------------- marts

def _results(spark, d):
    return B.results(spark, d)


RESULTS_VIEWS = ("f_paper", "f_interaction", "f_topic", "f_authorship", "f_author")

# results rows in SQL: one per paper with its ordered author structs.
RESULTS_SQL = """
    select p.paper_id as seq, p.doi, p.title, '' as abstract, p.year, p.citation_count,
           coalesce(a.authors_struct, []) as authors_struct,
           i.primary_topic_id as cluster_id,
           case when i.primary_topic_id = -1 then 'Outlier / Noise'
                when i.primary_topic_id is not null then 'Topic ' || i.primary_topic_id || ': ' || t.name end
               as cluster_label,
           i.predicted_multi_labels,
           case when i.primary_topic_id = -1 then cast([] as varchar[]) else t.keywords end as topic_keywords,
           i.topic_distribution
    from f_paper p
    left join (select l.paper_id,
                      list(struct_pack(name := s.s_name,
                                       openalex_id := case when s.s_suppkey % 7 = 0 then null
                                                           else 'A' || s.s_suppkey end) order by l.pos)
                          as authors_struct
               from f_authorship l join supplier s on l.author_id = s.s_suppkey group by 1) a using (paper_id)
    left join f_interaction i using (paper_id)
    left join f_topic t on t.topic_id = i.primary_topic_id"""

_AUTHORSHIP_SQL = """
    select seq, doi, pos, a.name as name, a.openalex_id as openalex_id,
           coalesce(nullif(a.openalex_id, ''), lower(a.name)) as author_key
    from (select seq, doi, generate_subscripts(authors_struct, 1) - 1 as pos, unnest(authors_struct) as a
          from results) u"""

ROSTER_SQL = """
    select author_id as seq, case when author_id % 2 = 0 then upper(name) else name end as name, faculty
    from f_author where faculty is not null"""

AUTHOR_DIM_SQL = f"""
    select a.author_key, a.openalex_id, a.name, f.faculty,
           case when coalesce(f.faculty, '') <> '' then 'Home University' else 'External' end as institution,
           cast(null as varchar) as email
    from (select author_key, arg_min(name, seq * 1000 + pos) as name,
                 arg_min(openalex_id, seq * 1000 + pos) as openalex_id
          from ({_AUTHORSHIP_SQL}) x group by 1) a
    left join (select lower(name) as name_key, arg_max(faculty, seq) as faculty
               from ({ROSTER_SQL}) r group by 1) f on lower(a.name) = f.name_key"""


def _results_sql(body: str) -> str:
    return with_views(body, *RESULTS_VIEWS, extra={"results": RESULTS_SQL})


@register("topic_dim", _results_sql("""
    select coalesce(cluster_id, -1) as topic_id,
           arg_max(case when strpos(coalesce(cluster_label, 'Outlier / Noise'), ': ') > 0
                        then substr(cluster_label, strpos(cluster_label, ': ') + 2)
                        else coalesce(cluster_label, 'Outlier / Noise') end, seq) as name,
           arg_max(coalesce(topic_keywords, cast([] as varchar[])), seq) as keywords
    from results group by 1"""))
def q_topic_dim(spark, d):
    return M.topic_dim(_results(spark, d))


@register("paper_dim", _results_sql("""
    select doi, arg_max(title, seq) as title, arg_max(year, seq) as year, arg_max(abstract, seq) as abstract,
           arg_max(citation_count, seq) as citation_count, cast(null as varchar) as venue, '' as url
    from results where doi is not null group by 1"""))
def q_paper_dim(spark, d):
    return M.paper_dim(_results(spark, d))


@register("author_dim", _results_sql(AUTHOR_DIM_SQL))
def q_author_dim(spark, d):
    return M.author_dim(_results(spark, d), B.roster(spark, d), HOME)


@register("paper_authors", _results_sql(f"""
    select distinct doi, author_key from ({_AUTHORSHIP_SQL}) x where doi is not null"""))
def q_paper_authors(spark, d):
    return M.paper_authors(_results(spark, d))


@register("interactions", _results_sql("""
    select doi, arg_max(coalesce(cluster_id, -1), seq) as primary_topic_id,
           arg_max(coalesce(topic_distribution, cast([] as double[])), seq) as topic_distribution,
           arg_max(coalesce(predicted_multi_labels, cast([] as varchar[])), seq) as predicted_multi_labels
    from results where doi is not null group by 1"""))
def q_interactions(spark, d):
    return M.interactions(_results(spark, d))


@register("faculty_topic_stat", _results_sql(f"""
    select f.faculty, coalesce(r.cluster_id, -1) as topic_id, count(*) as total_papers,
           cast(sum(coalesce(r.citation_count, 0)) as bigint) as total_citations
    from (select distinct x.seq, a.faculty
          from ({_AUTHORSHIP_SQL}) x join ({AUTHOR_DIM_SQL}) a using (author_key)
          where coalesce(a.faculty, '') <> '' and x.doi is not null) f
    join results r using (seq)
    group by 1, 2"""))
def q_faculty_topic_stat(spark, d):
    # read by the author table and by the fact: made once
    r = cut_lineage(_results(spark, d).select("seq", "doi", "authors_struct", "cluster_id", "cluster_label", "citation_count"))
    return M.faculty_topic_stat(r, M.author_dim(r, B.roster(spark, d), HOME))


@register("yearly_topic_stat_load", _results_sql("""
    select year, coalesce(cluster_id, -1) as topic_id, count(*) as total_papers
    from results where doi is not null and year is not null and year <> 0 group by 1, 2"""))
def q_yearly_topic_stat_load(spark, d):
    return M.yearly_topic_stat(_results(spark, d))


@register("coauthor_edges", with_views("""
    select a.author_id as author_a, b.author_id as author_b, count(*) as weight
    from f_paper_author a join f_paper_author b on a.paper_id = b.paper_id and a.author_id < b.author_id
    group by 1, 2""", "f_paper_author"))
def q_coauthor_edges(spark, d):
    return G.coauthor_edges(B.paper_authors(spark, d))


# ----------------------------------------------------------------- network

from scriptorium.plans import papers as P  # noqa: E402
from scriptorium.plans import profiles as R  # noqa: E402

NET_TOPICS = ["Brand#1", "brand#7"]


def _net_sql(scope_filter: str = "") -> dict[str, str]:
    return {
        "scope": f"""select paper_id from f_paper p {scope_filter}
                     order by year desc nulls first, paper_id limit 200""",
        "sb": "select * from f_paper_author where paper_id in (select paper_id from scope)",
        "involved": """select a.*, c.cnt from f_author a
                       join (select author_id, count(distinct paper_id) as cnt from sb group by 1) c using (author_id)""",
        "pairs": """select x.paper_id, x.author_id as a, y.author_id as b
                    from sb x join sb y on x.paper_id = y.paper_id and x.author_id < y.author_id""",
        "ih": "select author_id, institution is not distinct from 'Home University' as home from involved",
        "collab": """select case when ha.home then p.b else p.a end as author_id,
                            count(distinct case when ha.home then p.a else p.b end) as n
                     from pairs p join ih ha on ha.author_id = p.a join ih hb on hb.author_id = p.b
                     where ha.home <> hb.home group by 1""",
        "ext": """select i.*, coalesce(c.n, 0) as n from involved i left join collab c using (author_id)
                  where i.institution is distinct from 'Home University'""",
        "nodes": """select author_id, name, (cnt | 1) + 2 as val, 'Home University' as grp, institution, faculty
                    from involved where institution is not distinct from 'Home University'
                    union all
                    select author_id, name, (cnt | 1) + 2, 'External Partner',
                           case when coalesce(institution, '') <> '' then institution else 'External' end,
                           cast(null as varchar)
                    from ext where n >= 2""",
        "links": """select cast(a as varchar) as source, cast(b as varchar) as target, count(*) as weight
                    from pairs where a in (select author_id from nodes) and b in (select author_id from nodes)
                    group by a, b""",
    }


_F5_FILTER = """where paper_id in (
    select i.paper_id from f_interaction i left join f_topic t on t.topic_id = i.primary_topic_id
    where t.name in ('Brand#1', 'brand#7')
       or len(list_filter(i.predicted_multi_labels,
                          lambda l: contains(upper(l), 'BRAND#1') or contains(upper(l), 'BRAND#7'))) > 0)"""
_NET_VIEWS = ("f_paper", "f_paper_author", "f_author", "f_interaction", "f_topic")


def _network(spark, d, topics=None, limit=200):
    return G.author_network(B.papers(spark, d), B.paper_authors(spark, d), B.authors(spark, d), HOME,
                            limit=limit, topic_names=topics, interaction=B.interactions(spark, d),
                            topic=B.topic_names(spark, d))


def _net_all_sql() -> dict[str, str]:
    return _net_sql() | {"scope": "select paper_id from f_paper"}


@register("network_nodes_all", with_views("""
    select cast(author_id as varchar) as id, name, val, grp as "group", institution, faculty from nodes""",
                                          *_NET_VIEWS, extra=_net_all_sql()))
def q_network_nodes_all(spark, d):
    return _network(spark, d, limit=None)[0]


@register("network_links_all", with_views("select * from links", *_NET_VIEWS, extra=_net_all_sql()))
def q_network_links_all(spark, d):
    return _network(spark, d, limit=None)[1]


@register("network_totals_all", with_views("""
    select count(*) as total_external_found, count(*) filter (where n >= 2) as qualified_external_count
    from ext""", *_NET_VIEWS, extra=_net_all_sql()))
def q_network_totals_all(spark, d):
    return _network(spark, d, limit=None)[2]


@register("network_nodes", with_views("""
    select cast(author_id as varchar) as id, name, val, grp as "group", institution, faculty from nodes""",
                                      *_NET_VIEWS, extra=_net_sql()))
def q_network_nodes(spark, d):
    return _network(spark, d)[0]


@register("network_links", with_views("select * from links", *_NET_VIEWS, extra=_net_sql()))
def q_network_links(spark, d):
    return _network(spark, d)[1]


@register("network_totals", with_views("""
    select count(*) as total_external_found, count(*) filter (where n >= 2) as qualified_external_count
    from ext""", *_NET_VIEWS, extra=_net_sql()))
def q_network_totals(spark, d):
    return _network(spark, d)[2]


@register("network_nodes_topics", with_views("""
    select cast(author_id as varchar) as id, name, val, grp as "group", institution, faculty from nodes""",
                                             *_NET_VIEWS, extra=_net_sql(_F5_FILTER)))
def q_network_nodes_topics(spark, d):
    return _network(spark, d, NET_TOPICS)[0]


@register("network_links_topics", with_views("select * from links", *_NET_VIEWS, extra=_net_sql(_F5_FILTER)))
def q_network_links_topics(spark, d):
    return _network(spark, d, NET_TOPICS)[1]


@register("edge_class", with_views("""
    select l.source, l.target, l.weight,
           case when coalesce(s.grp = 'Home University', false) and coalesce(t.grp = 'Home University', false)
                then 'internal' else 'external' end as edge_class
    from links l left join nodes s on cast(s.author_id as varchar) = l.source
                 left join nodes t on cast(t.author_id as varchar) = l.target""",
                                   *_NET_VIEWS, extra=_net_sql()))
def q_edge_class(spark, d):
    nodes, links, _ = _network(spark, d)
    return G.edge_class(links, nodes, HOME)


@register("scope_by_topics", with_views(f"""
    select paper_id, title from f_paper p {_F5_FILTER}""", *_NET_VIEWS))
def q_scope_by_topics(spark, d):
    return G.scope_by_topics(B.papers(spark, d), B.interactions(spark, d), B.topic_names(spark, d),
                             NET_TOPICS).select("paper_id", "title")


@register("newest_papers", with_views("""
    select paper_id, year from f_paper order by year desc nulls first, paper_id limit 200""", "f_paper"))
def q_newest_papers(spark, d):
    return G.newest(B.papers(spark, d).select("paper_id", "year"), 200)


@register("home_collaborators", with_views("""
    select author_id, n as home_collaborators from ext where n > 0""", *_NET_VIEWS, extra=_net_sql()))
def q_home_collaborators(spark, d):
    scope = G.newest(B.papers(spark, d).select("paper_id", "year"), 200)
    sb = B.paper_authors(spark, d).join(scope.select("paper_id"), "paper_id", "left_semi")
    inv = G.authors_in(scope, sb, B.authors(spark, d))
    is_home = inv.select("author_id", F.col("institution").eqNullSafe(HOME).alias("home"))
    ext = inv.filter(~F.col("institution").eqNullSafe(HOME)).select("author_id")
    return G.home_collaborators(G.author_pairs(sb), is_home).join(ext, "author_id", "left_semi")


# ------------------------------------------------------------------ papers

_LABEL_TOPICS_SQL = """
    select paper_id, list(t.topic_id order by i) as ids, list(t.name order by i) as nm,
           list(array_to_string(t.keywords, ', ') order by i) as kw
    from (select paper_id, generate_subscripts(predicted_multi_labels, 1) as i,
                 unnest(predicted_multi_labels) as label from f_interaction) x
    join f_topic t on t.topic_id = try_cast(trim(replace(split_part(label, ':', 1), 'Topic ', '')) as int)
    group by 1"""

_AUTHORS_OF_SQL = """
    select pa.paper_id, list(a.name order by a.author_id) as names
    from f_paper_author pa join f_author a using (author_id) group by 1"""


def _cards_sql(where: str, page_no: int, size: int = 12, extra: dict[str, str] | None = None) -> str:
    return with_views(f"""
    select p.paper_id as id, p.title, p.year, coalesce(lt.ids, []) as topic_ids,
           coalesce(lt.nm, []) as topic_names, coalesce(lt.kw, []) as topic_keywords,
           coalesce(au.names, []) as authors, p.citation_count, p.doi
    from (select * from f_paper p {where}
          order by year desc nulls first, citation_count desc nulls first, paper_id
          limit {size} offset {(page_no - 1) * size}) p
    left join au using (paper_id) left join lt using (paper_id)""",
                      *_NET_VIEWS, extra={**(extra or {}), "au": _AUTHORS_OF_SQL, "lt": _LABEL_TOPICS_SQL})


def _cards(spark, d, **kw):
    return P.paper_cards(B.papers(spark, d), B.paper_authors(spark, d), B.authors(spark, d),
                         B.interactions(spark, d), B.topics(spark, d),
                         interaction_of=lambda ids: B.interactions(spark, d, ids), **kw)


SEARCH_TEXT = "urgent order 12"
SEARCH_AUTHOR = "supplier#00000004"
_SEARCH_HITS = f"""
    select paper_id from (select paper_id, upper(title) as t from f_paper) x where contains(t, upper('{SEARCH_TEXT}'))
    union
    select pa.paper_id from f_paper_author pa
    join (select author_id from (select author_id, upper(name) as t from f_author) y
          where contains(t, upper('{SEARCH_TEXT}'))) a using (author_id)"""
_FILTERED_WHERE = _F5_FILTER + """
    and paper_id in (select paper_id from f_paper_author where author_id = 42)"""


@register("paper_cards", _cards_sql("", 1))
def q_paper_cards(spark, d):
    return _cards(spark, d, number=1, size=12)[0]


@register("paper_cards_page3", _cards_sql("", 3))
def q_paper_cards_page3(spark, d):
    return _cards(spark, d, number=3, size=12)[0]


@register("paper_cards_search", _cards_sql("semi join hits h on h.paper_id = p.paper_id", 1, extra={"hits": _SEARCH_HITS}))
def q_paper_cards_search(spark, d):
    return _cards(spark, d, number=1, size=12, text=SEARCH_TEXT)[0]


def _filtered_pages_sql() -> str:
    return f"(select count(*) from f_paper p {_FILTERED_WHERE})"


@register("paper_cards_filtered", with_views(f"""
    select p.paper_id as id, p.title, p.year, coalesce(lt.ids, []) as topic_ids,
           coalesce(lt.nm, []) as topic_names, coalesce(lt.kw, []) as topic_keywords,
           coalesce(au.names, []) as authors, p.citation_count, p.doi
    from (select *, row_number() over (order by year desc nulls first, citation_count desc nulls first, paper_id)
                    as rn
          from f_paper p {_FILTERED_WHERE}) p
    left join au using (paper_id) left join lt using (paper_id)
    where rn > (greatest(1, cast(ceil({_filtered_pages_sql()} / 12.0) as int)) - 1) * 12
      and rn <= greatest(1, cast(ceil({_filtered_pages_sql()} / 12.0) as int)) * 12""",
                                             *_NET_VIEWS, extra={"au": _AUTHORS_OF_SQL, "lt": _LABEL_TOPICS_SQL}))
def q_paper_cards_filtered(spark, d):
    # page 999 is past the end: clamped to the last page
    return _cards(spark, d, number=999, size=12, topic_names=NET_TOPICS, author_id=42)[0]


@register("paper_page_info", with_views(f"""
    select cast(pages as int) as current_page, cast(pages as int) as total_pages, n as total_items,
           12 as page_size, false as has_next, pages > 1 as has_previous
    from (select n, greatest(1, cast(ceil(n / 12.0) as int)) as pages
          from (select count(*) as n from f_paper p {_FILTERED_WHERE}) c) x""", *_NET_VIEWS))
def q_paper_page_info(spark, d):
    _, info = _cards(spark, d, number=999, size=12, topic_names=NET_TOPICS, author_id=42)
    return P.page_info_frame(spark, info)


@register("paper_search", with_views(f"""
    select p.paper_id, p.title from f_paper p semi join hits h on h.paper_id = p.paper_id""", *_NET_VIEWS,
                                     extra={"hits": _SEARCH_HITS}))
def q_paper_search(spark, d):
    return P.search_papers(B.papers(spark, d), B.paper_authors(spark, d), B.authors(spark, d),
                           SEARCH_TEXT).select("paper_id", "title")


@register("paper_search_author", with_views(f"""
    select paper_id, title from f_paper p
    where contains(upper(title), upper('{SEARCH_AUTHOR}'))
       or paper_id in (select pa.paper_id from f_paper_author pa join f_author a using (author_id)
                       where contains(upper(a.name), upper('{SEARCH_AUTHOR}')))""", *_NET_VIEWS))
def q_paper_search_author(spark, d):
    return P.search_papers(B.papers(spark, d), B.paper_authors(spark, d), B.authors(spark, d),
                           SEARCH_AUTHOR).select("paper_id", "title")


@register("papers_of_author", with_views("""
    select paper_id, title from f_paper where paper_id in (select paper_id from f_paper_author where author_id = 42)""",
                                         "f_paper", "f_paper_author"))
def q_papers_of_author(spark, d):
    return P.papers_of(B.papers(spark, d), B.paper_authors(spark, d), 42).select("paper_id", "title")


@register("paper_detail_topics", with_views("select paper_id, ids as topic_ids, nm as topic_names from lt",
                                            *_NET_VIEWS, extra={"lt": _LABEL_TOPICS_SQL}))
def q_paper_detail_topics(spark, d):
    return P.label_topics(B.interactions(spark, d), B.topic_names(spark, d))


_DETAIL_CHART_SQL = """
    select paper_id, cast(rank as int) as rank, cast(topic_id as int) as topic_id, t.name as subject,
           round(prob, 4) as probability
    from (select paper_id, topic_id, prob,
                 row_number() over (partition by paper_id order by prob desc, topic_id) as rank
          from (select paper_id, generate_subscripts(topic_distribution, 1) - 1 as topic_id,
                       unnest(topic_distribution) as prob from f_interaction) x
          where prob > 0.01) r
    join f_topic t using (topic_id)
    where rank <= 6"""


@register("paper_detail_chart", with_views(_DETAIL_CHART_SQL, *_NET_VIEWS))
def q_paper_detail_chart(spark, d):
    return P.detail_chart(B.interactions(spark, d), B.topic_names(spark, d))


@register("chart_profile", with_views("""
    select paper_id, rank, topic_id, subject, probability, cast(chart_rank as int) as chart_rank, cast(round(probability * 100) as int) as percent
    from (select *, row_number() over (partition by paper_id order by probability desc, rank) as chart_rank
          from dc where probability > 0.02) x
    where chart_rank <= 6""", *_NET_VIEWS, extra={"dc": _DETAIL_CHART_SQL}))
def q_chart_profile(spark, d):
    return P.chart_profile(P.detail_chart(B.interactions(spark, d), B.topic_names(spark, d)), "paper_id")


@register("home_first", with_views("""
    select paper_id, pos, author_id, name, institution,
           cast(row_number() over (partition by paper_id
                                   order by (institution is not distinct from 'Home University') desc, pos,
                                            author_id) - 1 as int) as display_pos
    from f_authorship join f_author using (author_id)""", "f_authorship", "f_author"))
def q_home_first(spark, d):
    rows = B.authorships(spark, d).join(B.authors(spark, d), "author_id").select("paper_id", "pos", "author_id",
                                                                                  "name", "institution")
    return P.home_first(rows, HOME)


@register("paper_detail", with_views("""
    select p.paper_id, p.doi, p.title, p.year, p.citation_count, coalesce(au.names, []) as authors,
           lt.ids as topic_ids, lt.nm as topic_names
    from f_paper p left join au using (paper_id) left join lt using (paper_id) where p.paper_id = 7""",
                                     *_NET_VIEWS, extra={"au": _AUTHORS_OF_SQL, "lt": _LABEL_TOPICS_SQL}))
def q_paper_detail(spark, d):
    out = P.paper_detail(B.papers(spark, d), B.paper_authors(spark, d), B.authors(spark, d),
                         B.interactions(spark, d), B.topics(spark, d), paper_id=7)
    return out.select("paper_id", "doi", "title", "year", "citation_count", "authors", "topic_ids", "topic_names")


_AUTHOR_ROWS_SQL = """
    select pa.paper_id, list(a.author_id order by a.author_id) as ids, list(a.name order by a.author_id) as names,
           list(a.institution order by a.author_id) as inst
    from f_paper_author pa join f_author a using (author_id) group by 1"""
_PAPER_RECORD_SQL = """
    select p.paper_id, p.doi, p.title, 'About ' || p.title as abstract, p.year, split_part(p.title, ' order ', 1) as venue,
           '' as url, p.citation_count, coalesce(au.ids, []) as author_ids, coalesce(au.names, []) as authors,
           coalesce(au.inst, []) as author_institutions, coalesce(lt.ids, []) as topic_ids,
           coalesce(lt.nm, []) as topic_names, coalesce(lt.kw, []) as topic_keywords,
           coalesce(ch.s, []) as chart_subjects, coalesce(ch.p, []) as chart_probabilities
    from f_paper p left join au using (paper_id) left join lt using (paper_id)
    left join (select paper_id, list(subject order by rank) as s, list(probability order by rank) as p
               from dc group by 1) ch using (paper_id)"""
_RECORD_EXTRA = {"au": _AUTHOR_ROWS_SQL, "lt": _LABEL_TOPICS_SQL, "dc": _DETAIL_CHART_SQL}


def _paper_record(spark, d, paper_id=None):
    own = B.papers(spark, d).withColumns({"abstract": F.concat(F.lit("About "), "title"),
                                          "venue": F.split_part("title", F.lit(" order "), F.lit(1)), "url": F.lit("")})
    return P.paper_record(own, B.paper_authors(spark, d), B.authors(spark, d), B.interactions(spark, d),
                          B.topics(spark, d), paper_id)


@register("paper_detail_full", with_views(_PAPER_RECORD_SQL, *_NET_VIEWS, extra=_RECORD_EXTRA))
def q_paper_detail_full(spark, d):
    return _paper_record(spark, d)


@register("paper_detail_one", with_views(_PAPER_RECORD_SQL + " where p.paper_id = 7", *_NET_VIEWS, extra=_RECORD_EXTRA))
def q_paper_detail_one(spark, d):
    return _paper_record(spark, d, 7)


@register("paper_cards_last", with_views("""
    select p.paper_id as id, p.title, p.year, coalesce(lt.ids, []) as topic_ids, coalesce(lt.nm, []) as topic_names,
           coalesce(lt.kw, []) as topic_keywords, coalesce(au.names, []) as authors, p.citation_count, p.doi
    from (select *, row_number() over (order by year desc nulls first, citation_count desc nulls first, paper_id) as rn
          from f_paper) p left join au using (paper_id) left join lt using (paper_id)
    where rn > ((select count(*) from f_paper) - 1) // 12 * 12""",
                                         *_NET_VIEWS, extra={"au": _AUTHORS_OF_SQL, "lt": _LABEL_TOPICS_SQL}))
def q_paper_cards_last(spark, d):
    return _cards(spark, d, number=999999, size=12)[0]


# ---------------------------------------------------------------- profiles

@register("author_totals", with_views("""
    select a.author_id, coalesce(c.n, 0) as total_papers, cast(coalesce(c.s, 0) as bigint) as total_citations
    from f_author a left join (select author_id, count(*) as n, sum(coalesce(citation_count, 0)) as s
                               from f_paper_author join f_paper using (paper_id) group by 1) c using (author_id)""",
                                      "f_author", "f_paper_author", "f_paper"))
def q_author_totals(spark, d):
    return R.author_totals(B.authors(spark, d), B.paper_authors(spark, d), B.papers(spark, d))


_AUTHOR_PROFILE_SQL = """
    select r.author_id, cast(r.rank as int) as rank, cast(r.topic_id as int) as topic_id, t.name as subject, round(r.total / n.n, 4) as probability
    from (select *, row_number() over (partition by author_id order by total desc, topic_id) as rank
          from (select author_id, idx - 1 as topic_id, sum(p) as total
                from (select pa.author_id, unnest(i.topic_distribution) as p,
                             generate_subscripts(i.topic_distribution, 1) as idx
                      from f_paper_author pa join f_interaction i using (paper_id)
                      where len(i.topic_distribution) > 0) x
                group by 1, 2) s) r
    join (select pa.author_id, count(*) as n from f_paper_author pa join f_interaction i using (paper_id)
          where len(i.topic_distribution) > 0 group by 1) n using (author_id)
    join f_topic t on t.topic_id = r.topic_id
    where r.rank <= 6 and r.total > 0"""


@register("author_profile", with_views(_AUTHOR_PROFILE_SQL, *_NET_VIEWS))
def q_author_profile(spark, d):
    return R.author_profile(B.paper_authors(spark, d), B.interactions(spark, d), B.topic_names(spark, d))


@register("author_detail", with_views("""
    select a.author_id, case when a.author_id % 7 = 0 then null else 'A' || a.author_id end as openalex_id, a.name,
           a.institution, a.faculty, coalesce(c.n, 0) as total_papers, cast(coalesce(c.s, 0) as bigint) as total_citations,
           coalesce(ch.s, []) as chart_subjects, coalesce(ch.p, []) as chart_probabilities
    from f_author a
    left join (select author_id, count(*) as n, sum(coalesce(citation_count, 0)) as s
               from f_paper_author join f_paper using (paper_id) group by 1) c using (author_id)
    left join (select author_id, list(subject order by rank) as s, list(probability order by rank) as p
               from ap group by 1) ch using (author_id)""", *_NET_VIEWS, extra={"ap": _AUTHOR_PROFILE_SQL}))
def q_author_detail(spark, d):
    a = B.authors(spark, d).withColumn("openalex_id", F.when(F.col("author_id") % 7 != 0, F.concat(
        F.lit("A"), F.col("author_id").cast("string"))))
    return R.author_record(a, B.paper_authors(spark, d), B.papers(spark, d), B.interactions(spark, d), B.topic_names(spark, d))


# ------------------------------------------------------- text and ingest

from scriptorium.functions import text as X  # noqa: E402
from scriptorium.operators import dedupe as DD  # noqa: E402
from scriptorium.operators import topics as T  # noqa: E402
from scriptorium.operators import upsert as U  # noqa: E402
from scriptorium.oracle_sql import clean_text_sql, stop_words_sql  # noqa: E402
from scriptorium.sources import ingest as I  # noqa: E402
from scriptorium.sources.tables import by_key, read  # noqa: E402


@register("clean_text_pages", f"select page_id, {clean_text_sql('html')} as clean from pages")
def q_clean_text_pages(spark, d):
    return read(spark, d, "pages", "page_id", "html").select(
        "page_id", X.clean_text("html").alias("clean"))


@register("clean_text_documents", f"select doc_id, {clean_text_sql('text')} as clean from documents")
def q_clean_text_documents(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select(
        "doc_id", X.clean_text("text").alias("clean"))


@register("rebuild_abstract", f"select doc_id, {clean_text_sql('text')} as abstract from documents")
def q_rebuild_abstract(spark, d):
    return B.inverted_index(spark, d).select("doc_id", X.rebuild_abstract("abstract_inverted_index").alias("abstract"))


# Raw display names of a document's authors (the raw-works binding) in SQL.
_DISPLAY_SQL = """
    select l_orderkey as doc_id, l_linenumber as lpos,
           case when s_suppkey % 7 = 0 then null else 'A' || s_suppkey end as oid,
           case when s_suppkey % 11 = 0 then '' when s_suppkey % 6 = 0 then 'José ' || s_name
                when l_linenumber % 2 = 0 then upper(s_name) else s_name end as disp
    from lineitem join supplier on l_suppkey = s_suppkey"""


@register("works_from_raw", with_views(f"""
    select doc_id as seq, md5(text) as doi,
           case when doc_id % 17 = 0 then '(No Title)' else split_part(text, chr(10), 1) end as title,
           cast(2000 + doc_id % 25 as int) as year, source as venue, cast(n_chars % 100 as int) as citation_count,
           coalesce((select count(*) from disp where disp.doc_id = documents.doc_id), 0) as n_authors
    from documents where doc_id % 3 <> 0""", extra={"disp": _DISPLAY_SQL}))
def q_works_from_raw(spark, d):
    w = I.works_from_raw(B.raw_works(spark, d))
    return w.select("seq", "doi", "title", "year", "venue", "citation_count",
                    F.size("authorships").cast("long").alias("n_authors"))


@register("clean_papers", with_views(f"""
    select doc_id as seq, md5(text) as doi,
           {clean_text_sql("case when doc_id % 17 = 0 then '(No Title)' else split_part(text, chr(10), 1) end")}
               as title,
           case when doc_id % 4 = 0 then '' else {clean_text_sql('text')} end as abstract,
           coalesce((select array_to_string(list({clean_text_sql('disp')} order by lpos, oid nulls first, disp), ', ')
                     from disp where disp.doc_id = documents.doc_id and disp <> ''), '') as authors_text,
           cast(2000 + doc_id % 25 as int) as year, source as venue, cast(n_chars % 100 as int) as citation_count
    from documents where doc_id % 3 <> 0""", extra={"disp": _DISPLAY_SQL}))
def q_clean_papers(spark, d):
    c = I.clean_papers(I.works_from_raw(B.raw_works(spark, d)))
    return c.select("seq", "doi", "title", "abstract", "authors_text", "year", "venue", "citation_count")


@register("flatten_authors", with_views(f"""
    select doc_id, cast(generate_subscripts(names, 1) - 1 as int) as pos, unnest(names) as name, unnest(ids) as openalex_id
    from (select doc_id, list({clean_text_sql('disp')} order by lpos, oid nulls first, disp) as names,
                 list(oid order by lpos, oid nulls first, disp) as ids
          from disp where disp <> '' and doc_id in (select doc_id from documents) group by 1) x""",
                                        extra={"disp": _DISPLAY_SQL}))
def q_flatten_authors(spark, d):
    r = B.raw_works(spark, d).select(F.col("seq").alias("doc_id"), X.flatten_authors("authorships").alias("a"))
    return (r.select("doc_id", F.posexplode("a").alias("pos", "x"))
            .select("doc_id", "pos", F.col("x.name").alias("name"), F.col("x.openalex_id").alias("openalex_id")))


@register("roster_from_staff", """
    select trim(' ' || split_part(s_name, '#', 1)) || ' ' || trim(split_part(s_name, '#', 2)) as name,
           'Home University' as institution,
           trim(case when s_suppkey % 4 = 0 then 'Requested Faculty' else n_name end) as faculty,
           case when s_suppkey % 3 = 0 then null else trim(' s' || s_suppkey || '@example.org ') end as email
    from supplier join nation on s_nationkey = n_nationkey
    where s_suppkey % 11 <> 0""")
def q_roster_from_staff(spark, d):
    return I.roster_from_staff(B.staff(spark, d), HOME)


CANDIDATES_SQL = """
    select s_name as name, 'P' || l_partkey as candidate_id, l_orderkey * 10 + l_linenumber as rank
    from lineitem join supplier on l_suppkey = s_suppkey"""


def candidates_of(spark, d):
    li = read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    s = read(spark, d, "supplier", "s_suppkey", "s_name")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("s_name").alias("name"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("candidate_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))


@register("resolve_author", with_views(f"""
    select a.author_id, a.name, c.candidate_id as openalex_id
    from f_author a left join (
        select name, candidate_id from (
            select *, row_number() over (partition by name order by rank, candidate_id) as rn from cands) r
        where rn = 1) c using (name)""", "f_author", extra={"cands": CANDIDATES_SQL}))
def q_resolve_author(spark, d):
    return I.resolve_author(B.authors(spark, d).select("author_id", "name"), candidates_of(spark, d))


def _works(spark, d):
    return read(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate").select(
        F.col("l_suppkey").alias("author"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("work_id"),
        F.col("l_shipdate").alias("publication_date"))


def _cap_sql(n: int) -> str:
    return f"""
    select author, work_id, cast(rank as int) as rank from (
        select l_suppkey as author, l_orderkey * 10 + l_linenumber as work_id,
               row_number() over (partition by l_suppkey order by l_shipdate desc nulls last,
                                  l_orderkey * 10 + l_linenumber) as rank
        from lineitem) r
    where rank <= {n}"""


@register("cap_per_author", _cap_sql(10))
def q_cap_per_author(spark, d):
    return I.cap_per_author(_works(spark, d), n=10).select("author", "work_id", "rank")


@register("cap_per_author_100", _cap_sql(100))
def q_cap_per_author_100(spark, d):
    return I.cap_per_author(_works(spark, d), n=100).select("author", "work_id", "rank")


# ------------------------------------------------------------------ dedupe

# clean records with cleaned authors (the clean-docs binding) in SQL.
_CLEAN_AUTHORS_SQL = f"""
    select doc_id, row_number() over (partition by doc_id order by lpos, nm, oid nulls first) - 1 as pos,
           nm as name, oid as openalex_id
    from (select doc_id, lpos, oid, {clean_text_sql('disp')} as nm from disp where disp <> '') x"""

_GROUPS_SQL = """
    select r.*, case when r.doi is not null and d0.d0 is not null and r.seq >= d0.d0 then 'doi'
                     when r.tkey is not null then 'title' end as group_kind,
                case when r.doi is not null and d0.d0 is not null and r.seq >= d0.d0 then r.doi
                     when r.tkey is not null then r.tkey end as group_key
    from (select x.*, coalesce(t0.t0 < x.seq, false) as absorb
          from (select *, nullif(lower(coalesce(title, '')), '') as tkey from f_doc) x
          left join (select nullif(lower(coalesce(title, '')), '') as tkey, min(seq) as t0 from f_doc
                     where doi is null and nullif(lower(coalesce(title, '')), '') is not null group by 1) t0
          using (tkey)) r
    left join (select doi, min(seq) as d0 from (
                   select x.*, coalesce(t0.t0 < x.seq, false) as absorb
                   from (select *, nullif(lower(coalesce(title, '')), '') as tkey from f_doc) x
                   left join (select nullif(lower(coalesce(title, '')), '') as tkey, min(seq) as t0 from f_doc
                              where doi is null and nullif(lower(coalesce(title, '')), '') is not null
                              group by 1) t0 using (tkey)) y
               where doi is not null and not absorb group by 1) d0 using (doi)"""


def _clean_docs(spark, d):
    return B.clean_docs(spark, d)


@register("dedupe_group", with_views("""
    select seq, group_kind, group_key from g""", "f_doc", extra={"g": _GROUPS_SQL}))
def q_dedupe_group(spark, d):
    return DD.group_keys(_clean_docs(spark, d))


@register("dedupe_papers", with_views("""
    select group_kind, group_key, count(*) as group_size, arg_min(seq, seq) as seq,
           arg_min(struct_pack(v := doi), seq).v as doi, arg_min(struct_pack(v := title), seq).v as title,
           coalesce(arg_min(abstract, seq) filter (where coalesce(abstract, '') <> ''), arg_min(abstract, seq))
               as abstract
    from g where group_kind is not null group by 1, 2""", "f_doc", extra={"g": _GROUPS_SQL}))
def q_dedupe_papers(spark, d):
    return DD.dedupe_papers(_clean_docs(spark, d)).select("group_kind", "group_key", "group_size", "seq", "doi",
                                                          "title", "abstract")


_MERGE_SQL = """
    select g.group_kind, g.group_key, arg_min(a.name, g.seq * 100000 + a.pos) as name,
           arg_min(a.openalex_id, g.seq * 100000 + a.pos) as openalex_id,
           min(g.seq * 100000 + a.pos) as o
    from g join ca a on a.doc_id = g.seq
    where g.group_kind is not null
      and (g.group_kind, g.group_key) in (select group_kind, group_key from g where group_kind is not null
                                          group by 1, 2 having count(*) > 1)
    group by g.group_kind, g.group_key, coalesce(nullif(a.openalex_id, ''), lower(a.name))"""


@register("merge_authors", with_views("""
    select group_kind, group_key, o // 100000 as first_seq, cast(o % 100000 as int) as first_pos, name, openalex_id
    from m""", "f_doc", extra={"g": _GROUPS_SQL, "disp": _DISPLAY_SQL, "ca": _CLEAN_AUTHORS_SQL, "m": _MERGE_SQL}))
def q_merge_authors(spark, d):
    g = DD.dedupe_group(_clean_docs(spark, d)).filter(F.col("group_kind").isNotNull())
    return DD.merge_authors_long(g)


@register("dedupe_authors_text", with_views("""
    select s.group_kind, s.group_key,
           case when s.n > 1 then coalesce(m.txt, '') else coalesce(f.txt, '') end as authors_text
    from (select group_kind, group_key, count(*) as n, min(seq) as first_seq from g
          where group_kind is not null group by 1, 2) s
    left join (select group_kind, group_key, array_to_string(list(name order by o), ', ') as txt
               from m group by 1, 2) m using (group_kind, group_key)
    left join (select doc_id, array_to_string(list(name order by pos), ', ') as txt from ca group by 1) f
           on f.doc_id = s.first_seq""",
                                            "f_doc", extra={"g": _GROUPS_SQL, "disp": _DISPLAY_SQL,
                                                            "ca": _CLEAN_AUTHORS_SQL, "m": _MERGE_SQL}))
def q_dedupe_authors_text(spark, d):
    out = DD.dedupe_papers(_clean_docs(spark, d), with_authors=True)
    return out.select("group_kind", "group_key", "authors_text")


@register("dedupe_metrics", with_views("""
    select cast((select count(*) from f_doc) as bigint) as original_papers,
           cast(count(*) as bigint) as final_unique_papers, cast(coalesce(sum(n - 1), 0) as bigint) as duplicates_merged
    from (select group_kind, group_key, count(*) as n from g where group_kind is not null group by 1, 2) x""",
                                       "f_doc", extra={"g": _GROUPS_SQL}))
def q_dedupe_metrics(spark, d):
    return DD.dedupe_metrics(_clean_docs(spark, d))


# ------------------------------------------------------------------ topics

_RE_TOKEN = r"\b\w\w+\b"

_TERMS_SQL = {
    "td": f"""select coalesce(v.topic_id, -1) as topic_id, d.doc_id, {clean_text_sql('d.text')} as clean
              from documents d left join f_vec v on d.doc_id = v.vec_id""",
    "kept": f"""select topic_id, doc_id,
                       list_filter(regexp_extract_all(lower(clean), '{_RE_TOKEN}'),
                                   lambda t: not list_contains({stop_words_sql()}, t)) as k from td""",
    "terms": """select topic_id, term, count(*) as n
                from (select topic_id, unnest(list_concat(k, list_transform(range(1, len(k)),
                                                                         lambda i: k[i] || ' ' || k[i + 1]))) as term
                      from kept) x group by 1, 2""",
    "pc": "select topic_id, sum(n) as ct from terms group by 1",
    "aa": "select floor(avg(ct)) as a from pc",
    "pt": "select term, sum(n) as tt from terms group by 1",
    "sc": """select t.topic_id, t.term, t.n, t.n / pc.ct * ln(1 + aa.a / pt.tt) as score
             from terms t join pc using (topic_id) join pt using (term), aa""",
    "ids": "select distinct topic_id from f_vec where topic_id <> -1",
    "kw": """select ids.topic_id, coalesce(list_slice(top.k, 1, 15), cast([] as varchar[])) as keywords
             from ids left join (select topic_id, list(term order by score desc, term) as k from sc group by 1) top
             using (topic_id)""",
}


def _topic_text_docs(spark, d, tasks=None):
    # every document has a topic: that of its vector, else the outlier
    v = B.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "topic_id")
    docs = read(spark, d, "documents", "doc_id", "text")
    docs = (docs.repartition(tasks, "doc_id") if tasks else docs).join(v, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("topic_id", F.lit(X.OUTLIER_TOPIC_ID)).alias("topic_id"),
                       X.clean_text("text").alias("text"))


def topic_terms_of(spark, d):
    tasks = T.text_tasks(read(spark, d, "documents", "text"))
    return T.topic_terms(_topic_text_docs(spark, d, tasks), tasks=tasks)


def _keywords(spark, d):
    ids = B.vectors(spark, d).filter(F.col("topic_id") != -1).select("topic_id").distinct()
    return T.topic_keywords(topic_terms_of(spark, d), ids)


@register("topic_terms", with_views("select topic_id, term, n from terms", "f_vec", extra=_TERMS_SQL))
def q_topic_terms(spark, d):
    return topic_terms_of(spark, d)


@register("topic_keywords", with_views("select topic_id, keywords from kw", "f_vec", extra=_TERMS_SQL))
def q_topic_keywords(spark, d):
    return _keywords(spark, d)


@register("topic_diversity", with_views("""
    select coalesce(count(distinct w) / count(w), 0.0) as diversity
    from (select unnest(list_slice(keywords, 1, 15)) as w from kw) x""", "f_vec", extra=_TERMS_SQL))
def q_topic_diversity(spark, d):
    return T.topic_diversity(_keywords(spark, d))


@register("topic_labels", with_views("""
    select topic_id, coalesce(case when topic_id % 2 = 0 then 'Named topic ' || topic_id end,
                              array_to_string(list_slice(keywords, 1, 5), ', ')) as name,
           case when topic_id = -1 then 'Outlier / Noise'
                else 'Topic ' || topic_id || ': ' ||
                     coalesce(case when topic_id % 2 = 0 then 'Named topic ' || topic_id end,
                              array_to_string(list_slice(keywords, 1, 5), ', ')) end as cluster_label,
           keywords
    from kw""", "f_vec", extra=_TERMS_SQL))
def q_topic_labels(spark, d):
    kw = _keywords(spark, d)
    names = (kw.filter(F.col("topic_id") % 2 == 0)
             .select("topic_id", F.concat(F.lit("Named topic "), F.col("topic_id").cast("string")).alias("name")))
    return T.topic_labels(kw, names).select("topic_id", "name", "cluster_label", "keywords")


_REASSIGN_SQL = {
    "cent": """select topic_id, pos, avg(x) as m
               from (select topic_id, unnest(cast(embedding as double[])) as x,
                            generate_subscripts(embedding, 1) as pos from f_vec where topic_id <> -1) x
               group by 1, 2""",
    "cn": "select topic_id, sqrt(sum(m * m)) as cn from cent group by 1",
    "o": """select vec_id, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as pos
            from f_vec where topic_id = -1""",
    "onorm": "select vec_id, sqrt(sum(x * x)) as vn from o group by 1",
    "sims": """select d.vec_id, d.topic_id, d.dot / (n.vn * cn.cn) as s
               from (select o.vec_id, c.topic_id, sum(o.x * c.m) as dot from o join cent c using (pos)
                     group by 1, 2) d
               join onorm n using (vec_id) join cn using (topic_id)""",
    "best": """select vec_id, topic_id as best_topic, s
               from (select *, row_number() over (partition by vec_id order by s desc, topic_id) as rn from sims) r
               where rn = 1""",
}


def _reassign_sql(threshold: float) -> str:
    return with_views(f"""
    select v.vec_id, v.topic_id,
           case when v.topic_id = -1 and b.s >= {threshold} then b.best_topic else v.topic_id end as new_topic_id,
           case when v.topic_id = -1 then round(b.s, 6) end as best_similarity
    from f_vec v left join best b using (vec_id)""", "f_vec", extra=_REASSIGN_SQL)


@register("reassign_outliers", _reassign_sql(0.5))
def q_reassign_outliers(spark, d):
    return T.reassign_outliers(B.vectors(spark, d), 0.5)


@register("reassign_outliers_025", _reassign_sql(0.25))
def q_reassign_outliers_025(spark, d):
    return T.reassign_outliers(B.vectors(spark, d), 0.25)


_SOFT_SQL = dict(_TERMS_SQL)
_SOFT_SQL.update({
    "alld": f"""select doc_id, list_filter(regexp_extract_all(lower({clean_text_sql('text')}), '{_RE_TOKEN}'),
                                           lambda t: not list_contains({stop_words_sql()}, t)) as k
                from documents""",
    "dt": """select doc_id, term, count(*) as c
             from (select doc_id, unnest(list_concat(k, list_transform(range(1, len(k)),
                                                                    lambda i: k[i] || ' ' || k[i + 1]))) as term
                   from alld) x group by 1, 2""",
    "dl": "select doc_id, sum(c) as dl from dt group by 1",
    "idf": "select term, ln(1 + aa.a / pt.tt) as idf from pt, aa",
    "dvec": "select doc_id, term, c / dl * idf as w from dt join dl using (doc_id) join idf using (term)",
    "dn": "select doc_id, sqrt(sum(w * w)) as dn from dvec group by 1",
    "tsc": "select topic_id, term, score from sc where topic_id <> -1",
    "tn": "select topic_id, sqrt(sum(score * score)) as tn from tsc group by 1",
    "sims": """select doc_id, topic_id, dot / (dn * tn) as sim
               from (select doc_id, topic_id, sum(w * score) as dot from dvec join tsc using (term) group by 1, 2) x
               join dn using (doc_id) join tn using (topic_id)
               where dot / (dn * tn) >= 0.01""",
})


@register("soft_topics", with_views("""
    select doc_id, topic_id, round(sim / sum(sim) over (partition by doc_id), 6) as prob from sims""",
                                    "f_vec", extra=_SOFT_SQL))
def q_soft_topics(spark, d):
    docs = by_key(read(spark, d, "documents", "doc_id", "text"), "doc_id").select(
        "doc_id", X.clean_text("text").alias("text"))
    return T.soft_topics(docs, topic_terms_of(spark, d))


_WINDOW_SQL = {k: v for k, v in _SOFT_SQL.items() if k not in ("dt", "dl", "dvec", "dn", "sims")}
_WINDOW_SQL.update({
    "wt": """select doc_id, w, term, count(*) as c from (
               select doc_id, w, unnest(list_concat(k[w + 1:w + 4], list_transform(range(1, least(4, len(k) - w)),
                                                                                  lambda i: k[w + i] || ' ' || k[w + i + 1]))) as term
               from (select doc_id, k, unnest(range(0, greatest(len(k) - 4, 0) + 1)) as w from alld where len(k) > 0) x) y
             group by 1, 2, 3""",
    "wv": "select doc_id, w, term, c * idf as v from wt join idf using (term)",
    "wn": "select doc_id, w, sqrt(sum(v * v)) as wn from wv group by 1, 2",
    "wsims": """select doc_id, topic_id, sum(sim) as sim from (
                  select x.doc_id, x.topic_id, dot / (wn * tn) as sim
                  from (select doc_id, w, topic_id, sum(v * score) as dot from wv join tsc using (term) group by 1, 2, 3) x
                  join wn using (doc_id, w) join tn using (topic_id)) y
                where sim >= 0.01 group by 1, 2""",
})


@register("window_topics", with_views("""
    select doc_id, topic_id, round(sim / sum(sim) over (partition by doc_id), 6) as prob from wsims""",
                                      "f_vec", extra=_WINDOW_SQL))
def q_window_topics(spark, d):
    docs = by_key(read(spark, d, "documents", "doc_id", "text"), "doc_id").select(
        "doc_id", X.clean_text("text").alias("text"))
    return T.window_topics(docs, topic_terms_of(spark, d))


@register("multi_labels", with_views("select paper_id, predicted_multi_labels from f_interaction", *_NET_VIEWS))
def q_multi_labels(spark, d):
    return B.interactions(spark, d).select("paper_id", "predicted_multi_labels")


@register("label_parts", with_views("""
    select paper_id, cast(i as int) as i, label,
           case when strpos(label, ': ') > 0 then substr(label, strpos(label, ': ') + 2) else label end as name,
           try_cast(trim(replace(split_part(label, ':', 1), 'Topic ', '')) as int) as topic_id
    from (select paper_id, generate_subscripts(predicted_multi_labels, 1) - 1 as i,
                 unnest(predicted_multi_labels) as label from f_interaction) x""", *_NET_VIEWS))
def q_label_parts(spark, d):
    ex = B.interactions(spark, d).select("paper_id", F.posexplode("predicted_multi_labels").alias("i", "label"))
    return ex.select("paper_id", "i", "label", X.label_name("label").alias("name"),
                     X.label_topic_id("label").alias("topic_id"))


@register("normalise", with_views("""
    select vec_id, list_transform(e, lambda x: round(x / case when s = 0 then 1 else s end, 6)) as dist
    from (select vec_id, list_transform(cast(embedding as double[]), lambda x: abs(x)) as e,
                 list_sum(list_transform(cast(embedding as double[]), lambda x: abs(x))) as s from f_vec) x""",
                                  "f_vec"))
def q_normalise(spark, d):
    v = B.vectors(spark, d).select("vec_id", F.transform(F.col("embedding").cast("array<double>"),
                                                         lambda x: F.abs(x)).alias("e"))
    return v.select("vec_id", F.transform(T.normalise("e"), lambda x: F.round(x, 6)).alias("dist"))


@register("topic_docs", with_views(r"""
    select seq, regexp_replace(coalesce(title, '') || '. ' || coalesce(abstract, ''),
                               '^[\s\x0B\x1C-\x1F\x85\pZ]+|[\s\x0B\x1C-\x1F\x85\pZ]+$', '', 'g') as doc
    from f_doc
    where length(regexp_replace(coalesce(title, '') || '. ' || coalesce(abstract, ''),
                                '^[\s\x0B\x1C-\x1F\x85\pZ]+|[\s\x0B\x1C-\x1F\x85\pZ]+$', '', 'g')) >= 10""",
                                   "f_doc"))
def q_topic_docs(spark, d):
    return T.topic_docs(B.docs(spark, d)).select("seq", "doc")


@register("keep_tokens", f"""
    select doc_id, list_filter(regexp_extract_all(lower({clean_text_sql('text')}), '{_RE_TOKEN}'),
                               lambda t: not list_contains({stop_words_sql()}, t)
                                         and not regexp_full_match(t, '[0-9.,]+') and length(t) > 2) as tokens
    from documents""")
def q_keep_tokens(spark, d):
    docs = read(spark, d, "documents", "doc_id", "text").select("doc_id", X.clean_text("text").alias("text"))
    return T.keep_tokens(docs).select("doc_id", "tokens")


@register("assign_topics")
def q_assign_topics(spark, d):
    """T3 (rows only): Gaussian mixture over the document vectors."""
    v = B.vectors(spark, d)
    k = v.select(F.count_distinct("label")).first()[0]
    return T.assign_topics(v, k=int(k))


# ------------------------------------------------------------------- sinks

UPSERT_SQL = """
    select coalesce(b.paper_id, u.paper_id) as paper_id,
           case when u.paper_id is not null then u.title else b.title end as title,
           case when b.paper_id is not null then b.year else u.year end as year,
           case when u.paper_id is not null then u.citation_count else b.citation_count end as citation_count
    from (select paper_id, title, year, citation_count from f_paper where paper_id % 2 = 0) b
    full outer join (
        select paper_id, arg_max(title, seq) as title, arg_max(struct_pack(v := year), seq).v as year,
               arg_max(citation_count, seq) as citation_count
        from (select paper_id, upper(title) as title, cast(null as int) as year, citation_count + 1 as citation_count,
                     1 as seq from f_paper where paper_id % 3 = 0
              union all
              select paper_id, lower(title), cast(null as int), citation_count + 2, 2 from f_paper
              where paper_id % 6 = 0
              union all
              select paper_id, title, year, citation_count, 3 from f_paper where paper_id % 2 = 1 and paper_id % 3 <> 0) x
        group by 1) u on b.paper_id = u.paper_id"""


def upsert_inputs(spark, d):
    """(base, updates): the even ids, and a batch with the odd ones and changes to every sixth."""
    p = B.papers(spark, d).select("paper_id", "title", "year", "citation_count")
    k, no_year = F.col("paper_id"), F.lit(None).cast("int").alias("year")

    def change(rows, title, more, seq):
        return p.filter(rows).select("paper_id", title.alias("title"), no_year,
                                     (F.col("citation_count") + more).alias("citation_count"), F.lit(seq).alias("seq"))

    updates = (change(k % 3 == 0, F.upper("title"), 1, 1).unionByName(change(k % 6 == 0, F.lower("title"), 2, 2))
               .unionByName(p.filter((k % 2 == 1) & (k % 3 != 0)).withColumn("seq", F.lit(3))))
    return p.filter(k % 2 == 0), updates


@register("upsert", with_views(UPSERT_SQL, "f_paper"))
def q_upsert(spark, d):
    base, updates = upsert_inputs(spark, d)
    return U.upsert(base, updates, ["paper_id"], ["title", "citation_count"], order="seq")


@register("append_distinct", with_views("""
    select paper_id, author_id from f_paper_author where paper_id % 2 = 0
    union all
    select distinct paper_id, author_id from f_authorship a
    where not exists (select 1 from f_paper_author b
                      where b.paper_id % 2 = 0 and b.paper_id = a.paper_id and b.author_id = a.author_id)""",
                                        "f_paper_author", "f_authorship"))
def q_append_distinct(spark, d):
    base = B.paper_authors(spark, d).filter(F.col("paper_id") % 2 == 0)
    return U.append_distinct(base, B.authorships(spark, d).select("paper_id", "author_id"), ["paper_id", "author_id"])


# ------------------------------------------------ roster head, union, enrich

@register("head_by", with_views("""
    select seq, name, faculty from roster order by seq limit 10""", "f_author", extra={"roster": ROSTER_SQL}))
def q_head_by(spark, d):
    return I.head_by(B.roster(spark, d), 10).select("seq", "name", "faculty")


@register("union_works", """
    select l_suppkey as author, l_orderkey * 10 + l_linenumber as work_id from lineitem""")
def q_union_works(spark, d):
    w = _works(spark, d).select("author", "work_id")
    return I.union_works(w.filter(F.col("author") % 2 == 0), w.filter(F.col("author") % 2 == 1))


def _enrich_inputs(spark, d):
    """Every document's topic (the outlier without a vector), its cosine
    distribution over all topics, and the topic labels."""
    by_doc = T.centroid_distribution(B.vectors(spark, d)).select(F.col("vec_id").alias("seq"), "topic_id", "topic_distribution")
    assign = (read(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "seq").join(by_doc, "seq", "left")
              .select("seq", F.coalesce("topic_id", F.lit(X.OUTLIER_TOPIC_ID)).alias("cluster_id"),
                      F.coalesce("topic_distribution", F.array().cast("array<double>")).alias("topic_distribution")))
    kw = _keywords(spark, d)
    names = (kw.filter(F.col("topic_id") % 2 == 0)
             .select("topic_id", F.concat(F.lit("Named topic "), F.col("topic_id").cast("string")).alias("name")))
    return assign, T.topic_labels(kw, names)


@register("enrich", with_views("""
    select p.seq, a.cluster_id,
           case when a.cluster_id = -1 then 'Outlier / Noise' else 'Topic ' || a.cluster_id || ': ' || nm.m[a.cluster_id] end
               as cluster_label,
           case when a.cluster_id = -1 then ['Outlier / Noise']
                else list_concat(['Topic ' || a.cluster_id || ': ' || nm.m[a.cluster_id]],
                     list_transform(
                        list_filter(list_transform(a.dist, lambda p, i: struct_pack(i := i - 1, p := p)),
                                    lambda x: x.i <> a.cluster_id and x.p > 0.05 and x.p >= list_max(a.dist) * 0.3),
                        lambda x: 'Topic ' || x.i || ': ' || nm.m[cast(x.i as int)])) end as predicted_multi_labels,
           case when a.cluster_id = -1 then cast([] as varchar[]) else coalesce(list_slice(l.keywords, 1, 15), cast([] as varchar[])) end
               as topic_keywords,
           list_transform(a.dist, lambda x: round(x, 6)) as topic_distribution
    from f_doc p
    join (select d.seq, coalesce(v.topic_id, -1) as cluster_id, coalesce(x.dist, cast([] as double[])) as dist
          from f_doc d left join f_vec v on v.vec_id = d.seq
          left join (select vec_id, list_transform(e, lambda x: x / case when list_sum(e) = 0 then 1 else list_sum(e) end) as dist
                     from (select vec_id, list(greatest(coalesce(s, 0), 0) order by t) as e
                           from (select v.vec_id, t.t, c.s from f_vec v
                                 cross join (select unnest(range((select max(topic_id) + 1 from cn))) as t) t
                                 left join vc c on c.vec_id = v.vec_id and c.topic_id = t.t) y
                           group by 1) z) x on x.vec_id = d.seq) a using (seq)
    left join lab l on l.topic_id = a.cluster_id,
    (select map_from_entries(list(struct_pack(k := topic_id, v := name))) as m from lab) nm""",
                               "f_vec", "f_doc", extra=dict(_TERMS_SQL, cent=_REASSIGN_SQL["cent"], cn=_REASSIGN_SQL["cn"],
                                                            vc="""
    select o.vec_id, c.topic_id, sum(o.x * c.m) / any_value(cn.cn) as s
    from (select vec_id, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as pos from f_vec) o
    join cent c using (pos) join cn on cn.topic_id = c.topic_id group by 1, 2""", lab="""
    select topic_id, coalesce(case when topic_id % 2 = 0 then 'Named topic ' || topic_id end,
                              array_to_string(list_slice(keywords, 1, 5), ', ')) as name, keywords
    from kw""")))
def q_enrich(spark, d):
    assign, labels = _enrich_inputs(spark, d)
    papers = B.docs(spark, d).select("seq")
    out = T.enrich(papers, assign, labels)
    return out.select("seq", "cluster_id", "cluster_label", "predicted_multi_labels", "topic_keywords",
                      F.transform("topic_distribution", lambda x: F.round(x, 6)).alias("topic_distribution"))


# ------------------------------------------------------- the composed batch run

from scriptorium.plans import batch as BATCH  # noqa: E402

_BATCH_SQL = {
    "disp": _DISPLAY_SQL, "ca": _CLEAN_AUTHORS_SQL,
    "bc": f"""select doc_id as seq, md5(text) as doi,
                     {clean_text_sql("case when doc_id % 17 = 0 then '(No Title)' else split_part(text, chr(10), 1) end")}
                         as title,
                     case when doc_id % 4 = 0 then '' else {clean_text_sql('text')} end as abstract,
                     cast(2000 + doc_id % 25 as int) as year, source as venue, cast(n_chars % 100 as int) as citation_count
              from documents where doc_id % 3 <> 0""",
    "bg": """select doi, min(seq) as seq, count(*) as n,
                    coalesce(arg_min(abstract, seq) filter (where abstract <> ''), '') as abstract from bc group by 1""",
    "bp": r"""select * from (
                select g.seq, g.doi, c.title, g.abstract, c.year, c.venue, c.citation_count, g.n,
                       regexp_replace(c.title || '. ' || g.abstract, '^[\s\x0B\x1C-\x1F\x85\pZ]+|[\s\x0B\x1C-\x1F\x85\pZ]+$',
                                      '', 'g') as doc
                from bg g join bc c using (seq)) x where length(doc) >= 10""",
    "bas": """select g.seq, a.name, a.openalex_id, a.pos as o, coalesce(nullif(a.openalex_id, ''), lower(a.name)) as author_key
              from bp g join ca a on a.doc_id = g.seq where g.n = 1
              union all
              select g.seq, arg_min(a.name, c.seq * 100000 + a.pos), arg_min(struct_pack(v := a.openalex_id), c.seq * 100000 + a.pos).v,
                     min(c.seq * 100000 + a.pos), coalesce(nullif(a.openalex_id, ''), lower(a.name))
              from bp g join bc c using (doi) join ca a on a.doc_id = c.seq where g.n > 1
              group by g.seq, coalesce(nullif(a.openalex_id, ''), lower(a.name))""",
    **_REASSIGN_SQL,
    "ba": """select p.seq, p.doi, p.doc,
                    coalesce(case when v.topic_id = -1 and b.s >= 0.5 then b.best_topic else v.topic_id end, -1) as topic_id
             from bp p left join f_vec v on v.vec_id = p.seq left join best b on b.vec_id = p.seq""",
    "kept": f"""select topic_id, seq, list_filter(regexp_extract_all(lower(doc), '{_RE_TOKEN}'),
                                                   lambda t: not list_contains({stop_words_sql()}, t)) as k from ba""",
    **{k: v for k, v in _TERMS_SQL.items() if k in ("terms", "pc", "aa", "pt", "sc")},
    "ids": "select distinct topic_id from ba where topic_id <> -1",
    "kw": _TERMS_SQL["kw"],
}


def batch_sql(body: str) -> str:
    return with_views(body, "f_vec", "f_author", extra=_BATCH_SQL)


def _batch(spark, d):
    return BATCH.marts(BATCH.results(B.raw_works(spark, d), B.vectors(spark, d)), B.roster(spark, d), HOME)


@register("batch_paper_dim", batch_sql("""
    select doi, title, year, abstract, citation_count, venue, '' as url from bp"""))
def q_batch_paper_dim(spark, d):
    return _batch(spark, d).papers


@register("batch_topic_dim", batch_sql("""
    select t.topic_id, case when t.topic_id = -1 then 'Outlier / Noise'
                            else array_to_string(list_slice(k.keywords, 1, 5), ', ') end as name,
           coalesce(k.keywords, cast([] as varchar[])) as keywords
    from (select distinct topic_id from ba) t left join kw k using (topic_id)"""))
def q_batch_topic_dim(spark, d):
    return _batch(spark, d).topics


@register("batch_yearly_topic_stat", batch_sql("""
    select p.year, a.topic_id, count(*) as total_papers from bp p join ba a using (seq) group by 1, 2"""))
def q_batch_yearly_topic_stat(spark, d):
    return _batch(spark, d).yearly_topic_stat


@register("batch_author_dim", batch_sql(f"""
    select x.author_key, x.openalex_id, x.name, f.faculty,
           case when coalesce(f.faculty, '') <> '' then 'Home University' else 'External' end as institution,
           cast(null as varchar) as email
    from (select author_key, arg_min(name, seq * 1e9 + o) as name,
                 arg_min(struct_pack(v := openalex_id), seq * 1e9 + o).v as openalex_id from bas group by 1) x
    left join (select lower(name) as name_key, arg_max(faculty, seq) as faculty from ({ROSTER_SQL}) r group by 1) f
           on lower(x.name) = f.name_key"""))
def q_batch_author_dim(spark, d):
    return _batch(spark, d).authors


@register("batch_coauthor_edges", batch_sql("""
    select a.author_key as author_a, b.author_key as author_b, count(*) as weight
    from (select distinct seq, author_key from bas) a
    join (select distinct seq, author_key from bas) b on a.seq = b.seq and a.author_key < b.author_key group by 1, 2"""))
def q_batch_coauthor_edges(spark, d):
    return _batch(spark, d).coauthor_edges


@register("batch_interactions", batch_sql("select doi, topic_id as primary_topic_id from ba"))
def q_batch_interactions(spark, d):
    return _batch(spark, d).interactions.select("doi", "primary_topic_id")


from scriptorium import registry_stored  # noqa: E402,F401
