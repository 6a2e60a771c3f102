"""DuckDB oracle SQL for the registered queries.

Each oracle is an independent SQL statement over the raw test tables: the
bindings are restated as CTEs (the same definitions as
``scriptorium.sources.bindings``, written in DuckDB's dialect) and composed
with their dependencies by ``with_views``.
"""

from __future__ import annotations

from scriptorium.functions.stopwords import ENGLISH_STOP_WORDS
from scriptorium.operators.topics import ACADEMIC_STOP_WORDS

HOME = "Home University"

# name -> (dependencies, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f_author": ((), f"""
        select s_suppkey as author_id, s_name as name,
               case when n_regionkey = 1 then n_name end as faculty,
               case when n_regionkey = 1 then '{HOME}' when s_suppkey % 5 = 0 then null
                    else 'External' end as institution
        from supplier join nation on s_nationkey = n_nationkey"""),
    "f_paper": ((), """
        select o_orderkey as paper_id, concat('10.1/', o_orderkey) as doi,
               concat(o_orderpriority, ' order ', o_orderkey) as title,
               case when o_orderkey % 97 = 0 then null else cast(year(o_orderdate) as int) end as year,
               cast(floor(o_totalprice / 1000) as int) as citation_count
        from orders"""),
    "f_authorship": ((), """
        select l_orderkey as paper_id, l_suppkey as author_id, l_linenumber as pos from lineitem"""),
    "f_paper_author": (("f_authorship",), """
        select distinct paper_id, author_id from f_authorship"""),
    "f_share": ((), """
        select paper_id, topic_id, q / sum(q) over (partition by paper_id) as share
        from (select l_orderkey as paper_id, cast(substr(p_brand, 7) as int) - 1 as topic_id,
                     sum(l_quantity) as q
              from lineitem join part on l_partkey = p_partkey group by 1, 2) s"""),
    "f_pt": (("f_share",), """
        select r.paper_id, case when r.share < 0.3 then -1 else r.topic_id end as topic_id, r.share,
               list_transform(range((select max(cast(substr(p_brand, 7) as int)) from part)), lambda i: coalesce(m.m[cast(i as int)], 0.0::double))
                   as topic_distribution
        from (select *, row_number() over (partition by paper_id order by share desc, topic_id) as rn
              from f_share) r
        join (select paper_id, map_from_entries(list(struct_pack(k := topic_id, v := share))) as m
              from f_share group by 1) m on m.paper_id = r.paper_id
        where r.rn = 1"""),
    "f_topic": ((), """
        select topic_id, name, keywords from (
            select cast(substr(p_brand, 7) as int) - 1 as topic_id, p_brand as name,
                   list_slice(list(term order by score desc, term), 1, 15) as keywords
            from (select p_brand, term, cast(count(*) as double) as score
                  from (select p_brand, unnest(string_split(p_name, ' ')) as term from part) w
                  group by 1, 2) c
            group by 1, 2)
        union all select -1, 'Outlier / Noise', cast([] as varchar[])"""),
    "f_names": (("f_topic",), """
        select map_from_entries(list(struct_pack(k := topic_id, v := name))) as m from f_topic"""),
    "f_interaction": (("f_pt", "f_names"), """
        select paper_id, topic_id as primary_topic_id, topic_distribution,
               case when topic_id = -1 then ['Outlier / Noise']
                    else list_concat(['Topic ' || topic_id || ': ' || n.m[topic_id]],
                         list_transform(
                            list_filter(list_transform(topic_distribution, lambda p, i: struct_pack(i := i - 1, p := p)),
                                        lambda x: x.i <> topic_id and x.p > 0.05
                                                  and x.p >= list_max(topic_distribution) * 0.3),
                            lambda x: 'Topic ' || x.i || ': ' || n.m[cast(x.i as int)]))
               end as predicted_multi_labels
        from f_pt, f_names n"""),
    "f_doc": ((), """
        select doc_id as seq, case when doc_id % 3 = 0 then null else md5(text) end as doi,
               split_part(text, chr(10), 1) as title,
               case when doc_id % 4 = 0 then '' else text end as abstract, source, lang
        from documents"""),
    "f_vec": ((), """
        select vec_id, embedding, label, case when vec_id % 10 = 0 then -1 else label end as topic_id
        from embeddings"""),
}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs ``names`` and everything they depend on,
    then the ``extra`` CTEs (in order), which may use them."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as ({VIEWS[n][1]}\n)" for n in order]
    parts += [f"{n} as ({body}\n)" for n, body in (extra or {}).items()]
    if not parts:
        return sql
    return "with " + ",\n".join(parts) + "\n" + sql


def clean_text_sql(c: str) -> str:
    """X1 in DuckDB's dialect (RE2: '.' already stops only at '\\n'; \\s lacks
    \\x0B and \\x1C-\\x1F, so they are listed)."""
    return (f"coalesce(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({c}, "
            f"'<.*?>', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F]+', ' ', 'g')), "
            f"' +([.,;:?!])', '\\1', 'g'), '')")


def stop_words_sql() -> str:
    words = sorted(set(ENGLISH_STOP_WORDS) | set(ACADEMIC_STOP_WORDS))
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
