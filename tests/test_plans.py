"""Paging, ordering, marts, network and plan-shape checks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.registry import SPARK
from scriptorium.registry_stored import STORED

from scriptorium.operators import marts as M
from scriptorium.operators import network as G
from scriptorium.plans import dashboard as D
from scriptorium.plans import papers as P

SF = "/root/testdata/sf0.001"


def test_page_clamp():
    assert [P.clamp_page(p, 25, 12).current_page for p in (1, 3, 9, 0, -1)] == [1, 3, 3, 3, 3]
    assert P.clamp_page(1, 25, 12).total_pages == 3
    empty = P.clamp_page(1, 0, 12)
    assert (empty.current_page, empty.total_pages, empty.has_next, empty.has_previous) == (1, 1, False, False)
    assert P.clamp_page("x", 25, 12).current_page == 1


def test_newest_nulls_first(spark):
    df = spark.createDataFrame([(1, None), (2, 2024), (3, 2023)], "paper_id long, year int")
    assert [r["paper_id"] for r in G.newest(df, 2).collect()] == [1, 2]


def test_external_includes_null(spark):
    df = spark.createDataFrame([(1, "Home"), (2, "External"), (3, None)], "author_id long, institution string")
    assert sorted(r["author_id"] for r in D.external(df, "Home").collect()) == [2, 3]


def test_network_external_needs_two_home_collaborators(spark):
    papers = spark.createDataFrame([(1, 2020), (2, 2021)], "paper_id long, year int")
    bridge = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (2, 11), (2, 31)], "paper_id long, author_id long")
    authors = spark.createDataFrame([(10, "h1", "Home", "F"), (20, "h2", "Home", "F"), (11, "h3", "Home", "F"),
                                     (30, "e1", None, None), (31, "e2", "External", None)],
                                    "author_id long, name string, institution string, faculty string")
    nodes, links, totals = G.author_network(papers, bridge, authors, "Home")
    ids = {r["id"]: r for r in nodes.collect()}
    assert set(ids) == {"10", "20", "11", "30"}
    assert ids["30"]["institution"] == "External" and ids["30"]["group"] == "External Partner"
    t = totals.first()
    assert (t["total_external_found"], t["qualified_external_count"]) == (2, 1)
    assert {(r["source"], r["target"]) for r in links.collect()} == {("10", "20"), ("10", "30"), ("20", "30")}


def test_marts_fixtures(spark):
    schema = ("seq long, doi string, title string, abstract string, "
              "authors_struct array<struct<name:string,openalex_id:string>>, year int, venue string, "
              "citation_count int, cluster_id int, cluster_label string, predicted_multi_labels array<string>, "
              "topic_keywords array<string>, topic_distribution array<double>")
    rows = [(0, "d0", "t", "", [("Ann Lee", None), ("Bo", None), ("Cy", None)], 2020, None, 7, 3, "Topic 3: A: B",
             [], ["k"], []),
            (1, "d1", "t", "", [], None, None, 1, 3, "Topic 3: A: B", [], ["k"], []),
            (2, "d2", "t", "", [], 0, None, 1, 3, "Topic 3: A: B", [], ["k"], [])]
    results = spark.createDataFrame(rows, schema)
    roster = spark.createDataFrame([(0, "ANN LEE", "F1"), (1, "bo", "F2"), (2, "cy", "F1")],
                                   "seq long, name string, faculty string")
    authors = M.author_dim(results, roster, "Home")
    inst = {r["name"]: (r["faculty"], r["institution"]) for r in authors.collect()}
    assert inst["Ann Lee"] == ("F1", "Home")
    fts = {r["faculty"]: (r["total_papers"], r["total_citations"]) for r in M.faculty_topic_stat(results, authors).collect()}
    assert fts == {"F1": (1, 7), "F2": (1, 7)}
    ys = M.yearly_topic_stat(results).collect()
    assert [(r["year"], r["total_papers"]) for r in ys] == [(2020, 1)]
    assert M.topic_dim(results).first()["name"] == "A: B"


def test_domain_trends_zero_fill(spark):
    stat = spark.createDataFrame([(2020, 0, 1), (2021, 1, 2)], "year int, topic_id int, total_papers long")
    topic = spark.createDataFrame([(0, "A", []), (1, "B", [])], "topic_id int, name string, keywords array<string>")
    rows = [r.asDict() for r in D.domain_trends(stat, topic).collect()]
    assert rows == [{"year": "2020", "A": 1, "B": 0}, {"year": "2021", "A": 0, "B": 2}]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(SPARK) - STORED))
def test_plan_has_no_python_udf_or_cartesian(spark, name):
    plan = _plan(SPARK[name](spark, SF))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["dedupe_papers", "dedupe_group", "topic_dim", "paper_dim", "author_dim", "interactions", "upsert"])
def test_picks_are_hash_aggregates(spark, name):
    """No full record, text included, is sorted for a first or last pick."""
    import re
    plan = _plan(SPARK[name](spark, SF))
    for line in plan.splitlines():
        if "SortAggregate" in line:  # arrays of a paper's authors or shares are gathered; picks are not
            assert not re.search(r"(min|max)_by", line), line
    if name.startswith("dedupe"):
        assert "SortAggregate" not in plan.split("== Initial Plan ==")[0] or "authors" in plan


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "id" in df.columns


def test_pair_blocks_equal_plain_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_BLOCK", 7)
    rows = [(1, a) for a in range(40)] + [(2, a) for a in (3, 5)] + [(3, 9)]
    got = G.author_pairs(spark.createDataFrame(rows, "paper_id long, author_id long"))
    pairs = sorted(tuple(r) for r in got.collect())
    assert pairs == sorted([(1, a, b) for a in range(40) for b in range(a + 1, 40)] + [(2, 3, 5)])


def test_one_huge_author_list_is_many_tasks(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("paper_id"), F.col("id").alias("author_id"))
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
              "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        per_task = (G.author_pairs(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
                    .agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("tasks")).first())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert per_task["all"] == 5000 * 4999 // 2
    assert per_task["tasks"] > 10 and per_task["most"] < per_task["all"] / 4


def test_deep_page_gathers_little(spark, monkeypatch):
    monkeypatch.setattr(P, "SEEK_ROWS", 20)
    monkeypatch.setattr(P, "SEEK_BINS", 8)
    rows = [(i, (None, 2000 + i % 7)[i % 11 > 0], (None, i * 37 % 50)[i % 5 > 0]) for i in range(1000)]
    df = spark.createDataFrame(rows, "paper_id long, year int, citation_count int")
    want = [r["paper_id"] for r in P.card_order(df).collect()]
    for number in (1, 2, 17, 50, 83, 84, 9999, -1):
        got, info = P.page(df, number, 12)
        at = (info.current_page - 1) * 12
        assert [r["paper_id"] for r in got.collect()] == want[at:at + 12], number
    _, skip = P.seek(df, 700)
    assert skip <= 20


def test_array_walks_are_linear(spark):
    """4,000 elements cost about 4 times 1,000, not 16 times."""
    import time
    from scriptorium.operators import topics as T

    def seconds(n):
        df = (spark.range(60).select(F.lit(0).alias("cluster_id"), F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda i: (i % 13).cast("double")).alias("topic_distribution")))
        names = spark.range(1).select(F.lit(0).alias("topic_id"), F.lit("a").alias("name"))
        out = T.multi_labels(df.withColumn("topic_distribution", T.normalise("topic_distribution")), names)
        best = 1e9
        for _ in range(2):
            t = time.time()
            out.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - t)
        return best

    seconds(100)
    assert seconds(8000) < 10 * seconds(2000) + 1


@pytest.mark.parametrize("name", ["dedupe_papers", "network_links", "topic_keywords", "author_profile"])
def test_same_result_at_1_and_64_shuffle_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "64"):
            spark.catalog.clearCache()
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = SPARK[name](spark, "/root/testdata/sf0.01")
            out.append(sorted(repr(tuple(r)) for r in df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and out[0]


def test_home_first_buckets_match_plain_ranking(spark):
    import random
    rng = random.Random(3)
    rows = []
    for paper in range(5):
        for i in range(rng.randint(1, 15)):
            rows.append((paper, rng.randint(0, 9), 100 + i, f"n{i}", rng.choice(["Home", "External", None])))
    df = spark.createDataFrame(rows, "paper_id long, pos int, author_id long, name string, institution string")
    got = {(r["paper_id"], r["author_id"]): r["display_pos"] for r in P.home_first(df, "Home", bucket=2).collect()}
    want = {}
    for paper in range(5):
        mine = sorted((r for r in rows if r[0] == paper), key=lambda r: (r[4] != "Home", r[1], r[2]))
        for i, r in enumerate(mine):
            want[(paper, r[2])] = i
    assert got == want


def test_pair_tasks_follow_the_rows(spark):
    """A bridge with more rows than the session's partitions should hold gets more tasks, none more rows."""
    rows = spark.range(4000).select((F.col("id") % 1000).alias("paper_id"), F.col("id").alias("author_id"))
    from scriptorium import session
    assert session.dealt(rows, 4000, "paper_id", task_rows=100).rdd.getNumPartitions() == 40
    assert session.dealt(rows, 700, "paper_id", task_rows=100).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    few = G.author_pairs(rows)
    many = G.author_pairs(rows, rows_in=40 * session.TASK_ROWS)
    assert many.rdd.getNumPartitions() == 40 and sorted(many.collect()) == sorted(few.collect())


def test_edge_tasks_follow_the_pairs(spark):
    """A paper of many authors holds most pairs: 5,000 rows, 12.5 million pairs."""
    from scriptorium.session import TASK_ROWS
    bridge = spark.range(5000).select(F.lit("p").alias("paper_id"), F.col("id").cast("string").alias("author_id"))
    rows = bridge.unionByName(bridge.limit(3)).unionByName(spark.sql("select 'q' as paper_id, '1' as author_id"))
    assert G.pair_counts(bridge) == (5000, 12_497_500) and G.pair_counts(bridge.limit(0)) == (0, 0)
    plan = G.coauthor_edges(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert f", {-(-12_497_500 // TASK_ROWS)}" in plan.split("RepartitionByExpression")[1].splitlines()[0]


def test_edges_of_many_pairs_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_BLOCK", 50)
    monkeypatch.setattr(G.dealt, "__kwdefaults__", {"task_rows": 100})
    lists = {1: range(130), 2: range(100, 160), 3: (1, 2), 4: (7,)}
    rows = [(p, a) for p, x in lists.items() for a in x]
    got = {(r.author_a, r.author_b): r.weight for r in G.coauthor_edges(spark.createDataFrame(rows + rows[:9], "paper_id long, author_id long")).collect()}
    assert got == Counter((a, b) for x in lists.values() for a in x for b in x if a < b)
