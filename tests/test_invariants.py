
from pyspark.sql import functions as F

from scriptorium.operators import marts as M
from scriptorium.operators import network as G
from scriptorium.plans import papers as P
from scriptorium.sources import bindings as B

SF = "/root/testdata/sf0.001"
HOME = B.HOME_INSTITUTION


def test_edges_ordered_and_bridge_unique(spark):
    edges = G.coauthor_edges(B.paper_authors(spark, SF))
    assert edges.filter(F.col("author_a") >= F.col("author_b")).count() == 0
    bridge = M.paper_authors(B.results(spark, SF))
    assert bridge.count() == bridge.dropDuplicates(["doi", "author_key"]).count()


def test_labels_start_with_primary(spark):
    r = B.results(spark, SF).filter(F.col("cluster_id").isNotNull())
    bad = r.filter(F.element_at("predicted_multi_labels", 1) != F.col("cluster_label"))
    assert r.count() > 0 and bad.count() == 0


def test_distributions_sum_to_one(spark):
    pt = B.paper_topics(spark, SF)
    sums = pt.select(F.aggregate("topic_distribution", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_pages_add_up_to_total(spark):
    args = (B.papers(spark, SF), B.paper_authors(spark, SF), B.authors(spark, SF),
            B.interactions(spark, SF), B.topics(spark, SF))
    first, info = P.paper_cards(*args, number=1, size=500)
    seen = set()
    for n in range(1, info.total_pages + 1):
        page, _ = P.paper_cards(*args, number=n, size=500)
        ids = [r["id"] for r in page.collect()]
        assert len(ids) <= 500
        seen.update(ids)
    assert len(seen) == info.total_items
