"""Pages of the stored index against the counted ones."""

import random

import pytest

from scriptorium.plans import pageindex as PI
from scriptorium.plans import papers as P
from scriptorium.sources.martset import MartSet


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 2020, 2021, 2022]), rng.choice([None, 0, 5, 7])) for i in range(500)]
    papers = spark.createDataFrame(rows, "paper_id long, year int, citation_count int")
    marts = MartSet(spark, str(tmp_path_factory.mktemp("pages") / "marts"))
    marts.refresh({"other": spark.range(3)})
    PI.build(marts, papers, depth=64)
    return marts, papers


@pytest.mark.parametrize("number, size", [(1, 12), (2, 12), (6, 12), (42, 12), (99, 12), (0, 12), ("x", 12), (1, 200), (2, 64), (3, 500)])
def test_equals_the_counted_page(stored, number, size):
    marts, papers = stored
    want, info = P.page(papers, number, size)
    got, found = PI.page(marts, number, size)
    assert found == info
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_reads_the_runs_of_the_page_only(stored):
    marts, _ = stored
    plan = PI.page(marts, 6, 12)[0]._jdf.queryExecution().executedPlan().toString()
    assert "In(run, [0,1])" in plan.replace("`", "") and "GreaterThanOrEqual(place,60)" in plan
    assert marts.read("other").count() == 3


def test_empty(spark, tmp_path):
    marts = MartSet(spark, str(tmp_path / "marts"))
    PI.build(marts, spark.createDataFrame([], "paper_id long, year int, citation_count int"))
    rows, info = PI.page(marts, 3, 12)
    assert rows.collect() == [] and (info.current_page, info.total_items) == (1, 0)
