"""Substring search by the index against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import textindex as I
from scriptorium.sources.martset import MartSet


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["Deep", "deep-sea", "Öl", "straße", "neural net", "NET", "aaaa", "x", "", "100%_"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(3000)] + [(7, "twice"), (None, "no id deep"), (9000, None)]
    rows += [(10_000 + i, "aaaaaaaa common") for i in range(2500)]     # a text of nearly half the rows
    marts = MartSet(spark, str(tmp_path_factory.mktemp("index") / "marts"))
    I.build(marts, "t", spark.createDataFrame(rows, "id long, text string"), "id", "text")
    return marts, rows


@pytest.mark.parametrize("text", ["deep", "DEEP-SEA", "ep-s", "öl", "straße", "strasse", "t n", "aaaaa", "0%_", "nowhere", "x", "", "ne", "twice", "common"])
def test_equals_a_scan(index, text):
    marts, rows = index
    fold = lambda t: t.upper()
    want = sorted((i for i, t in rows if t is not None and fold(text) in fold(t)), key=repr)
    assert sorted((r["id"] for r in I.search(marts, "t", text).collect()), key=repr) == want


def test_rarest_first_and_blocks(index):
    marts, rows = index
    order = I.rarest(marts, "t", "deep-sea x")
    counts = {g: sum(g in t.upper() for _, t in rows if t) for g in order}
    assert [counts[g] for g in order] == sorted(counts.values())
    postings = marts.read("t_postings")
    assert postings.filter(F.col("n") > I.BLOCK).count() == 0
    assert postings.filter("gram = 'AAA'").count() > 2 and postings.groupBy("gram", "block").count().filter("count > 1").count() == 0


def test_reads_only_the_named_postings(index):
    marts, _ = index
    plan = I.candidates(marts, "t", ["SEA", "DEE"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,SEA)" in plan and "EqualTo(gram,DEE)" in plan and "CartesianProduct" not in plan


def test_empty(spark, tmp_path):
    marts = MartSet(spark, str(tmp_path / "marts"))
    I.build(marts, "t", spark.createDataFrame([], "id long, text string"), "id", "text")
    assert I.search(marts, "t", "abc").collect() == [] and I.search(marts, "t", "a").collect() == []
