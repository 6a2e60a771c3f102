"""Batches against one full run: dedupe by arrival, statistics by signed deltas."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import arrivals as A
from scriptorium.operators import dedupe as DD
from scriptorium.operators import deltas as D
from scriptorium.operators import filemerge as FM
from scriptorium.operators import marts as M
from scriptorium.operators import network as G
from scriptorium.operators import upsert as U
from scriptorium.sources.martset import MartSet

RECORD = "seq long, doi string, title string, abstract string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", *(f"d{j}" for j in range(9))]), rng.choice(["", None, "Alpha", "alpha", "Beta", "GAMMA", "delta"]),
             rng.choice(["", None, f"text {i}"])) for i in range(90)]
    whole = spark.createDataFrame(rows, RECORD)
    registry = A.PaperRegistry(MartSet(spark, str(tmp_path / "marts")))
    cuts = [0, *sorted(rng.sample(range(1, 90), 2)), 90]
    got = []
    for lo, hi in zip(cuts, cuts[1:]):
        got += [tuple(r) for r in registry.arrive(whole.filter((F.col("seq") >= lo) & (F.col("seq") < hi))).collect()]
    assert sorted(got, key=repr) == rows_of(DD.group_keys(whole), "seq", "group_kind", "group_key")
    columns = ("group_kind", "group_key", "group_size", "seq", "doi", "title", "abstract")
    assert rows_of(registry.survivors(), *columns) == rows_of(DD.dedupe_papers(whole), *columns)
    number = registry.set.latest()
    with pytest.raises(ValueError):
        registry.arrive(whole.filter("seq >= 80"))      # taken before
    assert registry.arrive(whole.limit(0)).collect() == [] and registry.set.latest() == number


RESULT = ("seq long, doi string, authors_struct array<struct<name:string,openalex_id:string>>, year int, citation_count int, "
          "cluster_id int, cluster_label string")


def results(spark, rng, seqs):
    names = [f"P{i}" for i in range(8)]
    rows = [(s, rng.choice([None, *(f"d{j}" for j in range(25))]), [(n, None) for n in rng.choices(names, k=rng.randint(0, 4))],
             rng.choice([None, 0, 2020, 2021]), rng.choice([None, 0, 3, 7]), rng.choice([None, -1, 0, 1]), None) for s in seqs]
    return spark.createDataFrame(rows, RESULT)


def test_deltas_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    authors = spark.createDataFrame([(f"p{i}", ["F", "G", "", None][i % 4]) for i in range(8)], "author_key string, faculty string")
    marts = MartSet(spark, str(tmp_path / "marts"))
    marts.refresh({"other": spark.range(2)})
    D.start(marts, results(spark, rng, range(30)), authors)
    for turn in range(2):
        batch = results(
            spark, rng, range(100 * (turn + 1), 100 * (turn + 1) + 20))
        D.apply(marts, batch, authors)
        if turn:
            D.apply(marts, batch, authors)      # twice is as once
        kept = marts.read("results")
        assert kept.count() == kept.select("doi").distinct().count()
        want = D.contributions(kept, authors)
        for name, (keys, sums) in D.SUMS.items():
            assert rows_of(marts.read(name), *keys, *sums) == rows_of(want[name], *keys, *sums), name
    before = {name: rows_of(marts.read(name), *keys, *sums) for name, (keys, sums) in D.SUMS.items()}
    D.rebuild(marts, authors)
    assert before == {name: rows_of(marts.read(name), *keys, *sums) for name, (keys, sums) in D.SUMS.items()}
    assert marts.read("other").count() == 2
    assert M.yearly_topic_stat(marts.read("results")).count() > 0


def test_a_batch_asks_for_its_files_once(spark, tmp_path, monkeypatch):
    """The files of a batch are looked for once a commit, by few keys if these find all files, and
    rows of keys that come once aren't compared with others."""
    rows = [(s, f"d{s}", [("P1", None), ("P2", None)], 2020, 1, s % 3, None) for s in range(600)]
    papers = spark.createDataFrame(rows, RESULT)
    authors = spark.createDataFrame([("p1", "F"), ("p2", "G")], "author_key string, faculty string")
    marts = MartSet(spark, str(tmp_path / "marts"))
    D.start(marts, papers, authors)
    asked, touched, probes = [], FM.touched, FM._probes

    def counted(index, batch, keys):
        asked.append([])
        monkeypatch.setattr(FM, "_probes", lambda df, *a: asked[-1].append(df.count()) or probes(df, *a))
        found = touched(index, batch, keys)
        monkeypatch.setattr(FM, "_probes", probes)
        return found

    monkeypatch.setattr(FM, "touched", counted)
    D.apply(marts, papers.withColumn("year", F.col("year") + 1), authors)
    assert len(asked) == 1 and sum(asked[0]) < 600
    assert rows_of(marts.read("yearly_topic_stat"), "year", "topic_id", "total_papers") == [(2021, t, 200) for t in range(3)]
    assert rows_of(marts.read("coauthor_edges"), "author_a", "author_b", "weight") == [("p1", "p2", 600)]


def test_one_row_a_key_with_null_keys_and_ties(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", None), (3, "e", 5), (3, "e", 5), (None, "x", 1), (None, "y", 2), (4, None, 1)]
    got = U.one_per_key(spark.createDataFrame(rows, "k long, v string, o int"), ["k"], "o")
    assert rows_of(got, "k", "v") == sorted([(1, "b"), (2, "c"), (3, "e"), (None, "y"), (4, None)], key=repr)


def test_pairs_of_small_and_large_papers(spark, monkeypatch):
    """Papers within a block pair in a row, others by blocks; repeated rows and nulls count as in a self-join."""
    monkeypatch.setattr(G, "PAIR_BLOCK", 4)
    rows = [(1, f"a{i}") for i in range(9)] + [(2, "b"), (2, "a"), (2, "a"), (2, None), (3, "z"), (None, "p"), (None, "q")]
    bridge = spark.createDataFrame(rows, "paper_id long, author_id string")
    want = sorted((p, x, y) for p, x in rows for q, y in rows if p is not None and p == q and x and y and x < y)
    pairs = G.author_pairs(bridge)
    assert rows_of(pairs, "paper_id", "a", "b") == sorted(want, key=repr)
    small = G.author_pairs(bridge.filter("paper_id = 2"))
    assert "_l" in small._jdf.queryExecution().optimizedPlan().toString()
