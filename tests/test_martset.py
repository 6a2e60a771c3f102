"""S4 as one commit, and S5 as a merge of files."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import filemerge as FM
from scriptorium.operators import upsert as U
from scriptorium.sources.martset import Conflict, MartSet

TABLES = ["topics", "papers", "authors", "paper_authors", "interactions", "faculty_topic_stat", "yearly_topic_stat", "coauthor_edges"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broken", [0, 3, 7])
def test_a_failure_between_writes_leaves_the_old_set(spark, tmp_path, broken):
    marts = MartSet(spark, str(tmp_path / "marts"))
    assert marts.latest() == 0
    assert marts.refresh({t: spark.range(i + 1) for i, t in enumerate(TABLES)}) == 1
    new = {t: spark.range(100) for t in TABLES}
    new[TABLES[broken]] = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        marts.refresh(new)
    again = MartSet(spark, str(tmp_path / "marts"))
    assert again.latest() == 1
    assert [again.read(t).count() for t in TABLES] == list(range(1, 9))


def test_commits_conflicts_and_old_readers(spark, tmp_path):
    marts = MartSet(spark, str(tmp_path / "marts"))
    marts.refresh({"a": spark.range(3), "b": spark.range(5)})
    old = marts.read("a", 1)
    assert marts.refresh({"a": spark.range(7)}, keep_others=True) == 2
    assert (old.count(), marts.read("a").count(), marts.read("b").count()) == (3, 7, 5)
    with pytest.raises(Conflict):
        marts.refresh({"a": spark.range(1)}, start=1)
    with pytest.raises(Conflict):       # the other writer came between the check and the rename
        marts._put("{}", f"{marts.root}/_manifests/{2:012d}.json")
    assert marts.append({"b": spark.range(2), "c": spark.range(1)}) == 3
    assert (marts.read("b").count(), marts.read("c").count(), marts.read("b", 2).count()) == (7, 1, 5)
    assert len(marts.vacuum(keep=1, min_age_s=0)) == 2   # the first a, and that of the conflict
    assert marts.numbers() == [3] and marts.read("b").count() == 7 and marts.read("a").count() == 7
    with pytest.raises(KeyError):
        marts.read("nothing")


def test_the_batch_run_writes_through_it(spark, tmp_path):
    from scriptorium.plans import batch
    from scriptorium.sources import bindings as B
    d = "/root/testdata/sf0.001"
    marts = MartSet(spark, str(tmp_path / "marts"))
    assert batch.run(B.raw_works(spark, d), B.vectors(spark, d), B.roster(spark, d), "Home University", marts) == 1
    assert {*TABLES, "rejected"} == set(marts.manifest())
    assert "last_updated" in marts.read("faculty_topic_stat").columns
    dois = marts.read("papers").select("doi")
    assert dois.count() > 0 and marts.read("paper_authors").join(dois, "doi", "left_anti").count() == 0


SCHEMA = "k long, title string, year int, c int"


def test_merge_equals_upsert_and_keeps_other_files(spark, tmp_path):
    rng = random.Random(5)
    base = spark.createDataFrame([(i * 3, f"t{i}", 2000 + i % 20, i) for i in range(3000)] + [(None, "n", 1, 1)], SCHEMA)
    marts = MartSet(spark, str(tmp_path / "marts"))
    FM.create(marts, "papers", base, ["k"], files=16)
    want = base
    assert rows_of(marts.read("papers")) == rows_of(base)
    assert FM.files_of(marts, "papers").count() > 1
    for turn in range(3):
        low = rng.randrange(6000)       # a batch of near keys: known, unknown, repeated, equal in order
        keys = [rng.randrange(low, low + 300) for _ in range(60)] + ([None, 20_000 + turn] if turn else [])
        upd = spark.createDataFrame([(k, f"u{turn}-{j}", 1900, j, j // 2) for j, k in enumerate(keys)], SCHEMA + ", seq int")
        before = {r.file for r in FM.files_of(marts, "papers").collect()}
        hit = {r.file for r in FM.touched(FM.files_of(marts, "papers"), upd, ["k"]).collect()}
        want = U.upsert(want, upd, ["k"], ["title", "c"], order="seq")
        number = FM.merge(marts, "papers", upd, ["title", "c"], order="seq")
        after = {r.file for r in FM.files_of(marts, "papers", number).collect()}
        assert before - after == hit and len(hit) < len(before)
        assert rows_of(marts.read("papers")) == rows_of(want)


def test_merge_by_two_keys_and_only_new_keys(spark, tmp_path):
    schema = "a string, b int, v int"
    base = spark.createDataFrame([(f"x{i}", i % 7, i) for i in range(500)], schema)
    marts = MartSet(spark, str(tmp_path / "marts"))
    FM.create(marts, "t", base, ["a", "b"], files=8)
    files = {r.file for r in FM.files_of(marts, "t").collect()}
    FM.merge(marts, "t", spark.createDataFrame([("new", 1, 9), ("x3", 3, -1)], schema), ["v"])
    got = {(r.a, r.b): r.v for r in marts.read("t").collect()}
    assert len(got) == 501 and got["new", 1] == 9 and got["x3", 3] == -1 and got["x4", 4] == 4
    assert len(files - {r.file for r in FM.files_of(marts, "t").collect()}) <= 2
    FM.merge(marts, "t", spark.createDataFrame([], schema), ["v"])
    assert marts.read("t").count() == 501


def test_filter_has_every_key(spark, tmp_path):
    base = spark.createDataFrame([(i * 7919 % 100_003, "t", 1, 1) for i in range(2000)], SCHEMA)
    marts = MartSet(spark, str(tmp_path / "marts"))
    FM.create(marts, "t", base, ["k"], files=8)
    index = FM.files_of(marts, "t")
    assert FM.touched(index, base, ["k"]).count() == index.count()
    other = spark.createDataFrame([(200_000 + i,) for i in range(50)], "k long")
    assert FM.touched(index, other, ["k"]).count() == 0
