"""The inverted index of a document and the abstract rebuilt from it."""

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.sources import bindings as B

ROWS = [(1, "a b a  c b a"), (2, None), (3, ""), (5, "x"), (7, "one two"), (7, "two two one"), (None, "lost words")]


def _documents(spark, folder):
    df = spark.createDataFrame([(k, t, "s", 7) for k, t in ROWS], "doc_id long, text string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, 1, 2), (5, 2, 1)], "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "S#1"), (2, "S#2")], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_index_groups_positions_by_word_without_a_row_a_token(spark, tmp_path):
    out = B.inverted_index(spark, _documents(spark, tmp_path))
    got = {r["doc_id"]: r["abstract_inverted_index"] for r in out.collect()}
    assert got == {1: {"a": [0, 2, 6], "b": [1, 5], "": [3], "c": [4]}, 3: {"": [0]},
                   5: {"x": [0]}, 7: {"one": [0, 2], "two": [0, 1, 1]}, None: {"lost": [0], "words": [1]}}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_raw_works_carry_the_index_of_their_id(spark, tmp_path):
    out = B.raw_works(spark, _documents(spark, tmp_path))
    got = sorted((r["seq"] is None, r["seq"] or 0, r["abstract_inverted_index"], len(r["authorships"])) for r in out.filter("seq in (1, 2, 5) or seq is null").collect())
    assert got == [(False, 1, {"a": [0, 2, 6], "b": [1, 5], "": [3], "c": [4]}, 0), (False, 2, None, 0), (False, 5, {"x": [0]}, 2), (True, 0, None, 0)]
    both = out.filter("seq = 7").collect()
    assert [r["abstract_inverted_index"] for r in both] == [{"one": [0, 2], "two": [0, 1, 1]}] * 2


def test_rebuild_takes_the_later_word_of_a_position(spark):
    df = spark.sql("select map('b', array(1, 3), 'a', array(0), 'c', array(1)) as m union all select cast(null as map<string, array<int>>)")
    assert sorted(r["t"] for r in df.select(X.rebuild_abstract("m").alias("t")).collect()) == ["", "a c b"]


def test_a_value_used_often_is_made_once(spark):
    df = spark.range(1).select(X.once(F.array(F.lit(3), F.lit(1)), lambda a: F.size(a) + F.get(a, F.lit(0))).alias("v"))
    assert df.first()["v"] == 5
