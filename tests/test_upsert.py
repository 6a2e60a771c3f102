"""S5 upsert and S6 append-distinct semantics."""

from scriptorium.operators import upsert as U


def test_upsert_updates_listed_columns_and_inserts_new_keys(spark):
    base = spark.createDataFrame([(1, "a", 2000, 5), (2, "b", 2001, 6)], "k long, title string, year int, c int")
    upd = spark.createDataFrame([(2, "B1", None, 7, 1), (2, "B2", None, 8, 2), (3, "C", 2003, 9, 1)],
                                "k long, title string, year int, c int, seq int")
    out = {r["k"]: (r["title"], r["year"], r["c"])
           for r in U.upsert(base, upd, ["k"], ["title", "c"], order="seq").collect()}
    # key 2: last update wins for listed columns, year kept; key 3 inserted whole
    assert out == {1: ("a", 2000, 5), 2: ("B2", 2001, 8), 3: ("C", 2003, 9)}


def test_append_distinct_ignores_conflicts(spark):
    base = spark.createDataFrame([(1, 10)], "p long, a long")
    upd = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10)], "p long, a long")
    got = sorted(tuple(r) for r in U.append_distinct(base, upd, ["p", "a"]).collect())
    assert got == [(1, 10), (1, 11), (2, 10)]


def test_ties_leave_one_row_a_key(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    upd = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "p", 5), (2, "q", 5), (3, "s", 1), (3, "s", 1)], "k long, v string, o int")
    for rows, order in ((upd, "o"), (upd.drop("o"), None)):
        got = [tuple(r) for r in U.upsert(base, rows, ["k"], ["v"], order=order).orderBy("k").collect()]
        assert [k for k, _ in got] == [1, 2, 3]
        assert got == [tuple(r) for r in U.upsert(base, rows.orderBy("v"), ["k"], ["v"], order=order).orderBy("k").collect()]
        assert got[0][1] in "xy" and got[1][1] in "pq"
