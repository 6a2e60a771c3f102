"""X1-X9 on the micro-fixtures of FIXTURES.md section 3."""

from pyspark.sql import functions as F

from scriptorium.functions import text as X


def _one(spark, expr, schema, value):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_clean_text_cases(spark):
    cases = [
        ("<i>Deep</i> Learning , 2nd  ed .", "Deep Learning, 2nd ed."),
        ("José Ångström", "Jos ngstr m"),
        ("<b\n>x", "<b >x"),
        ("a < b and c > d", "a d"),
        (None, ""),
        ("", ""),
        ("ภาษาไทย", ""),
        ("a\x1cb\rc", "a b c"),
    ]
    df = spark.createDataFrame(cases, "s string, want string")
    got = df.select("want", X.clean_text("s").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_rebuild_abstract(spark):
    # SQL map() keeps entry order (a Python dict handed to createDataFrame may not)
    df = spark.sql("select map('beta', array(1), 'alpha', array(0, 2), 'gamma', array(2), 'zed', array(5)) as m "
                   "union all select cast(null as map<string, array<int>>) "
                   "union all select cast(map() as map<string, array<int>>)")
    assert df.first()["m"] is not None
    assert spark.sql("select map_keys(map('beta', 1, 'alpha', 2, 'gamma', 3)) as k").first()["k"] == [
        "beta", "alpha", "gamma"]
    got = [r["r"] for r in df.select(X.rebuild_abstract("m").alias("r")).collect()]
    # position 2 is held by alpha and gamma: the later map entry (gamma) wins
    assert got == ["alpha beta gamma zed", "", ""]


def test_flatten_authors(spark):
    schema = "a array<struct<author: struct<id: string, display_name: string>>>"
    df = spark.createDataFrame([([{"author": {"id": "A1", "display_name": None}},
                                  {"author": {"id": "A2", "display_name": "ภาษา"}},
                                  {"author": {"id": None, "display_name": "Ann  Lee"}}],)], schema)
    got = df.select(X.flatten_authors("a").alias("r")).first()["r"]
    assert [(x["name"], x["openalex_id"]) for x in got] == [("", "A2"), ("Ann Lee", None)]


def test_labels_and_sizes(spark):
    df = spark.createDataFrame([("Topic 3: A: B",), ("Outlier / Noise",), ("Topic 103: x: y",)], "l string")
    rows = df.select(X.label_name("l").alias("n"), X.label_topic_id("l").alias("t")).collect()
    assert [r["n"] for r in rows] == ["A: B", "Outlier / Noise", "x: y"]
    assert [r["t"] for r in rows] == [3, None, 103]
    sizes = spark.range(1, 5).select(X.node_size("id").alias("v")).collect()
    assert [r["v"] for r in sizes] == [3, 5, 5, 7]
    lab = spark.createDataFrame([(-1, "x"), (4, "Name")], "t int, n string").select(
        X.cluster_label("t", "n").alias("l")).collect()
    assert [r["l"] for r in lab] == ["Outlier / Noise", "Topic 4: Name"]


def test_author_key_and_round(spark):
    df = spark.createDataFrame([("", "Ann"), (None, "BO"), ("A9", "x")], "i string, n string")
    assert [r["k"] for r in df.select(X.author_key("i", "n").alias("k")).collect()] == ["ann", "bo", "A9"]
    assert spark.range(1).select(X.round4(F.lit(0.12345)).alias("r")).first()["r"] == 0.1235
