"""Language ID, toxicity and quality: held-out accuracy, odd rows, the grammar."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import langid as L
from scriptorium.llm import quality as Q
from scriptorium.llm import queries
from scriptorium.llm import toxicity as T

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "  \n 12 !?"), (4, "word " * 40000), (5, "short"), (5, "short"), (None, "no id")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in ODD], "doc_id long, text string, label string, score double")


def held(df, folds, fold):
    want = df["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % folds == fold)
    assert (df["held_out"] == want).all()
    return df[df["held_out"]]


def test_language_accuracy(spark):
    got = queries.QUERIES["op5_language_id"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    x = held(got, 4, 2).merge(docs, on="doc_id")
    assert (x["lang_pred"] == x["lang"]).mean() > 0.98


@pytest.mark.parametrize("name, label, folds, fold, least", [
    ("op4_toxicity", "toxic", 5, 0, 0.97), ("op10_quality", "quality", 4, 2, 0.96)])
def test_label_accuracy(spark, name, label, folds, fold, least):
    got = queries.QUERIES[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got["score"].between(0, 1).all()
    x = held(got, folds, fold).merge(labels, on="doc_id")
    assert (x["predicted"] == x[label]).mean() > least
    assert x["score"][x[label] == 1].mean() > x["score"][x[label] == 0].mean() + 0.4


def test_language_odd_rows(spark):
    rows = [(i, "the cat and the dog of the house " * 3, "en") for i in range(40)]
    rows += [(100 + i, "der hund und die katze im haus ist gut " * 3, "de") for i in range(40)]
    net = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {(r.doc_id, r.lang_pred): r.score for r in L.identify(odd(spark), net, "doc_id").collect()}
    assert got[1, "und"] == got[2, "und"] == got[3, "und"] == 0
    assert len([k for k in got if k[0] == 4]) == 1 and all(0 <= s <= 1 for s in got.values())
    kept = L.keep_identified(spark.createDataFrame(rows + [(999, "1 2 3", "en"), (998, None, None)], "doc_id long, text string, lang string"))
    assert kept.count() == 80 and kept.columns == ["doc_id", "text", "lang"]
    assert L.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert L.identify(odd(spark), None, "doc_id").filter("lang_pred <> 'und'").count() == 0


def test_whole_text_decides():
    """The end of a text counts as its beginning does."""
    n = L.windows(b"a" * 1000)
    assert n.shape[1] == L.WINDOW and set(n[-1][n[-1] < 256]) == {97}
    covered = np.zeros(1000, bool)
    for i in range(len(n)):
        covered[i * L._STEP:i * L._STEP + L.WINDOW] = True
    assert covered.all()


def test_gradient_is_right():
    """The network learns what only a wide filter sees."""
    r = np.random.default_rng(0)
    x = r.integers(97, 123, (300, L.WINDOW)).astype(np.int16)
    y = (np.arange(300) % 2).astype(int)
    for i in np.flatnonzero(y):
        x[i, 50:54] = [1, 2, 3, 4]
    net = L.train(x, y, ["a", "b"])
    assert (net.probabilities(x).argmax(axis=1) == y).mean() > 0.97


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"a fine text number {i} about many things " * 4) for i in range(60)]
                                 + [(100 + i, f"junk%%% {i}*** bad### " * 8) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(1, None), (None, 1)],
                                   "doc_id long, label int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert np.mean([got[i] for i in range(60)]) > 0.9 and np.mean([got[100 + i] for i in range(60)]) < 0.1
    out = Q.score(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert Q.fit(docs, labels.limit(0)) == 0.5
    assert Q.fit(docs, labels.filter("label = 1")) == 1.0
    assert Q.score(odd(spark), 0.5).count() == len(ODD)


def test_grammar_events():
    model = T.ToxicityModel({"idiot": 4.0}, {"mordi": 3.0})
    finder = model.finder()

    def events(text):
        return dict(zip(T.EVENTS, model.text_events(text, finder)))

    assert events("what an idiot.")["plain"] == 4
    assert events("you are an Idiot")["aimed"] == 4
    assert events("an idiot, they are")["aimed"] == 4
    assert events("he is not an idiot")["negated"] == 4
    assert events('she said "idiot" twice')["reported"] == 4
    assert events("mordioso he is")["aimed"] == 3
    assert events("i will kill you")["threat"] == 1
    assert events("i will not kill you")["threat"] == 0
    assert sum(events("a kill switch in the wall").values()) == 0
    assert sum(events("the idiots of antimordi").values()) == 0       # whole words, and stems at their start
    two = events("You idiot! What an idiot.")
    assert two["aimed"] == 4 and two["plain"] == 4                    # clauses are scored one by one
    assert sum(events(None).values()) == sum(events("").values()) == 0


def test_toxicity_without_labels_and_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = T.fit(odd(spark), labels)
    out = T.score(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(r.score < 0.5 for r in out)
    assert T.score(odd(spark).limit(0), model).count() == 0


def test_copies_prove_no_insult(spark):
    """A rare word in many copies of one toxic text is no insult; one in many contexts is."""
    rows = [(i, "plain words here oddity there " * 2, 1) for i in range(30)]
    name = ["".join(p) for p in itertools.product("abcdefghij", repeat=2)]
    rows += [(100 + i, f"some {name[i]} badword ok", 1) for i in range(30)]
    rows += [(200 + i, f"some {name[i]} goodword fine", 0) for i in range(90)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    words, _ = T.entries(sample)
    assert "badword" in words and "oddity" not in words
    assert sample.filter(F.col("label") == 1).count() == 60


def test_quality_by_length(spark):
    """Held-out rows are told apart at every length, and joined ones at any length:
    the size difference doesn't fade as a text grows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = Q.fit(docs, labels)
    x = docs.filter("text is not null").join(labels, "doc_id").toPandas().sort_values("doc_id")
    x = x[x["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    pair = model.compressors()
    right = (model.scores(Q.sizes(*pair, x["text"].tolist())) >= Q.THRESHOLD) == (x["label"] == 1)
    n = x["text"].map(lambda t: len(t.encode()))
    for low, high in ((300, 1000), (1000, 3000), (3000, 10_000), (10_000, 30_000)):
        assert right[n.between(low, high)].mean() > 0.97
    sides = {v: "\n".join(x["text"][x["label"] == v]) for v in (0, 1)}
    for v, sign in ((1, 1), (0, -1)):
        long = (sides[v] * (1 + 1_000_000 // len(sides[v])))[:1_000_000]
        short = [long[at:at + 2000] for at in range(0, 100_000, 2000)]
        near, far = Q.sizes(*pair, short)[:, 0].mean(), Q.sizes(*pair, [long])[0, 0]
        assert sign * far > 0.6 * sign * near > 0
        assert (model.scores(Q.sizes(*pair, [long]))[0] >= Q.THRESHOLD) == bool(v)
    junk_at_end = sides[1][:20_000] + sides[0][:60_000]
    assert Q.sizes(*pair, [junk_at_end])[0, 0] < 0  # the end counts as the beginning does


def test_rare_language_is_learnt(spark):
    """A language of 20 rows among 12,000, all of large id hash, is found, and its
    rows stay in the pipeline."""
    r = np.random.default_rng(3)
    vocabulary = {"aa": "the cat and dog of house with some water under green trees".split(),
                  "bb": "der hund und die katze im haus ist gut aber nicht sehr alt".split(),
                  "zz": "kivo zamule tirra pelok zunki movat rizel kanoti vulme".split()}
    rare = {x.id for x in spark.range(12_000).orderBy(F.xxhash64("id").desc()).limit(20).collect()}
    rows = [(i, " ".join(r.choice(vocabulary[lang], 30)), lang)
            for i, lang in enumerate("zz" if i in rare else "bb" if i % 3 == 0 else "aa" for i in range(12_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in L.identify(docs, L.fit(docs), "doc_id").collect()}
    assert all(got[i].lang_pred == "zz" for i in rare)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.99
    assert L.keep_identified(docs).filter("lang = 'zz'").count() == 20


def test_sample_is_the_smallest_hashes_of_each_language(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'a text' as text",
                                        "case when id % 200 = 0 then 'c' when id % 3 = 0 then 'b' else 'a' end as lang")
    docs = docs.unionByName(docs)  # repeated rows count once
    salted = docs.distinct().withColumn("salt", F.xxhash64("doc_id")).orderBy("salt").collect()
    want = set()
    for lang in "abc":
        mine = [x.doc_id for x in salted if x.lang == lang and zlib.crc32(str(x.doc_id).encode()) % 4 != 2]
        want |= {(i, lang) for i in mine[:100]}
    assert set(L.sample(docs, 100)) == want and len(want) < 300
    assert L.sample(docs.limit(0), 100) == []
