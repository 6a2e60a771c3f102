"""T6, L5, A7, A8 micro-fixtures."""

from pyspark.sql import functions as F

from scriptorium.operators import topics as T
from scriptorium.plans import papers as P
from scriptorium.plans import profiles as R


def _names(spark, n):
    return spark.createDataFrame([(i, f"N{i}") for i in range(n)] + [(-1, "Outlier / Noise")],
                                 "topic_id int, name string")


def test_multi_labels(spark):
    df = spark.createDataFrame([(2, [.05, .2, .5, .16, .09]), (0, [.1, .6, .18, .05]), (-1, [.9, .1])],
                               "cluster_id int, topic_distribution array<double>")
    out = {r["cluster_id"]: r["predicted_multi_labels"] for r in T.multi_labels(df, _names(spark, 5)).collect()}
    assert out[2] == ["Topic 2: N2", "Topic 1: N1", "Topic 3: N3"]
    assert out[0][:2] == ["Topic 0: N0", "Topic 1: N1"] and "Topic 3: N3" not in out[0]
    assert out[-1] == ["Outlier / Noise"]


def test_top_topics_drops_unknown_after_cut(spark):
    inter = spark.createDataFrame([(1, [.2, .1, .1, .1, .1, .1, .1, .01])],
                                  "paper_id long, topic_distribution array<double>")
    topic = spark.createDataFrame([(i, f"N{i}") for i in range(8) if i != 3], "topic_id int, name string")
    got = P.detail_chart(inter, topic).orderBy("rank").collect()
    assert [r["topic_id"] for r in got] == [0, 1, 2, 4, 5]


def test_author_profile_average(spark):
    bridge = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "paper_id long, author_id long")
    inter = spark.createDataFrame([(1, [.5, .5]), (2, [1.0]), (3, []), (4, None)],
                                  "paper_id long, topic_distribution array<double>")
    s = {r["topic_id"]: r["prob"] for r in R.author_profile_sums(bridge, inter).collect()}
    assert s == {0: 0.75, 1: 0.25}


def test_normalise(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],)], "d array<double>")
    assert [r["n"] for r in df.select(T.normalise("d").alias("n")).collect()] == [[.25, .75], [0.0, 0.0]]


def test_term_list_bigrams_after_stop_words(spark):
    df = spark.createDataFrame([(1, "The deep network of the brain")], "doc_id long, text string")
    got = T.with_terms(df, stop=["the", "of"]).first()["terms"]
    assert got == ["deep", "network", "brain", "deep network", "network brain"]


def test_topic_diversity(spark):
    kw = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"]), (2, [])], "topic_id int, keywords array<string>")
    assert T.topic_diversity(kw).first()["diversity"] == 0.75
    empty = spark.createDataFrame([(0, [])], "topic_id int, keywords array<string>")
    assert T.topic_diversity(empty).first()["diversity"] == 0.0


def test_reassign_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.9, 0.1], -1), (4, [-1.0, -1.0], -1)],
                              "vec_id long, embedding array<float>, topic_id int")
    got = {r["vec_id"]: r["new_topic_id"] for r in T.reassign_outliers(v, 0.5).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: -1}


def _windows_by_hand(docs, terms, window, floor):
    """Every window scored on its own."""
    import math
    from collections import Counter
    total, classes = Counter(), Counter()
    for t, term, n in terms:
        total[term] += n
        classes[t] += n
    mean = math.floor(sum(classes.values()) / len(classes))
    idf = {term: math.log(1 + mean / f) for term, f in total.items()}
    score = {(t, term): n / classes[t] * idf[term] for t, term, n in terms if t != -1}
    norm = {c: math.sqrt(sum(s * s for (t, _), s in score.items() if t == c)) for c in classes if c != -1}
    out = {}
    for doc_id, text in docs:
        k = [w for w in text.lower().split() if w != "the"]
        sums = Counter()
        for w in range(max(len(k) - window, 0) + 1 if k else 0):
            part = k[w:w + window]
            bag = Counter(part + [f"{a} {b}" for a, b in zip(part, part[1:])])
            v = {term: n * idf[term] for term, n in bag.items() if term in idf}
            length = math.sqrt(sum(x * x for x in v.values()))
            for c in norm:
                sim = sum(x * score.get((c, term), 0) for term, x in v.items()) / (length * norm[c]) if length else 0
                sums[c] += sim if sim >= floor else 0
        for c, s in sums.items():
            if s:
                out[doc_id, c] = round(s / sum(sums.values()), 6)
    return out


def test_window_topics(spark):
    import random
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = [(i, " ".join(rng.choices([*vocabulary, "the", "unknown"], k=rng.choice([0, 1, 3, 4, 5, 30])))) for i in range(25)]
    docs += [(100, "alpha " * 60), (101, "the the"), (102, "")]
    terms = [(t, term, rng.randint(1, 9)) for t in (-1, 0, 1, 4) for term in [*vocabulary, "alpha beta", "gamma gamma", "alpha alpha"] if rng.random() < 0.7]
    frame = spark.createDataFrame(terms, "topic_id int, term string, n long")
    for window, floor in ((4, 0.01), (3, 0.3), (1, 0.01)):
        got = T.window_topics(spark.createDataFrame(docs, "doc_id long, text string"), frame, window=window, min_similarity=floor, stop=["the"])
        got = {(r.doc_id, r.topic_id): r.prob for r in got.collect()}
        want = _windows_by_hand(docs, terms, window, floor)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - v) < 2e-6 for k, v in want.items())
