"""Reduction to a wanted number of topics against one-by-one agglomeration."""

import math
import random
from collections import Counter

import pytest

from scriptorium.operators import topicmerge as R
from scriptorium.operators import topics as T


def fixture(seed, topics=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(t, w, rng.randint(1, 30)) for t in range(-1, topics) for w in rng.sample(words, rng.randint(3, 15))]


def plain(terms, sizes, wanted):
    total, classes = Counter(), Counter()
    for t, w, n in terms:
        total[w] += n
        classes[t] += n
    mean = math.floor(sum(classes.values()) / len(classes))
    vec = {}
    for t, w, n in terms:
        if t != -1:
            vec.setdefault(t, {})[w] = n / classes[t] * math.log(1 + mean / total[w])
    norm = {t: math.sqrt(sum(x * x for x in v.values())) for t, v in vec.items()}
    cos = lambda a, b: sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / norm[a] / norm[b]
    groups = [[t] for t in sorted(vec)]
    while len(groups) > wanted:
        _, i, j = max((sum(cos(a, b) for a in groups[i] for b in groups[j]) / len(groups[i]) / len(groups[j]), -i, -j)
                      for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[-i] += groups.pop(-j)
    order = sorted(groups, key=lambda g: (-sum(sizes[t] for t in g), min(g)))
    return {t: i for i, g in enumerate(order) for t in g} | {-1: -1}


@pytest.mark.parametrize("wanted", [1, 5, 14])
def test_equals_one_by_one(spark, wanted):
    terms = fixture(wanted)
    sizes = {t: random.Random(t).randint(1, 50) for t in range(-1, 14)}
    got = R.reduce_topics(spark.createDataFrame(terms, "topic_id int, term string, n long"),
                          spark.createDataFrame(list(sizes.items()), "topic_id int, n long"), wanted)
    assert {r.topic_id: r.new_topic_id for r in got.collect()} == plain(terms, sizes, wanted)


def test_topics_without_similarity_and_new_keywords(spark):
    terms = spark.createDataFrame([(0, "a", 5), (0, "b", 1), (1, "a", 4), (2, "c", 9), (3, "d", 9), (-1, "a", 1)], "topic_id int, term string, n long")
    sizes = spark.createDataFrame([(0, 1), (1, 1), (2, 5), (3, 4), (-1, 9)], "topic_id int, n long")
    mapping = R.reduce_topics(terms, sizes, 3)
    assert {r.topic_id: r.new_topic_id for r in mapping.collect()} == {0: 2, 1: 2, 2: 0, 3: 1, -1: -1}
    new = R.merged_terms(terms, mapping)
    assert {(r.topic_id, r.term): r.n for r in new.collect()} == {(2, "a"): 9, (2, "b"): 1, (0, "c"): 9, (1, "d"): 9, (-1, "a"): 1}
    words = T.topic_keywords(new, mapping.filter("topic_id >= 0").selectExpr("new_topic_id as topic_id").distinct())
    found = {r.topic_id: r.keywords for r in words.collect()}
    assert found[0] == ["c"] and found[1] == ["d"] and sorted(found[2]) == ["a", "b"]
    one = {r.topic_id: r.new_topic_id for r in R.reduce_topics(terms, sizes, 1).collect()}
    assert one == {0: 0, 1: 0, 2: 0, 3: 0, -1: -1}
    with pytest.raises(ValueError):
        R.reduce_topics(terms, sizes, 0)
