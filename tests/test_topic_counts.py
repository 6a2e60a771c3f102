"""T1 counts of many texts at once and T2 best words from bounds, against plain counting."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from scriptorium.operators import topics as T

ROWS = "doc_id long, topic_id int, text string"


def texts(seed, n=300, topics=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "x", "a_b"]
    return [(i, rng.choice([-1, *range(topics)]), " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))))
            for i in range(n)] + [(n, 0, None), (n, 0, "w1 w1 w1"), (n, 0, "w1 w1 w1")]


def plain(rows, stop):
    counts = Counter()
    for _, topic, text in rows:
        kept = [w for w in (text or "").split() if len(w) > 1 and w not in stop]
        counts.update((topic, t) for t in kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    return counts


@pytest.mark.parametrize("tasks", [0, 50])
def test_counts_equal_plain_counting(spark, tasks):
    rows = texts(1)
    df = spark.createDataFrame(rows, ROWS)
    got = T.topic_terms(df, stop=["the"], tasks=tasks)
    assert {(r.topic_id, r.term): r.n for r in got.collect()} == plain(rows, {"the"})
    assert dict(got.dtypes) == {"topic_id": "int", "term": "string", "n": "bigint"}


def test_a_task_counts_texts_together_in_bounded_parts():
    """As rows leave the task: one a term that differs, not one an occurrence; parts end at the token limit."""
    kept = [["a", "b", "a", "b"], [], None, ["b", "a"], ["a"]]
    batch = pa.record_batch([pa.array([1, 1, 1, 1, None], pa.int32()), pa.array(kept, pa.list_(pa.string()))], ["topic_id", "_kept"])

    def out(most):
        return [tuple(r.values()) for b in T._term_counts(iter([batch.slice(0, 2), batch.slice(2)]), most) for r in b.to_pylist()]

    together = [(1, "a", 3), (1, "b", 3), (1, "a b", 2), (1, "b a", 2), (None, "a", 1)]
    assert sorted(out(100), key=str) == sorted(together, key=str)
    parts = out(4)
    assert len(parts) > len(together) and sum(r[2] for r in parts) == sum(r[2] for r in together)


@pytest.mark.parametrize("probed", [1, 20])
def test_best_words_equal_plain_scores(spark, monkeypatch, probed):
    """Exact with the bound, and only a part of the terms is scored."""
    monkeypatch.setattr(T, "PROBED", probed)
    rows = texts(2, 600)
    counts = plain(rows, set())
    total, classes = Counter(), Counter()
    for (t, w), n in counts.items():
        total[w] += n
        classes[t] += n
    mean = math.floor(sum(classes.values()) / len(classes))
    best = {}
    for (t, w), n in counts.items():
        best.setdefault(t, []).append((-n / classes[t] * math.log(1 + mean / total[w]), w))
    terms = T.topic_terms(spark.createDataFrame(rows, ROWS), stop=["none"])
    ids = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "topic_id int")
    got = {r.topic_id: r.keywords for r in T.topic_keywords(terms, ids, n=5).collect()}
    assert got.pop(9) == []
    for t, words in got.items():
        score = {w: s for s, w in best[t]}
        assert [round(score[w], 9) for w in words] == [round(s, 9) for s, _ in sorted(best[t])[:5]]
    assert T.best_scores(terms, n=5).count() < terms.count() / 2


def test_tasks_follow_the_text(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 1000,)] * 100 + [(None,)], "text string")
    monkeypatch.setattr(T, "TASK_TEXT", 1000)
    assert T.text_tasks(df) == 100
    assert T.text_tasks(df.limit(0)) >= 1


def test_merged_counts_are_dealt_by_their_rows(spark):
    from scriptorium import session
    from scriptorium.operators import topicmerge as M
    terms = spark.createDataFrame([(t, f"w{i}", 1) for t in range(3) for i in range(5)], "topic_id int, term string, n long")
    mapping = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "topic_id int, new_topic_id int")
    few, many = M.merged_terms(terms, mapping), M.merged_terms(terms, mapping, rows=40 * session.TASK_ROWS)
    assert many.rdd.getNumPartitions() == 40 and sorted(many.collect()) == sorted(few.collect())
