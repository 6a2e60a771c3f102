"""Soft topics of whole texts and of windows against a plain computation."""

import math
import random
from collections import Counter, defaultdict

import pytest

from scriptorium.operators import topics as T

WINDOW = 4


def _texts():
    rng = random.Random(5)
    vocab = [f"word{c}{d}" for c in "abcdef" for d in "xy"]
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30, 80])))) for i in range(24)]
    return texts + [(3, texts[3][1]), (4, "wordax wordax wordax wordax wordax wordax"), (None, "wordax wordby"), (40, None)]


def _plain(texts, terms, windows):
    totals = Counter()
    for t, _, n in terms:
        totals[t] += n
    mean = math.floor(sum(totals.values()) / len(totals))
    every = Counter()
    for _, w, n in terms:
        every[w] += n
    idf = {w: math.log(1 + mean / f) for w, f in every.items()}
    score = {(t, w): n / totals[t] * idf[w] for t, w, n in terms if t != -1}
    norm = defaultdict(float)
    for (t, _), s in score.items():
        norm[t] += s * s
    bags = defaultdict(Counter)
    for i, text in texts:
        k = (text or "").split()
        last = max(len(k) - WINDOW, 0) if windows else 0
        for w in range(last + 1 if k else 0):
            part = k[w:w + WINDOW] if windows else k
            # rows of one id are counted together, of windows only where equally long and up to the window
            bags[i, w].update((t, last) for t in part + [f"{a} {b}" for a, b in zip(part, part[1:])])
    sums = defaultdict(float)
    for (i, _), bag in bags.items():
        held = [(t, min(c, WINDOW) if windows else c) for (t, _), c in bag.items() if t in idf]
        size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in held))
        for t in norm:
            dot = sum(c * idf[w] * score.get((t, w), 0) for w, c in held)
            if size and dot / size / math.sqrt(norm[t]) >= 0.01:
                sums[i, t] += dot / size / math.sqrt(norm[t])
    whole = defaultdict(float)
    for (i, _), s in sums.items():
        whole[i] += s
    return {(i, t): s / whole[i] for (i, t), s in sums.items()}


@pytest.mark.parametrize("score, windows", [(T.window_topics, True), (T.soft_topics, False)])
def test_equals_a_plain_computation(spark, score, windows):
    texts = _texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = spark.createDataFrame([(None if i is None else i % 4 - 1, t) for i, t in texts if i is not None and t], "topic_id int, text string")
    terms = T.topic_terms(rows, stop=["none"])
    out = score(docs, terms, stop=["none"])
    got = {(r["doc_id"], r["topic_id"]): r["prob"] for r in out.collect()}
    want = _plain(texts, [tuple(r) for r in terms.select("topic_id", "term", "n").collect()], windows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_no_window_of_a_term_becomes_a_row(spark):
    """The windows, four a term, are formed where the text's terms have met again."""
    docs = spark.createDataFrame([(1, "a1 b1 c1")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "a1", 1)], "topic_id int, term string, n long")
    plan = T.window_topics(docs, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("explode") < 5


@pytest.mark.parametrize("batch", [1, 40, 1_000_000])
def test_a_batch_asks_for_a_term_once(spark, monkeypatch, batch):
    """Whatever the number of its texts: no (document, term) pair is sent, and batches of any size give the same shares."""
    from scriptorium.operators import packed as K
    from scriptorium.operators import softtopics as S
    docs = spark.createDataFrame([(i, [["aa", "bb", "aa"], ["cc"]]) for i in range(60)] + [(None, [["dd"], []]), (61, [])],
                                 "doc_id long, _kept array<array<string>>").coalesce(1)
    batches = docs.mapInArrow(lambda b: S.pack_texts(b, batch), S.BATCH)
    asked = [(r["batch"], t) for r in batches.mapInArrow(lambda b: S.ask(b, 3, True), S.ASKED).collect()
             for t in K.from_bytes(r["rows"])["term"].to_pylist()]
    assert len(asked) == len(set(asked)) and {t for _, t in asked} == {"aa", "bb", "cc", "dd", "aa bb", "bb aa"}
    assert len({b for b, _ in asked}) <= max(1, 2 * 241 // batch)


@pytest.mark.parametrize("score", [T.window_topics, T.soft_topics])
def test_steps_of_any_size_give_the_same_shares(spark, monkeypatch, score):
    from scriptorium.operators import softtopics as S
    texts = [(i, t) for i, t in _texts()]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    terms = T.topic_terms(spark.createDataFrame([(i % 3 - 1, t) for i, t in texts if i and t], "topic_id int, text string"), stop=["none"])
    whole = sorted(map(tuple, score(docs, terms, stop=["none"]).collect()), key=str)
    monkeypatch.setattr(S, "STEP_CELLS", 50)
    monkeypatch.setattr(S, "PART_ROWS", 7)
    assert whole and sorted(map(tuple, score(docs, terms, stop=["none"]).collect()), key=str) == whole


@pytest.mark.parametrize("score", [T.window_topics, T.soft_topics])
def test_no_term_of_a_text_is_joined_as_a_row(spark, score):
    docs = spark.createDataFrame([(1, "a1 b1 c1")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "a1", 1), (-1, "b1", 2)], "topic_id int, term string, n long")
    out = score(docs, terms)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan and [tuple(r) for r in out.collect()] == [(1, 0, 1.0)]


def test_terms_without_any_count_give_no_rows(spark):
    docs = spark.createDataFrame([(1, "a1 b1 c1")], "doc_id long, text string")
    for rows in ([], [(0, "zz", 1)], [(-1, "a1", 1)]):
        terms = spark.createDataFrame(rows, "topic_id int, term string, n long")
        assert T.soft_topics(docs, terms).count() == T.window_topics(docs, terms).count() == 0


def test_shuffles_of_a_landed_table_are_deleted(spark):
    import glob
    import time

    from scriptorium.session import landed, landing
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = list(env.blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}

    before = files()
    with landing(spark):
        landed(spark.range(10_000).repartition(7, "id"))
        until = time.time() + 20
        while (left := files() - before) and time.time() < until:
            time.sleep(0.5)
    assert not left
