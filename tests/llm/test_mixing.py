"""Mixing: the exponent, the budgets and the realised rows."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import mixing as X

SCHEMA = "doc_id long, source string, text string, weight string, tokens long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, "w", 1) for i, s, t in rows], SCHEMA)


def sources(n=400):
    sizes = {"big": n, "mid": n // 4, "small": n // 20, None: 3}
    rows, at = [], 0
    for s, k in sizes.items():
        for j in range(k):
            rows.append((at, s, " ".join(["w"] * (1 + (at * 7 + j) % 13))))
            at += 1
    return rows


def tokens(rows):
    out = Counter()
    for _, s, t in rows:
        out[s] += len((t or "").split())
    return out


def realised(rows, got):
    n = {i: len((t or "").split()) for i, _, t in rows}
    used, times = Counter(), Counter()
    for r in got:
        used[r.source] += n[r.doc_id]
        times[r.doc_id] += 1
    return used, times


def test_repetition_limit_keeps_every_document(spark):
    rows = sources()
    got = X.mix(docs_of(spark, rows), max_repetition=3.0).collect()
    used, times = realised(rows, got)
    share, top = tokens(rows), max(tokens(rows).values())
    assert set(times) == {i for i, _, _ in rows}
    least = min(share.values())
    a = 1 - math.log(3.0) / math.log(top / least)
    for s in share:
        want = top * (share[s] / top) ** a
        assert want - 2 <= used[s] <= want + 14, s   # to within one document
        assert {r.mix_budget for r in got if r.source == s} == {max(math.floor(want + 1e-6), share[s])} or abs(
            next(r.mix_budget for r in got if r.source == s) - want) < 1.01
    for s in share:  # whole epochs, and one partial
        ids = [i for i, x, _ in rows if x == s]
        assert max(times[i] for i in ids) - min(times[i] for i in ids) <= 1
    assert abs(sum({r.source: r.mix_weight for r in got}.values()) - 1) < 1e-9


def test_entropy_target(spark):
    rows = sources()
    target = 0.9 * math.log(4)
    got = X.mix(docs_of(spark, rows), target_entropy=target, max_repetition=None).collect()
    w = {r.source: r.mix_weight for r in got}
    assert abs(-sum(p * math.log(p) for p in w.values()) - target) < 1e-6
    share = tokens(rows)
    assert sorted(w, key=w.get) == sorted(share, key=share.get)


def test_budget_cuts(spark):
    rows = sources()
    got = X.mix(docs_of(spark, rows), budget=600, max_repetition=None).collect()
    used, _ = realised(rows, got)
    share = tokens(rows)
    for s in share:
        b = math.floor(600 * share[s] / sum(share.values()))
        assert b <= used[s] <= b + 13 or used[s] == b


def test_partial_epoch_is_a_prefix_of_the_permutation(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCKS", 8)
    rows = sources()
    got = X.mix(docs_of(spark, rows), max_repetition=2.5).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.source, r.mix_epoch][r.doc_id] = r.mix_key
    for (s, e), taken in by.items():
        everyone = by[s, 0]
        if len(taken) < len(everyone):
            placed = X.placed(docs_of(spark, [x for x in rows if x[1] == s]))
            k = X.keys(F.lit(e))
            order = [r.doc_id for r in placed.select("doc_id", k["bk"].alias("b"), k["sk"].alias("s"), k["dk"].alias("d"))
                     .orderBy("b", "s", "d").collect()]
            assert set(order[:len(taken)]) == set(taken)
    assert [by["big", 0][i] for i in sorted(by["big", 0])] != [by["mid", 0][i] for i in sorted(by["mid", 0])]


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "x y"), (None, "b", "p q r"), (5, "b", "p q r"), (5, "b", "p q r"),
            (6, "empty", ""), (7, "long", "w " * 50000)]
    got = X.mix(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in rows}
    assert Counter(r.source for r in got)["empty"] == 1
    assert set(got[0].asDict()) >= {"weight", "tokens", "mix_weight"}


def test_empty_and_single(spark):
    assert X.mix(docs_of(spark, [])).count() == 0
    assert X.mix(docs_of(spark, [(1, "a", "x")])).count() == 1


def test_bisect_equals_plain_halving():
    for at in (0.1234567, 0.5, 0.999, 0.0000001):
        lo, hi = 0.0, 1.0
        for _ in range(X.LEVELS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if mid >= at else (mid, hi)
        assert X.bisect(lambda points: [p >= at for p in points]) == hi


def test_columns_keep_their_values(spark):
    rows = [(1, "a", "x y z", "KEEP", 7, 8, "b", 9), (2, "b", "p", "ME", 1, 2, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _source string, _n int, _block int, _doc string, column_0 int")
    got = X.mix(docs, max_repetition=3.0)
    assert got.columns[:8] == docs.columns
    assert {tuple(r)[:8] for r in got.collect()} == set(rows)
