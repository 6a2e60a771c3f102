"""The audit against a replay of every order over the documents."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from scriptorium.llm import filter_audit as A

DOCS = "doc_id long, source string, text string, documents int, filters int, part string"
LABELS = "doc_id long, quality int, toxic int, good boolean"


def fails(rows):
    first = {}
    for doc_id, _, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, source, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield doc_id, source or "", {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            re.search(r"[#$%&*|]", text), doc_id is not None and first[text] < doc_id), strict=True) if bad}


def replay(rows, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, part, bad in fails(rows):
        parts.setdefault(part, []).append((doc_id, bad))
    out = {}
    for part, docs in parts.items():
        credit = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                credit[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in b for _, b in docs) - len(gone), sum(b == {f} for _, b in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key in out:
            if key[0] == part:
                out[key][-1] = credit[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    got = A.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "d#d", "eps", "z|z"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        k = rng.choice([0, 3, 150, 250])
        text = rng.choice(["", " ", "\n"]).join([" ".join(rng.choices(words[rng.choice([0, 6]):rng.choice([12, 300])], k=k))] * 2)
        rows.append((i, rng.choice(["a", "b", None, ""]), rng.choice([text, "copy", None]), 1, 2, "c"))
    return rows, [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), False) for i in rng.sample(range(n), n // 2)]


@pytest.mark.parametrize("ranges", [1 << 16, 20])
def test_equals_a_replay(spark, monkeypatch, ranges):
    monkeypatch.setattr(A, "RANGE", ranges)     # seen by workers only in this process; the lists' cut is tested below
    rows, labels = corpus(150, ranges)
    assert run(spark, rows, labels) == replay(rows, labels)


def test_odd_rows(spark):
    rows = [(None, "a", "same", 1, 1, "x"), (None, None, None, 1, 1, "x"), (5, "a", "same", 1, 1, "x"), (5, "a", "other", 1, 1, "x"),
            (5, "a", "same", 1, 1, "x"), (7, "a", "same", None, None, None), (8, "é", "long words " * 40_000, 1, 1, "x"), (9, "", "", 1, 1, "x")]
    labels = [(5, 1, 0, True), (5, 0, 1, True), (None, 1, 1, True), (9, None, 1, None)]
    assert run(spark, rows, labels) == replay(rows, labels)
    assert run(spark, [], labels) == {}
    assert set(run(spark, rows, [])) == set(replay(rows, []))


def test_lists_are_cut_in_id_order():
    import pandas as pd
    rng = np.random.default_rng(3)
    ids = np.sort(rng.integers(0, 50, 70))
    pdf = pd.DataFrame({"id": ids, "part": rng.choice(["a", "b"], 70), "bits": rng.integers(0, 128, 70)})
    lists = pd.concat(A._post([pdf.iloc[:30], pdf.iloc[30:]]))
    assert lists["documents"].sum() == 70
    for row in lists.itertuples():
        own = pdf[(pdf["part"] == row.part)]
        assert (row.first_id, row.last_id) == (own["id"].iloc[0], own["id"].iloc[-1])
        for k, c in enumerate((*A.FILTERS, *A.MARKS)):
            assert getattr(row, c).tolist() == np.flatnonzero(own["bits"].to_numpy() >> k & 1).tolist()


def test_galloping_set_operations():
    rng = np.random.default_rng(1)
    for _ in range(300):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(rng.integers(1, 6))]
        assert A.union(lists).tolist() == sorted(set().union(*map(set, (x.tolist() for x in lists))))
        a, b = lists[0], lists[-1]
        assert a[A.inside(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
