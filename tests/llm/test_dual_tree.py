"""Dual-tree rounds against plain integer Lloyd."""

import math

import numpy as np
import pytest

from scriptorium.llm import dual_tree as T

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id long, error long"


def nearest(x, book):
    return np.array([min(range(len(book)), key=lambda e: (((v - book[e]) ** 2).sum(), e)) for v in x], int).reshape(len(x))


def plain(rows):
    kept = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(4096 * float(np.float32(c))) for c in v] for _, v, _ in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, x[r].tolist()))
    width, books, codes, errors = x.shape[1] // 8, [], [], np.zeros(len(x), np.int64)
    for p in range(8):
        part = x[:, p * width:(p + 1) * width]
        book = part[order[:16]].copy()
        for _ in range(6):
            own = nearest(part, book)
            for e in range(len(book)):
                if (own == e).any():
                    book[e] = part[own == e].sum(0) // (own == e).sum()
        own = nearest(part, book)
        books.append(book)
        codes.append(own)
        errors += ((part - book[own]) ** 2).sum(1)
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    out = [(i, bytes(int(c[r]) for c in codes).hex(), int(errors[r]), by_label[label]) for r, (i, _, label) in enumerate(kept)]
    return sorted(out, key=repr), np.stack(books)


def run(spark, rows, parts=1):
    codes, books = T.compress(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return sorted((tuple(r) for r in T.with_label_error(codes).select("vec_id", "code", "error", "label_error").collect()), key=repr), books


@pytest.mark.parametrize("n", [5, 40, 900])
def test_equals_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(12, 24))[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, 24))
    x[rng.integers(0, n, n // 3)] = x[0]                      # a hot group of copies
    x[rng.integers(0, n, n // 4)] = np.round(x[:1] * 2) / 2   # many ties
    rows = [(int(i), [float(c) for c in v], [None, 0, 1][int(i) % 3], None, 1, 2) for i, v in zip(rng.permutation(n), x, strict=True)]
    got, books = run(spark, rows, 3)
    want, plain_books = plain(rows)
    assert got == want and (books == plain_books).all()
    text = ",".join(str(int(c)) for book in plain_books for entry in book for c in entry)
    import hashlib
    assert T.digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark):
    ok = [0.5, -0.25] * 8
    rows = [(3, ok, 1, "c", 1, 1), (3, ok, 1, "c", 1, 1), (3, [0.1] * 16, None, "c", 1, 1), (None, [0.2] * 16, None, "c", 1, 1), (4, None, 1, "c", 1, 1),
            (5, [None] + ok[1:], 1, "c", 1, 1), (6, [float("nan")] * 16, 1, "c", 1, 1), (7, [float("inf")] * 16, 1, "c", 1, 1)]
    assert run(spark, rows)[0] == plain(rows)[0]
    more = [*rows, (9, [], 1, "c", 1, 1), (10, [1.0] * 15, 1, "c", 1, 1)]            # of another length: dropped
    assert run(spark, more)[0] == run(spark, rows)[0]
    uneven = [(i, [float(i), 1.0, -float(i)], 0, "c", 1, 1) for i in range(30)]       # 3 components, filled up to 8
    filled = [(i, [*v, 0.0, 0.0, 0.0, 0.0, 0.0], *rest) for i, v, *rest in uneven]
    assert run(spark, uneven)[0] == plain(filled)[0]
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 1, "c", 1, 1)])[0] == []
    huge = [(i, [3e38 * (-1) ** i] * 16, 0, "c", 1, 1) for i in range(4)]
    assert [r[2] for r in run(spark, huge)[0]] == [0] * 4


def test_a_block_of_its_own_size(spark, monkeypatch):
    rng = np.random.default_rng(8)
    import pandas as pd
    monkeypatch.setattr(T, "BLOCK", 16 * 40)
    pdf = pd.DataFrame({"id": [str(i) for i in range(107)], "label": None, "q": [rng.integers(-9, 9, 16) for _ in range(107)]})
    blocks = pd.concat(T._blocks(8, 2)([pdf.iloc[:7], pdf.iloc[7:90], pdf.iloc[90:]]))
    assert blocks["n"].tolist() == [40, 40, 27]
    assert [i for ids in blocks["ids"] for i in ids] == pdf["id"].tolist()


def test_claims_equal_brute_force():
    rng = np.random.default_rng(5)
    for n, width, k in [(1, 1, 1), (33, 2, 16), (700, 3, 16), (500, 8, 5), (64, 1, 16)]:
        x = rng.integers(-6, 7, (n, width)) * rng.choice([1, 50])
        book = rng.integers(-6, 7, (k, width)) * 7
        order, lo, hi, sums = T.grow(x)
        points = x[order]
        (node, a), (part, b) = T.claims(points, lo, hi, book)
        got = np.full(n, -1)
        start, size = T.span_of(node, n)
        for s, m, e in zip(start, size, a, strict=True):
            assert (got[s:s + m] == -1).all()
            got[s:s + m] = e
        assert (got[part] == -1).all()
        got[part] = b
        assert (got == nearest(points, book)).all()
        assert (sums[0] == x.sum(0)).all()
