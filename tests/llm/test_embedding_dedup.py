"""Links, counts and components against brute force."""

import numpy as np

from scriptorium.llm import embedding_dedup as D
from scriptorium.llm.components import roots


def brute(rows):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])
          and any(r[1])]
    links, pairs = {}, []
    for i, a in enumerate(ok):
        for b in ok[i + 1:]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v[1], np.float32).astype(float) for v in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    pairs.append((a[0], b[0]))
                    for k in (a[0], b[0]):
                        links[k] = links.get(k, 0) + 1
    root = roots(pairs)
    return {r[0]: (links.get(r[0], 0), root.get(r[0], r[0])) for r in rows}


def run(spark, rows):
    got = D.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string"))
    return {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}, got


def test_groups_boundary_and_odd_vectors(spark):
    r = np.random.default_rng(5)
    rows, at = [], 0
    for group in range(40):  # spread so that similarities lie on both sides of the threshold
        base = r.standard_normal(16)
        for _ in range(r.integers(1, 12)):
            v = base + r.standard_normal(16) * 0.03 * (1 + group % 6) * np.linalg.norm(base) / 4
            rows.append((at, [float(x) for x in np.float32(v)], int(group % 3), "x"))
            at += 1
    rows += [(1000, [0.0] * 16, 1, "x"), (1001, None, 1, None), (1002, [1.0] * 16, None, "x"), (1003, [float("nan")] + [1.0] * 15, 1, "x"),
             (1004, [float("inf")] * 16, 1, "x"), (1005, [None] + [1.0] * 15, 1, "x"), (1006, [], 1, "x"),
             (1007, [2.0] * 8, 1, "x"), (1008, [1.0] * 8, 1, "x"), (1009, [1.0] * 8, 2, "x")]
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert any(n > 1 for n, _ in got.values())


def test_hot_group_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    base = r.standard_normal(12)
    rows = [(i, [float(x) for x in np.float32(base + r.standard_normal(12) * 0.02)], 1, None) for i in range(700)]
    rows += [(2000 + i, [float(x) for x in np.float32(base)], 1, None) for i in range(300)]
    monkeypatch.setattr(D, "TASK_ROWS", 2000)
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_chance_to_miss():
    for n in (100, 5000, 10 ** 7):
        depth, tables = D.shape(n)
        p = D.collide(np.sqrt(2 - 2 * 0.98)) ** depth
        assert (1 - p) ** tables <= D.MISS


def test_repeated_and_null_ids(spark):
    """Counts go by row: different vectors under one id have links of their own."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.1]
    near_a, near_b = [1.0, 0.05, 0.0, 0.0], [0.0, 1.0, 0.02, 0.1]
    rows = [(1, a), (1, a), (2, near_a), (2, b), (3, near_b), (None, a), (4, [0.0, 0.0, 1.0, 0.0])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in D.near_components(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True),
                          (None, 0, None, True)], key=repr)


def test_empty(spark):
    got, _ = run(spark, [])
    assert got == {}
