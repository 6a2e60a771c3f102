"""Exact dedup against brute force; the filter against its keys."""

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup as X

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, key string")
    got = X.exact_dedup(docs)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()), key=repr)


def test_cases(spark):
    rows = [(1, "Hello", "x", None), (2, "hello", None, "y"), (3, "HELLO ", "x", "x"), (4, None, None, None), (5, "", "x", "x"),
            (6, "É", "x", "x"), (7, "é", "x", "x"), (8, "long " * 60000, "x", "x"), (9, "LONG " * 60000, "x", "x"),
            (None, "hello", "x", "x"), (10, "x" + chr(0), "x", "x"), (10, "x" + chr(0), "x", "x")]
    assert run(spark, rows) == brute(rows)


def test_hot_group(spark):
    rows = [(i, "Same" if i % 3 == 0 else f"text {i // 2}", None, None) for i in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_only_one_half(spark):
    rows = [(5, "a", None, None)] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_pipeline_form_keeps_rows_as_they_are(spark):
    rows = [(1, "A", "p", "q"), (2, "a", "r", None), (3, "b", None, None), (3, "b", "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, key string")
    got = X.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, "a"), (3, "b")]


def test_pipeline_form_settles_unclear_ids_by_row(spark):
    """An id repeated with another text keeps the text that has no copy; a null id
    whose text stands under an id goes."""
    def left(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, key string")
        return sorted(((r.doc_id, r.text) for r in X.drop_copies(docs).collect()), key=repr)

    assert left([(5, "x", "p", "q"), (5, "y", None, None), (9, "y", None, None)]) == [(5, "x"), (9, "y")]
    assert left([(None, "A", None, None), (3, "a", None, None)]) == [(3, "a")]
    r = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else int(r.integers(0, 200)), f"T{r.integers(0, 150)}", None, None) for i in range(600)]
    want = set()
    for t in {t for _, t, *_ in rows}:
        ids = [i for i, u, *_ in rows if u == t]
        known = [i for i in ids if i is not None]
        want.add((max(known) if known else None, t))
    assert left(rows) == sorted(want, key=repr)


def test_large_batch_meets_a_small_snapshot_in_pieces(spark, monkeypatch):
    """One low id makes nearly all rows the incoming batch; no filter shard may meet much of it."""
    real, most = X.screen, []

    def watch(incoming, by_shard, shards):
        sizes = incoming.groupBy((F.pmod("key", F.lit(shards))).alias("shard")).count()
        most.append(sizes.agg(F.max("count")).first()[0])
        return real(incoming, by_shard, shards)

    monkeypatch.setattr(X, "screen", watch)
    monkeypatch.setattr(X, "SHARD_KEYS", 64)
    rows = [(-10 ** 9, "text 7", None, None)] + [(i, f"Text {i // 2}", None, None) for i in range(2000)]
    assert run(spark, rows) == brute(rows)
    assert max(most) <= 2 * 64


@pytest.mark.parametrize("n", [1, 2, 3, 10, 300, 5000, 70000])
def test_filter_holds_its_keys(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2))
    made = X.fuse_build(keys)
    assert X.fuse_contains(keys, *made).all()
    others = r.integers(0, 2 ** 63, 100_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert X.fuse_contains(others, *made).mean() < 0.006
    if n >= 5000:
        assert len(made[3]) < 1.4 * n


def test_collision_is_regrouped_by_bytes(spark, monkeypatch):
    """With a digest that collides, the byte check and the regrouping decide."""
    real = X.keyed

    def clash(docs, with_body=False):
        from pyspark.sql import functions as F
        made = real(docs, with_body=True)
        same = F.col("body").isin(bytearray(b"one"), bytearray(b"two"))
        made = made.withColumn("digest", F.when(same, F.lit(bytearray(32))).otherwise(F.col("digest"))).withColumn("key", F.xxhash64("digest"))
        return made if with_body else made.drop("body")

    monkeypatch.setattr(X, "keyed", clash)
    rows = [(1, "One", None, None), (2, "one", None, None), (3, "two", None, None), (4, "three", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, key string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in X.exact_dedup(docs).collect())
    assert got == [(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)]


def test_columns_of_any_name_and_groups_without_ids(spark):
    rows = [(1, "One", "a", "b", "c", 1), (2, "one", "a", "b", "c", 2), (None, "two", "a", "b", "c", 3), (None, "TWO", "a", "b", "c", 4),
            (3, "three", "a", "b", "c", 5), (3, "three", "a", "b", "c", 6), (4, "", "a", "b", "c", 7), (5, None, "a", "b", "c", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, _gone string, body string, again int")
    got = X.drop_copies(docs)
    assert got.columns == docs.columns
    by = sorted(((r.doc_id or 0, (r.text or "").lower(), r.gone, r._gone, r.body) for r in got.collect()))
    assert by == [(0, "two", "a", "b", "c"), (2, "one", "a", "b", "c"), (3, "three", "a", "b", "c"), (5, "", "a", "b", "c")]
