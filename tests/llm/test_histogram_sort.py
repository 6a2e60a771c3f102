"""Shards against their definition: whole rows, near-equal bytes, gapless slots."""

import zlib
from collections import Counter, defaultdict

from scriptorium.llm import histogram_sort as H


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, shard string")
    return [r.asDict() for r in H.histogram_sort(docs, **options).collect()]


def check(rows, got, shards=16):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows) == Counter(
        (g["doc_id"], g["size"], g["text_crc32"]) for g in got)
    slots, load = defaultdict(list), Counter()
    for g in got:
        slots[g["shard"]].append(g["slot"])
        load[g["shard"]] += g["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < shards for s in slots)
    return load


def test_hot_group_nulls_and_long(spark):
    rows = [(i, "same text", "a", None) for i in range(2000)] + [(5000 + i, f"text {i} " * (i % 30), None, "b") for i in range(3000)]
    rows += [(None, None, None, None), (9999, None, "x", "y"), (10000, "", "x", "y"), (10001, "long " * 4000, "x", "y")]
    load = check(rows, run(spark, rows))
    mean, largest = sum(load.values()) / 16, 20001
    assert max(load.values()) - min(load.values()) <= largest and max(load.values()) <= mean + largest


def test_equal_sizes(spark):
    rows = [(i, f"{i:08d}", None, None) for i in range(4000)]
    load = check(rows, run(spark, rows))
    assert max(load.values()) - min(load.values()) <= 2 * 9


def test_groups_stay_together_within_tolerance(spark):
    rows = [(i, f"group {i // 4} " + "x" * 50, None, None) for i in range(4000)]
    got = run(spark, rows, tolerance=0.1)
    shards = defaultdict(set)
    for g in got:
        shards[g["text_crc32"]].add(g["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_repeats_and_empty(spark):
    rows = [(1, "a", None, None)] * 5
    check(rows, run(spark, rows))
    assert run(spark, []) == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = [r.asDict() for r in H.histogram_sort(docs).collect()]
    load = check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], got)
    mean = sum(load.values()) / 16
    assert max(load.values()) <= mean * 1.02 and min(load.values()) >= mean * 0.98
