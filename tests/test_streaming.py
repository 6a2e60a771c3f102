"""The incremental clean job processes each landed file once."""

import json
import os
import tempfile

from scriptorium.streaming.landing import clean_stream


def _land(folder, name, items):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(items, f)


def test_clean_stream_incremental(spark):
    root = tempfile.mkdtemp(prefix="scriptorium-stream-")
    landing, out = os.path.join(root, "landing"), os.path.join(root, "clean")
    os.makedirs(landing)
    _land(landing, "a.json", [
        {"doi": "https://doi.org/10.1/x", "title": "<b>Deep</b>  nets .", "publication_year": 2020,
         "authorships": [{"author": {"id": "A1", "display_name": "José Li"}},
                         {"author": {"id": "A2", "display_name": ""}}],
         "abstract_inverted_index": {"world": [1], "hello": [0]}, "cited_by_count": 3},
        {"doi": None, "title": "dropped"},
    ])
    q = clean_stream(spark, landing, out)
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["doi"], r["title"], r["abstract"], r["authors_text"], r["citation_count"]) == (
        "10.1/x", "Deep nets.", "hello world", "Jos Li", 3)
    _land(landing, "b.json", [{"doi": "10.1/y", "title": "Second", "cited_by_count": None}])
    q = clean_stream(spark, landing, out)
    q.awaitTermination(120)
    got = sorted((r["doi"], r["citation_count"]) for r in spark.read.parquet(out).collect())
    assert got == [("10.1/x", 3), ("10.1/y", 0)]
