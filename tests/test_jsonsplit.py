"""A JSON array read in byte ranges against a plain parse."""

import json
import random

import pytest

from scriptorium.schemas import RAW_WORK
from scriptorium.sources import jsonsplit as J
from scriptorium.sources import zones as Z

TEXTS = ["plain", 'a "quoted" word', "braces } { }} {{", 'back\\slash "}', "\\", '\\"', "line\nbreak\ttab", "ünïcode 😀", "], [{", "", '"']


def work(rng, i):
    return {"doi": f"10.1/{i}", "title": rng.choice(TEXTS) + rng.choice(TEXTS),
            "authorships": [{"author": {"id": f"A{j}", "display_name": rng.choice(TEXTS)}} for j in range(rng.randint(0, 3))],
            "publication_year": rng.choice([None, 2020]), "venue_name": rng.choice([None, *TEXTS]),
            "abstract_inverted_index": rng.choice([None, {}, {"word}": [0, 2], '{"': [1]}]), "cited_by_count": i}


def rows_of(df):
    return sorted(((r.file, r.pos, r.doi, r.title, str(r.authorships), r.publication_year, r.venue_name,
                    str(sorted((r.abstract_inverted_index or {}).items())), r.cited_by_count) for r in df.collect()), key=repr)


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_equals_a_plain_parse(spark, tmp_path, style):
    rng = random.Random(len(style))
    for name, n in (("a.json", 400), ("b.json", 1), ("empty.json", 0)):
        (tmp_path / name).write_text(json.dumps([work(rng, i) for i in range(n)], **style), encoding="utf-8")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert J.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 15
        got = rows_of(J.read_papers_split(spark, str(tmp_path), RAW_WORK))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    assert len(got) == 401 and got == rows_of(Z.read_papers(spark, str(tmp_path), RAW_WORK))


def test_a_broken_record_harms_no_other(spark, tmp_path):
    good = json.dumps(work(random.Random(1), 1))
    (tmp_path / "x.json").write_text(f'[{good}, {{"doi": oops}},\n {good}]')
    got = J.read_papers_split(spark, str(tmp_path / "x.json"), RAW_WORK).orderBy("pos").collect()
    assert [r.doi for r in got] == ["10.1/1", None, "10.1/1"]
