"""D1, D2, W4 cases and a property test against brute force over the rules."""

import random

from scriptorium.operators import dedupe as DD

SCHEMA = "seq long, doi string, title string, abstract string, authors_struct array<struct<name:string,openalex_id:string>>"


def _groups(spark, rows):
    df = spark.createDataFrame([(i, d, t, "", []) for i, (d, t) in enumerate(rows)], SCHEMA)
    out = DD.dedupe_group(df).orderBy("seq").collect()
    return [(r["group_kind"], r["group_key"]) for r in out]


def test_dedupe_cases(spark):
    assert _groups(spark, [("d1", "A"), ("d2", "a")]) == [("doi", "d1"), ("doi", "d2")]
    assert _groups(spark, [(None, "A"), ("d1", "a")]) == [("title", "a"), ("title", "a")]
    assert _groups(spark, [("d1", "A"), (None, "a")]) == [("doi", "d1"), ("title", "a")]
    assert _groups(spark, [(None, "")]) == [(None, None)]


def test_abstract_backfill_and_author_merge(spark):
    rows = [(0, "d", "T", "", [("Ann", None), ("Bo", "A2")]),
            (1, "d", "T", "x", [("ANN", "A1"), ("ann", None), ("Bob", "A2")]),
            (2, "d", "T", "y", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = DD.dedupe_papers(df, with_authors=True).first()
    assert out["abstract"] == "x"
    assert [(a["name"], a["openalex_id"]) for a in out["authors_struct"]] == [("Ann", None), ("Bo", "A2"), ("ANN", "A1")]
    assert out["authors_text"] == "Ann, Bo, ANN"
    assert out["group_size"] == 3


def _by_the_rules(rows):
    """The closed form, term by term: t0 and d0 as minima over all records."""
    low = {seq: (title or "").lower() for seq, _, title in rows}

    def absorbed(seq):
        t0 = min((s for s, d, _ in rows if not d and low[s] and low[s] == low[seq]), default=None)
        return t0 is not None and t0 < seq

    out = []
    for seq, doi, _ in rows:
        d0 = min((s for s, d, _ in rows if doi and d == doi and not absorbed(s)), default=None)
        out.append(("doi", doi) if d0 is not None and d0 <= seq else ("title", low[seq]) if low[seq] else (None, None))
    return out


def test_dedupe_matches_the_rules(spark):
    rng = random.Random(7)
    batches = []
    for b in range(40):
        n = rng.randint(1, 12)
        batches.append([(b * 100 + i, rng.choice([None, "", "d1", "d2", "d3"]),
                         rng.choice(["", "Alpha", "alpha", "Beta", "GAMMA"])) for i in range(n)])
    rows = [r for batch in batches for r in batch]
    df = spark.createDataFrame([(s, d, t, "", []) for s, d, t in rows], SCHEMA)
    got = {}
    # batches are independent: give each its own key space
    df = df.selectExpr("seq", "case when doi is null or doi = '' then doi else concat(cast(seq div 100 as string), doi) end as doi",
                       "case when title = '' then title else concat(cast(seq div 100 as string), title) end as title",
                       "abstract", "authors_struct")
    for r in DD.dedupe_group(df).collect():
        got[r["seq"]] = (r["group_kind"], r["group_key"])
    for batch in batches:
        keyed = [(s, (f"{s // 100}{d}" if d else d), (f"{s // 100}{t}" if t else t)) for s, d, t in batch]
        want = _by_the_rules(keyed)
        assert [got[s] for s, _, _ in keyed] == [(k, (v.lower() if k == "title" else v) if v else v) for k, v in want]


def test_survivors_in_order(spark):
    """DOI groups first, then title groups, each by first arrival."""
    rows = [(0, None, "B", "", []), (1, "d2", "C", "", []), (2, None, "A", "", []), (3, "d1", "D", "", []), (4, "d2", "E", "", [])]
    out = DD.survivor_order(DD.dedupe_papers(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["group_kind"], r["seq"]) for r in out] == [("doi", 1), ("doi", 3), ("title", 0), ("title", 2)]


def test_loaded_rows_and_topic_lookup(spark):
    """J2 keeps rows of loaded papers; J4 nulls a topic the table lacks; M2's rejects."""
    from scriptorium.operators import marts as M
    papers = spark.createDataFrame([("d1",)], "doi string")
    rows = spark.createDataFrame([("d1", "k"), ("d9", "k"), (None, "k")], "doi string, author_key string")
    assert [r["doi"] for r in M.loaded(rows, papers).collect()] == ["d1"]
    results = spark.createDataFrame(
        [(0, "d1", 3, [], [0.5]), (1, "d2", 9, [], [0.5]), (2, None, 3, [], [])],
        "seq long, doi string, cluster_id int, predicted_multi_labels array<string>, topic_distribution array<double>"
    ).selectExpr("*", "cast(null as string) as cluster_label")
    topics = spark.createDataFrame([(3,)], "topic_id int")
    got = {r["doi"]: r["primary_topic_id"] for r in M.interactions(results, topics).collect()}
    assert got == {"d1": 3, "d2": None}
    assert [r["seq"] for r in M.rejected_papers(results).collect()] == [2]
