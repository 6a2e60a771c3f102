"""Names within an edit distance against all pairs."""

import random

import pytest

from scriptorium.operators import namesearch as N


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, name):
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(name))
        name = rng.choice([name[:at] + rng.choice("abé ") + name[at:], name[:at] + name[at + 1:], name[:at] + "x" + name[at + 1:]])
    return name


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("piece", [1000, 3])
def test_finds_all(spark, monkeypatch, distance, piece):
    monkeypatch.setattr(N, "PIECE", piece)
    rng = random.Random(distance)
    base = ["Ann Lee", "Anna Lee", "Bo", "Ög Müller", "A", "Maria da Silva", "Supplier#01", "Supplier#02", "Supplier#11"]
    asked = [edited(rng, rng.choice(base)).upper() for _ in range(60)] + [None, "", "  ", " Bo ", "bo"]
    held = [edited(rng, rng.choice(base)) for _ in range(80)] + [None, ""]
    got = [tuple(r) for r in N.near_names(frame(spark, asked), frame(spark, held), distance).collect()]
    keys = lambda names: {n.strip(" ").lower() for n in names if n and n.strip(" ")}
    want = [(a, b, d) for a in keys(asked) for b in keys(held) for d in [levenshtein(a, b)] if d <= distance]
    assert sorted(got) == sorted(want)


def test_best_candidate(spark):
    names = spark.createDataFrame([(1, "Ann Lee"), (2, "Zoey Quinn"), (3, None), (4, "anne lee "), (5, "Ann Lee")], "author_id long, name string")
    candidates = spark.createDataFrame([("ann lee", "P9", 5), ("Ann Lee", "P2", 5), ("Ann Lee", "P1", 7), ("Ann Leek", "P0", 1), ("Bob", "P4", 1)],
                                       "name string, candidate_id string, rank long")
    got = {r.author_id: r.openalex_id for r in N.resolve_near(names, candidates).collect()}
    assert got == {1: "P2", 2: None, 3: None, 4: "P2", 5: "P2"}
    assert N.resolve_near(names, candidates.limit(0)).filter("openalex_id is not null").count() == 0
