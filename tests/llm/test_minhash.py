"""Near-dedup against brute force over exact shingle sets."""

import random
import re

import numpy as np

from scriptorium.llm import minhash as M
from scriptorium.llm.common import shingle_set, word_hashes
from scriptorium.llm.components import roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    root = roots(links)
    return {i: (len(sets[i]), root.get(i, i), root.get(i, i) == i) for i in ids}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, node string, halves string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_components(docs, **options).collect()}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10 ** 6)}"
    return " ".join(words)


def test_cases(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, edited(r, base, 2)), (4, edited(r, base, 30)), (5, None),
            (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE  two"), (10, "one two three"), (11, "a b c d"), (12, "a b c d e"),
            (13, "word " * 30000), (14, "word word word word"), (15, "x" * 300000), (16, "x" * 300000 + "y")]
    assert run(spark, rows) == brute(rows)


def test_groups_with_chains_and_outliers(spark):
    """Copies edited to all degrees: links only through the middle, and near misses."""
    r = random.Random(9)
    rows, at = [], 0
    for size in (2, 5, 30, 80):
        base = [f"g{size}w{r.randrange(10 ** 6)}" for _ in range(100)]
        for _ in range(size):
            rows.append((at, edited(r, base, r.randrange(0, 7))))
            at += 1
        chain = base
        for _ in range(size // 2):
            chain = edited(r, chain, 2).split()
            rows.append((at, " ".join(chain)))
            at += 1
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    r = random.Random(11)
    base = [f"b{r.randrange(10 ** 6)}" for _ in range(80)]
    rows = [(i, edited(r, base, r.choice([0, 1, 1, 2, 3, 4, 5]))) for i in range(250)]
    assert run(spark, rows) == brute(rows)


def test_five_words_and_dropping(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(r, base, i // 3)) for i in range(12)]
    assert run(spark, rows, words=5) == brute(rows, 5)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = M.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, v in brute(rows, 5).items() if v[2])


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in M.near_components(docs).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True)], key=repr)


def test_texts_that_share_a_long_passage_form_no_pairs(spark, monkeypatch):
    """400 common words, 75 of their own: similar enough for many tables, not for a link."""
    r, asked = random.Random(1), []
    common = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join([f"o{r.randrange(10 ** 9)}" for _ in range(75)] + common)) for i in range(200)]
    confirm = M.confirm

    def counted(pairs, sets, percent):
        pairs = M.cut_lineage(pairs)
        asked.append(pairs.count())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(M, "confirm", counted)
    assert run(spark, rows) == brute(rows)
    assert asked[0] > 0 and sum(asked) < 3 * len(rows)


def test_prefixes_keep_every_pair():
    r = random.Random(5)
    for percent in (50, 80, 95):
        for _ in range(400):
            a = set(range(r.randint(1, 40)))
            b = {x for x in a if r.random() < 0.95} | {100 + i for i in range(r.randint(0, 4))}
            a, b = sorted((a, b), key=len)
            if not a or 100 * len(a & b) < percent * len(a | b):
                continue
            order = list(range(200))
            r.shuffle(order)
            first = [sorted(s, key=order.index)[:M.prefix_lengths(len(s), percent)[k]] for k, s in enumerate((a, b))]
            assert set(first[0]) & set(first[1])


def test_different_texts_under_one_id(spark):
    text = [f"w{i}" for i in range(60)]
    near, alone = " ".join([*text, "more"]), "a text of its own that nobody else has written so far"
    rows = [(3, " ".join(text), 1, "g"), (5, near, 2, "g"), (5, alone, 3, "g"), (5, "", 4, "g"), (7, near, 5, "g"), (None, near, 6, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unclear int, gone string")
    got = sorted((x.doc_id, x.text, x.unclear, x.gone) for x in M.drop_near_copies(docs).filter("doc_id is not null").collect())
    assert got == sorted([(3, " ".join(text), 1, "g"), (5, alone, 3, "g"), (5, "", 4, "g")])
    assert M.drop_near_copies(docs).filter("doc_id is null").count() == 1
    made = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in M.near_components(docs).collect()), key=repr)
    assert made == sorted([(3, 57, 3, True), (5, 58, 3, False), (5, 9, 5, True), (5, 0, 5, True), (7, 58, 3, False), (None, 58, None, True)], key=repr)


def test_empty(spark):
    assert run(spark, []) == {}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    sets = {i: shingles(t, 4) for i, t in rows}
    got = {x.doc_id: x for x in M.near_components(docs).collect()}
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())
    want = brute(rows)
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == want


def test_miss_chance():
    match = 1 - (1 - 0.8 ** M.DEPTH) ** M.SIDE
    assert 1 - match ** 2 < 6e-5


def test_word_hashes_agree_over_pieces(monkeypatch):
    from scriptorium.llm import common as C
    text = ("Alpha beta\tgamma " * 50 + "z" * 90 + " tail").encode()
    want = word_hashes(text)
    monkeypatch.setattr(C, "_CHUNK", 64)
    assert (word_hashes(text) == want).all()
    assert len(shingle_set(b"", 4)) == 0 and len(shingle_set(b"a", 4)) == 1
    assert len(np.unique(word_hashes(b"ab ba aab aba baa a b"))) == 7
