"""The pipeline against a plain composition of what each stage promises."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import sentencepiece

from scriptorium.llm import langid, mixing, pieces
from test_minhash import brute as near_brute

SF = "/root/testdata/sf0.001"
LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        if name != "pieces":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
    # language: only texts without a letter or a clear language go
    left = {r.doc_id for r in kept["language_id"]}
    assert all(re.search(r"[^\W\d_]", rows[i].text) for i in left) and len(left) >= 0.97 * len(rows)
    # exact copies: the largest id of each text stays
    groups = defaultdict(list)
    for i in left:
        groups[rows[i].text.lower() if rows[i].text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), rows[i].text)].append(i)
    unique = sorted(max(v) for v in groups.values())
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == unique
    # near copies: the smallest id of each group stays
    near = near_brute([(i, rows[i].text) for i in unique], 5)
    stay = sorted(i for i, v in near.items() if v[2])
    assert sorted(r.doc_id for r in kept["near_dedup"]) == stay
    # mixing drops nothing and repeats within the limit
    times = Counter(r.doc_id for r in kept["mixing"])
    assert sorted(times) == stay and max(times.values()) <= mixing.MAX_REPETITION + 1
    # encoding
    assert len(kept["pieces"]) == len(kept["mixing"])
    for r in kept["pieces"]:
        assert list(r.ids) == LIB.encode(rows[r.doc_id].text) and r.n_tokens == len(r.ids) and r.round_trip


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "ids"} <= set(out.columns)


def test_mixing_stage_writes_the_permutation(spark):
    """Epoch by epoch, each in the order of its block permutation."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    want = [r.doc_id for r in mixing.mix(docs).select("doc_id", "mix_epoch", "mix_key").toPandas()
            .sort_values(["mix_epoch", "mix_key"]).itertuples()]
    got = [r.doc_id for r in corpus_pipeline.mixing(spark, docs, SF).collect()]
    assert got == want != sorted(want)


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, "123 456", "en", "s", 7, "x"),
            (4, "a text with words in it", "en", "s", 23, None), (5, "A text with words in it", None, None, 23, "x"),
            (5, "A text with words in it", None, None, 23, "x"), (None, "ein ganz anderer text mit wörtern", "de", None, 30, "x")]
    at = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in at.collect())
    assert got == [(False, 5), (True, 0)] and langid.MIN_SCORE < 0.5
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
