"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of ``documents``:

- language_id drops texts without a letter and those whose best language scores
  below ``langid.MIN_SCORE``;
- exact_dedup keeps, of texts equal up to A-Z case, the one of largest id;
- near_dedup keeps, of documents linked by a Jaccard similarity of at least 0.8 on
  five-word shingles, the one of smallest id;
- mixing repeats rows of small sources up to ``mixing.MAX_REPETITION`` times (whole
  epochs and a block-permuted partial one) and writes them epoch by epoch, each in
  the order of its block permutation; it drops none;
- pieces encodes every text and decodes the ids again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import table
from scriptorium.llm.exact_dedup import drop_copies
from scriptorium.llm.langid import keep_identified
from scriptorium.llm.minhash import drop_near_copies
from scriptorium.llm.mixing import mix
from scriptorium.llm.pieces import encode_texts, vocabulary
from scriptorium.session import checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).orderBy("mix_epoch", "mix_key").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding gave the text back."""
    return encode_texts(docs, vocabulary(), "doc_id", "source", remember=UNITS, with_text=False)


UNITS = 50_000  # units a worker remembers: it shares its executor with idle workers of earlier stages

STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("pieces", pieces)]

ORACLE_SQL = None  # a trained network and a vocabulary file: not SQL; tests hold it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet in the
    shared checkpoint folder and read again, so a lost executor costs one stage."""
    import uuid
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
