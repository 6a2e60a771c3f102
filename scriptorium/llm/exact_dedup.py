"""Exact dedup against immutable snapshots through static binary-fuse filters.

A snapshot is a set of texts that no longer changes. Its distinct digests are
dealt into shards of about ``SHARD_KEYS`` and each shard gets one 8-bit
binary-fuse filter (about 9.2 bits a digest, one false positive in 256). The
digests of an incoming batch, grouped on their own first, meet the filters shard
by shard, so a batch larger than the snapshot sets the number of shards; only positives go on to the snapshot's exact buckets. Rows that share
a digest are compared byte for byte with the row that stays.

Defined results: a null text counts as empty, empty texts equal each other; a
null id takes part and loses to any id; rows repeated with the same id are rows
of the same group; extra columns of the input are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import drop_ids, keep_narrow, lower_ascii, mix64, small_side, table, texts, tidy, unused
from scriptorium.session import cut_lineage

SHARD_KEYS = 1 << 16      # digests a filter shard holds, about
SALT_ROWS = 256           # rows of one digest compared in one piece


# ------------------------------------------------------- binary-fuse filter

def fuse_shape(n: int) -> tuple[int, int]:
    """(segment length, number of start segments) for n keys, three probes a key."""
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // length) - 2)
    return min(length, 1 << 18), segments


def fuse_slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each hash: one in each of three consecutive segments."""
    mask = np.uint64(length - 1)
    start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    inside = [(h >> np.uint64(s)) & mask for s in (0, 18, 36)]
    return np.stack([(start + np.uint64(i)) * np.uint64(length) + x for i, x in enumerate(inside)]).astype(np.int64)


def fuse_print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(41))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) over distinct uint64 keys.
    Peels all slots that one key alone occupies, round by round, then fills the
    rounds in reverse; a failed peel tries the next seed."""
    n = len(keys)
    length, segments = fuse_shape(n)
    for seed in range(1, 1000):
        if seed % 20 == 0:  # small sets may need a little more room
            segments += 1
        h = mix64(keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = fuse_slots(h, length, segments)
        size = length * (segments + 2)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the indices of the keys in a slot
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        front = np.flatnonzero(count == 1)
        while len(front):
            key, first = np.unique(owner[front], return_index=True)
            slot = front[first]
            rounds.append((key, slot))
            left -= len(key)
            touched = at[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(owner, row, key)
            near = np.unique(touched)
            front = near[count[near] == 1]
        if left == 0:
            cells, prints = np.zeros(size, np.uint8), fuse_print(h)
            for key, slot in reversed(rounds):  # its own slot is still 0, so xor of all three is of the other two
                cells[slot] = prints[key] ^ cells[at[0, key]] ^ cells[at[1, key]] ^ cells[at[2, key]]
            return seed, length, segments, cells
    raise ValueError("no seed peels these keys: they are not distinct")


def fuse_contains(keys: np.ndarray, seed: int, length: int, segments: int, cells: np.ndarray) -> np.ndarray:
    h = mix64(keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    at = fuse_slots(h, length, segments)
    return fuse_print(h) == cells[at[0]] ^ cells[at[1]] ^ cells[at[2]]


# ----------------------------------------------------------- Spark operators

def _digest(with_body: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = [t.encode().lower() if isinstance(t, str) else b"" for t in pdf["text"]]  # bytes.lower: A-Z only
            digests = [sha256(b).digest() for b in bodies]
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "digest": digests,
                                "key": np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64)})
            if with_body:
                out["body"] = bodies
            yield out
    return tidy(run)


def keyed(docs: DataFrame, with_body: bool = False) -> DataFrame:
    """doc_id, digest (SHA-256 of the folded text, 32 bytes), key (its first 64
    bits) and, if asked, body (the folded text's bytes)."""
    schema = "doc_id long, digest binary, key long" + ", body binary" * with_body
    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_digest(with_body), schema)


def buckets(rows: DataFrame, *by: str) -> DataFrame:
    """Exact buckets: digest, key, keep_id (largest id), n rows. Partial
    aggregation makes a hot digest one row a task before the shuffle."""
    return rows.groupBy("digest", "key", *by).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One filter row a shard over the snapshot's exact buckets."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy().view(np.uint64))
        seed, length, segments, cells = fuse_build(keys)
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), seed, length, segments, cells.tobytes())],
                            columns=["shard", "seed", "length", "segments", "cells"])

    return (snapshot.select("key", F.pmod("key", F.lit(shards)).alias("shard"))
            .groupBy("shard").applyInPandas(build, "shard long, seed long, length long, segments long, cells binary"))


def screen(incoming: DataFrame, by_shard: DataFrame, shards: int) -> DataFrame:
    """The incoming buckets that a snapshot's filters let through: every bucket
    the snapshot holds, and about one in 256 of the others."""
    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return left[["digest", "keep_id", "n"]].iloc[:0]
        f = right.iloc[0]
        hit = fuse_contains(left["key"].to_numpy().view(np.uint64), int(f["seed"]), int(f["length"]),
                            int(f["segments"]), np.frombuffer(f["cells"], np.uint8))
        return left.loc[hit, ["digest", "keep_id", "n"]]

    dealt = incoming.withColumn("shard", F.pmod("key", F.lit(shards)))
    return (dealt.groupBy("shard").cogroup(by_shard.groupBy("shard"))
            .applyInPandas(probe, "digest binary, keep_id long, n long"))


def merge_batch(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fold an incoming batch's buckets into a snapshot's: digest, keep_id, n.
    Incoming buckets that the filters reject are new as they are; positives meet
    the exact buckets."""
    shards = max(1, -(-max(snapshot.count(), incoming.count()) // SHARD_KEYS))
    hits = keep_narrow(screen(incoming, filters(snapshot, shards), shards))
    met = snapshot.join(hits.select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("more")),
                        "digest", "left")
    old = met.select("digest", F.greatest("keep_id", "new_id").alias("keep_id"),
                     (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    known = met.filter("more is not null").select("digest")
    return old.unionByName(incoming.select("digest", "keep_id", "n").join(known, "digest", "left_anti"))


def unequal_texts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Byte check: the digests of groups of two or more in which some folded text
    is not that of the row that stays (a digest collision). A large group is
    compared in pieces of ``SALT_ROWS`` rows, each with its own copy of the text
    that stays."""
    many = keep_narrow(groups.filter("n > 1").select("digest", "keep_id", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("pieces")))
    members = (keyed(docs, with_body=True).join(small_side(many), "digest")
               .withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))))
    kept = (members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .groupBy("digest", "pieces").agg(F.min("body").alias("stays"))
            .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces"))
    return members.join(kept, ["digest", "piece"]).filter("body <> stays").select("digest").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The lower half of the id range is the immutable snapshot, the upper half the
    incoming batch; each is grouped on its own."""
    rows = keyed(docs)
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    middle = ((span["lo"] or 0) + (span["hi"] or 0)) // 2
    arrived = rows.withColumn("incoming", F.coalesce(F.col("doc_id") > middle, F.lit(False)))
    both = keep_narrow(buckets(arrived, "incoming"))
    groups = keep_narrow(merge_batch(both.filter("not incoming").drop("incoming"),
                                     both.filter("incoming").drop("incoming")))
    out = rows.join(groups, "digest").select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"))
    clash = cut_lineage(unequal_texts(docs, groups))
    if clash.take(1):  # texts that share a SHA-256: regroup all rows of such digests by their bytes
        apart = keyed(docs, with_body=True).join(clash, "digest", "left_semi")
        own = apart.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.join(clash, "digest", "left_anti").unionByName(
            apart.join(own, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts: the one of largest id. A row repeated
    under that very id is dropped too. An id alone settles a row only where it is
    there once; rows of repeated and of null ids are settled by id and digest: a group with null
    ids only keeps one row, and of rows equal in id and folded text one stays. Columns keep their
    names and values, whatever they are called."""
    made = exact_dedup(docs)
    again, body, stays, digest = unused(docs, "again", "body", "stays", "digest")
    gone = keep_narrow(made.filter("not kept").select("doc_id").distinct())
    unclear = keep_narrow(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                          .filter("n > 1 or doc_id is null").select(F.col("doc_id").alias(again)))
    if not unclear.take(1):
        return drop_ids(docs, gone)
    ids = small_side(unclear)
    same = F.col("doc_id").eqNullSafe(F.col(again))
    stay = keep_narrow(made.filter("kept").join(ids, same, "left_semi")
                       .select(F.col("doc_id").alias(stays), F.col("text_sha256").alias(digest)).distinct())
    once = (docs.join(ids, same, "left_semi").withColumn(body, lower_ascii(F.coalesce("text", F.lit(""))))
            .join(small_side(stay), F.col("doc_id").eqNullSafe(F.col(stays))
                  & (F.sha2(F.col(body).cast("binary"), 256) == F.col(digest)), "left_semi")
            .dropDuplicates(["doc_id", body]).drop(body))
    return drop_ids(docs.join(ids, same, "left_anti"), gone).unionByName(once)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


OP6_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)
"""
