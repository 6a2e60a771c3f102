"""Helpers shared by the training-data operators: table reads, folds, text hashing."""

from __future__ import annotations

import ctypes
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, read by Spark, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def slots(df_or_spark) -> int:
    """Tasks worth planning for: the session's shuffle partition count."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of an Arrow batch of texts. Spark's default of 10,000 is made for narrow rows.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(df: DataFrame) -> DataFrame:
    """``df``, to be sent to Python in batches of ``BATCH_ROWS`` unless the session
    says otherwise: texts are long, and a batch is held several times over."""
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return df


def tidy(run):
    """A batch function that hands unused memory back when its task ends: a worker
    process lives on, idle, beside the workers of the next tasks."""
    def until_the_end(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)
    return until_the_end


def keep_narrow(df: DataFrame) -> DataFrame:
    """Checkpoint a table of ids and numbers. It is far smaller than the texts it
    stands for, so it is dealt into an eighth of the shuffle's partitions: fewer files
    to create and to list. The rows are shuffled for it; the work before runs in
    all its tasks."""
    return cut_lineage(df.repartition(max(1, slots(df) // 8)))


#: Rows of a narrow id table up to which it is broadcast: about 16 MB sent, 64 MB as a hash table.
BROADCAST_IDS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """A materialised table of ids: broadcast when its counted size allows, else
    joined as Spark chooses. Keeps texts from being shuffled to find a few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no such column (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in the materialised ``ids``."""
    (name,) = unused(docs, "gone")
    gone = small_side(ids.select(F.col("doc_id").alias(name)))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def lower_ascii(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``: the fold of a labelled row."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


# ------------------------------------------------------------- text hashing

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0x5851F42D4C957F2D)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over a uint64 array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:  # doubling: out[k:2k] = out[:k] * base^k
        step = np.uint64(pow(int(base), k, 1 << 64))
        m = min(k, n - k)
        out[k:k + m] = out[:m] * step
        k += m
    return out


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CHUNK = 1 << 16           # bytes hashed at once
_POW, _INV = _powers(_ODD, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words (maximal runs outside space and 0x09-0x0D) of
    UTF-8 ``data``, A-Z lower-cased, in order. A rolling polynomial over random
    byte values, so it is one vectorised pass; long texts go in pieces cut at
    spaces, so memory stays bounded by the text itself."""
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    if len(b) > _CHUNK:
        cuts, at = [], 0
        while len(b) - at > _CHUNK:
            space = np.flatnonzero(_IS_SPACE[b[at:at + _CHUNK]])
            if len(space) == 0:
                break
            cuts.append((at, at + int(space[-1]) + 1))
            at = cuts[-1][1]
        if len(b) - at <= _CHUNK:
            return np.concatenate([_hash_piece(b[s:e]) for s, e in [*cuts, (at, len(b))]])
        tail = b[at:]  # a word longer than a piece: powers of its own length
        return np.concatenate([*(_hash_piece(b[s:e]) for s, e in cuts),
                               _hash_piece(tail, _powers(_ODD, len(tail) + 1), _powers(_INVERSE, len(tail) + 1))])
    return _hash_piece(b)


def _hash_piece(b: np.ndarray, power: np.ndarray = _POW, inverse: np.ndarray = _INV) -> np.ndarray:
    word = ~_IS_SPACE[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[b]] * power[:len(b)], out=total[1:])
    raw = (total[end] - total[start]) * inverse[start]
    return mix64(raw + (end - start).astype(np.uint64) * _MUL)


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """The sorted distinct 64-bit fingerprints of a text's k-word shingles. Fewer
    than k words: the whole sequence as one shingle; no word: empty."""
    w = word_hashes(data)
    if len(w) == 0:
        return w
    if len(w) < k:
        whole = np.full(1, np.uint64(len(w)))
        for j in range(len(w)):
            whole = mix64(whole * _ODD + w[j:j + 1])
        return whole
    h = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        h = mix64(h * _ODD + w[j:len(w) - k + 1 + j])
    return np.unique(h)
