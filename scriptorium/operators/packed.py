"""Rows of terms exchanged as packed tables.

A task sorts its rows by term and writes those of one part of the terms as one small table (front-coded strings,
zstandard), so a shuffle of terms takes a few bytes a row, and the task that gets a part works on whole columns.
The part of a term follows from the hashes of its words, so tasks that number their words needn't spell terms out to
know it. Everything here runs inside tasks, on Arrow and numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np

PACKED_ROWS = 4_000_000         # rows a task sorts and packs together
PACKED = "part int, rows binary"


def to_bytes(table, split: tuple[str, ...] = (), types: bool = False) -> bytes:
    """An Arrow table as one small Parquet file. Columns in ``split`` are numbers without an order; ``types``: columns
    of any type come back as they were."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    encoding = {f.name: "DELTA_BYTE_ARRAY" for f in table.schema if pa.types.is_string(f.type)} | {c: "BYTE_STREAM_SPLIT" for c in split}
    out = pa.BufferOutputStream()
    pq.write_table(table, out, compression="zstd", write_statistics=False, store_schema=types, column_encoding=encoding,
                   use_dictionary=[c for c in table.schema.names if c not in encoding])
    return out.getvalue().to_pybytes()


def from_bytes(data):
    import pyarrow as pa
    import pyarrow.parquet as pq

    return pq.ParquetFile(pa.BufferReader(data)).read(use_threads=False)


def word_hashes(words) -> np.ndarray:
    """A number above 0 for each word of an Arrow array."""
    import pyarrow as pa

    return np.fromiter((crc32(w) + 1 for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mixed(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """The parts of terms whose words have these hashes; ``second`` is 0 for a single word."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(parts)).astype(np.int32)


def placed(terms, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each term of an Arrow array without nulls (a word, or what blanks join), and an order of the terms by
    part and word: words are sorted, not terms."""
    import pyarrow.compute as pc

    words = pc.split_pattern(terms, " ", max_splits=1)
    size, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), pc.list_flatten(words).dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False)
    place = np.empty(len(flat.dictionary), np.int64)
    place[pc.sort_indices(flat.dictionary).to_numpy()] = np.arange(len(place))
    hashes = word_hashes(flat.dictionary)
    begin, two = np.cumsum(size) - size, size == 2
    second, number = np.zeros(len(size), np.uint64), place[code[begin]] * (len(place) + 1)
    second[two] = hashes[code[begin[two] + 1]]
    number[two] += place[code[begin[two] + 1]] + 1
    part = mixed(hashes[code[begin]], second, parts)
    order = np.argsort(number, kind="stable")
    return part, order[np.argsort(part[order], kind="stable")]


def cut(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the runs of a sorted array."""
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    for begin, end in zip(begins, np.append(begins[1:], len(part))):
        yield int(part[begin]), int(begin), int(end)


def pack(batches: Iterable, parts: int, most: int = PACKED_ROWS) -> Iterator:
    """Rows with a ``term`` as rows (part, packed table), about ``most`` rows at a time; rows without a term are left out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def packed(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        part, order = placed(rows["term"].combine_chunks(), parts)
        rows = rows.take(pa.array(order))
        found = [(p, to_bytes(rows.slice(b, e - b))) for p, b, e in cut(part[order])]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())],
                                          names=["part", "rows"])

    held, size = [], 0
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("term")))
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)
