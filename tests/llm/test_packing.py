"""Packing against the library's ids, a plain first-fit loop, and the bounds it promises."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import packing as K

SF = "/root/testdata/sf0.01"
ODD = [*"aAbzZ'é'èÉßÿñ09½²٣ªº.,-#…“”ΣςσİıǅДж中文한가각 \t\n\x0b\x1c\x85\xa0　​😀ﬁ①", "̧́", "'s", "'re", "'ll", "<|endoftext|>",
       "</w>", "Å", "ẛ̣", "ẞ", "Ÿ", "µ", "×", "÷", "word", "WORD,"]


@pytest.fixture(scope="module")
def code():
    return K.ChunkCoder(K.tokenizer_definition())


def library_ids(code, text):
    return code.library.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(code):
    assert code.by_chunk
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(code.encode(text), np.uint16).tolist() == library_ids(code, text), repr(text)


def test_another_preparation_gets_whole_texts(code):
    other = K.ChunkCoder(K.tokenizer_definition().replace('"type":"Lowercase"', '"type":"Lowercase" '))
    assert other.by_chunk          # the same preparation, written in another way
    import public_tokenizers
    plain = K.ChunkCoder(K.tokenizer_definition(public_tokenizers.path("byte_bpe_50k.json")))
    assert not plain.by_chunk
    assert np.frombuffer(plain.encode("Hello  World's"), plain.width).tolist() == library_ids(plain, "Hello  World's")


def plain_first_fit(sizes, capacity):
    bins, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, room in enumerate(rooms):
            if room >= sizes[i]:
                bins[b].append(i)
                rooms[b] -= sizes[i]
                break
        else:
            bins.append([i])
            rooms.append(capacity - sizes[i])
    return bins, rooms


@pytest.mark.parametrize("least", [0, 1, 5])
def test_bins_and_filling(least):
    rng = random.Random(least)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
        bins, rooms = K.first_fit_decreasing(sizes, 50)
        assert (bins, rooms) == plain_first_fit(sizes, 50)
        seen = {}
        for sequence in K.fill([[(i, 0, sizes[i]) for i in b] for b in bins], rooms, least):
            n = sum(p[2] for p in sequence)
            assert 0 < n <= 50 and (50 - n < max(least, 1) or n & (n - 1) == 0)
            for item, start, length in sequence:
                seen.setdefault(item, []).append((start, length))
        for item, size in enumerate(sizes):
            at = 0
            for start, length in sorted(seen[item]):
                assert start == at
                at += length
            assert at == size


def check_pieces(rows, texts, code, capacity=K.CAPACITY):
    """Every id in one piece, every place of a sequence taken once. Returns padding and ids."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids, at = library_ids(code, text or "") + [K.END_ID], 0
        for r in sorted(docs.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not docs
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(r.length for r in rows)


def test_documents(spark, code):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    padding, ids = check_pieces(K.op11_packing(spark, SF).collect(), texts, code)
    assert padding < 0.002 * ids


def test_odd_rows(spark, code):
    rows = [(1, None, 5, "x"), (2, "", 6, "y"), (None, "no id", 7, "z"), (4, "long words " * 30_000, None, None), (5, "Σ'S \x1c é", 8, "q"),
            ((1 << 60) + 1, "great id", 0, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string")
    got = K.pack(docs, K.tokenizer_definition(), group=4).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(got, {r[0]: r[1] for r in rows}, code)
    twice = spark.createDataFrame([(3, "same text"), (3, "same text")], "doc_id long, text string")
    got = K.pack(twice, K.tokenizer_definition()).collect()
    assert sum(r.length for r in got) == 2 * (len(library_ids(code, "same text")) + 1)
    assert K.pack(twice.limit(0), K.tokenizer_definition()).collect() == []


def test_many_groups_and_small_sequences(spark, code):
    rng = random.Random(2)
    texts = {i: "w " * rng.randint(0, 90) for i in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = K.pack(docs, K.tokenizer_definition(), capacity=64, group=50, least=4).withColumn("ids_crc32", F.crc32("ids")).collect()
    padding, ids = check_pieces(got, texts, code, 64)
    assert padding < 0.05 * ids
