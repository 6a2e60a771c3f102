"""Sequence packing: first-fit decreasing on a tournament tree of bin capacities.

Every text is encoded once, where it is read. What a document has beyond whole
sequences is a piece; full stretches of a long document are sequences of their own.
Pieces are dealt out by a random hash and go through their partition in random order;
each ``GROUP`` of them is packed on its own, longest first, into the first bin with
room. A tournament tree holds the bins' room, every inner node the larger of its
two, so the leftmost bin that fits is found by one walk down.

First-fit decreasing leaves a few bins with room. Bins with less than ``LEAST`` tokens of room
are padded; the others are filled with tokens of the group's emptiest bins, whose documents are
cut for it. The one bin that is left over is cut into sequences whose lengths are powers of two,
which need no padding.

Defined results: a null or empty text is the end id alone; texts of any length are
encoded whole; a null id is kept; rows repeated under one id are packed each for itself;
extra columns are ignored; an empty table gives an empty result. ``sequence_id`` is
unique, not dense.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table, texts, tidy

CAPACITY = 4096           # tokens of a sequence
END_ID = 2                # put after every document
GROUP = 4096              # pieces packed together
LEAST = 16                # room up to which a sequence is padded and no document is cut for it
REMEMBERED = 200_000      # chunks, and runs, of at most 40 characters that a worker remembers: about 300 bytes for both
_LONGEST = 40
_SEND = 1 << 22           # bytes of ids in one result batch

# The preparation steps that ``ChunkCoder`` knows to work chunk by chunk.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


# ----------------------------------------------------------------- encoding

class Memory(dict):
    """Key -> the result of ``make``, remembered for short keys up to a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= _LONGEST and len(self) < REMEMBERED:
            self[key] = out
        return out


class ChunkCoder:
    """A tokenizer that remembers.

    No step of the known preparation looks across white space, so a text's ids are
    those of its chunks (runs without white space) in order. Plain chunks (ASCII without
    apostrophes, Latin-1 letters) are cut into letter runs, digits and other runs here,
    and only the merges of a run not met before are left to the library; all other
    chunks go to it as they are. A tokenizer prepared in another way gets whole texts."""

    PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
    RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python alone

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        parts = json.loads(definition)
        self.by_chunk = parts.get("normalizer") == _NORMALIZER and parts.get("pre_tokenizer") == _SPLITTER
        self.width = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.merges = self.library.model.tokenize
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in printable]
        self.letter = [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]
        self.chunks, self.runs = Memory(self._chunk), Memory(self._run)

    def _run(self, run: str) -> bytes:
        shown = run if run.isascii() else "".join([self.letter[b] for b in run.encode()])
        return array(self.width, [t.id for t in self.merges(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        plain = "'" not in chunk if chunk.isascii() else self.PLAIN.fullmatch(chunk)
        if not plain or not chunk.isprintable():
            return array(self.width, self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        chunk = chunk.lower()
        word = chunk.rstrip(self.SIGNS)
        if word.isalpha():
            return self.runs[word] + self.runs[chunk[len(word):]] if len(word) < len(chunk) else self.runs[word]
        return b"".join([self.runs[r] for r in self.RUNS.findall(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, in this machine's byte order."""
        if self.by_chunk and not self.SEPARATORS.search(text):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return array(self.width, self.library.encode(text, add_special_tokens=False).ids).tobytes()


_coders: dict[int, ChunkCoder] = {}  # one a worker, kept from task to task


def coder(definition: str) -> ChunkCoder:
    key = hash(definition)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ChunkCoder(definition)
    return _coders[key]


def _encode(definition: str, end_id: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(definition)
        end, size = array(code.width, [end_id]).tobytes(), array(code.width).itemsize
        columns = ["doc_id", "start", "doc_tokens", "ids"]
        for pdf in batches:
            rows, load = [], 0
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = (code.encode(text) if isinstance(text, str) else b"") + end
                for at in range(0, len(ids), capacity * size):
                    rows.append((doc_id, at // size, len(ids) // size, ids[at:at + capacity * size]))
                    load += len(rows[-1][3])
                    if load >= _SEND:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, load = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)
    return tidy(run)


# ------------------------------------------------------------------ packing

def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bins (the items of each) and the room left in them. Items go longest first,
    equal ones in the order given, each into the first bin with room for it."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    most = [capacity] * (2 * leaves)      # most room below a node; bin b is node leaves + b
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if most[node] < size:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        most[node] -= size
        while node > 1:
            node //= 2
            room = max(most[2 * node], most[2 * node + 1])
            if most[node] == room:
                break
            most[node] = room
    return bins, most[leaves:leaves + len(bins)]


Piece = tuple[int, int, int]              # item, first token, tokens


def fill(bins: list[list[Piece]], rooms: list[int], least: int) -> list[list[Piece]]:
    """Pours the emptiest bins into the room of the others, where that is ``least`` or
    more, and cuts what stays in the last one by powers of two."""
    order = sorted(range(len(bins)), key=rooms.__getitem__)
    to, source = 0, len(order) - 1
    while to < source:
        r, d = order[to], order[source]
        if rooms[r] < max(least, 1):
            to += 1
            continue
        while rooms[r] and bins[d]:
            item, start, n = bins[d].pop()
            take = min(n, rooms[r])
            bins[r].append((item, start + n - take, take))
            if take < n:
                bins[d].append((item, start, n - take))
            rooms[r] -= take
            rooms[d] += take
        source -= not bins[d]
    if rooms[order[source]] >= least:
        bins[order[source]], *more = by_powers(bins[order[source]])
        bins.extend(more)
    return [b for b in bins if b]


def by_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in order, cut into sequences whose lengths are powers of two, the largest first."""
    total, left, out = sum(p[2] for p in pieces), list(reversed(pieces)), []
    for power in reversed(range(total.bit_length())):
        if total >> power & 1:
            need, sequence = 1 << power, []
            while need:
                item, start, n = left.pop()
                take = min(n, need)
                sequence.append((item, start, take))
                if take < n:
                    left.append((item, start + take, n - take))
                need -= take
            out.append(sequence)
    return out


def _pack(definition: str, capacity: int, group: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype(np.uint16 if coder(definition).width == "H" else np.uint32)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def rows(sequences: list[list[Piece]]) -> pd.DataFrame:
            nonlocal sequence
            out = []
            for pieces in sequences:
                at = 0
                for item, start, n in pieces:
                    doc_id, first, doc_tokens, ids = held[item]
                    out.append((doc_id, first + start, n, doc_tokens, sequence, at, ids[start:start + n].astype("<u4").tobytes()))
                    at += n
                sequence += 1
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def packed() -> Iterator[pd.DataFrame]:
            bins, rooms = first_fit_decreasing([len(h[3]) for h in held], capacity)
            sequences = fill([[(i, 0, len(held[i][3])) for i in b] for b in bins], rooms, least)
            for s in range(0, len(sequences), 256):
                yield rows(sequences[s:s + 256])
            held.clear()

        for pdf in batches:
            for doc_id, start, doc_tokens, ids in zip(*(pdf[c].tolist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                held.append((doc_id, start, doc_tokens, np.frombuffer(ids, kind)))
                if len(held) == group:
                    yield from packed()
        if held:
            yield from packed()
    return tidy(run)


def pack(docs: DataFrame, definition: str, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP,
         least: int = LEAST) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length,
    doc_tokens, sequence_id, offset (its place in the sequence), ids (little-endian
    32-bit numbers). ``definition`` is the tokenizer's JSON text; it travels with the
    tasks. ``docs`` has doc_id and text."""
    # ids go through Python as strings, where a null needs no floating-point column
    rows = texts(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    pieces = rows.mapInPandas(_encode(definition, end_id, capacity), "doc_id string, start long, doc_tokens long, ids binary")
    # The deal depends on the piece alone, so a task that runs again makes the same groups.
    dealt = pieces.withColumn("deal", F.xxhash64("doc_id", "start", F.crc32("ids"), F.lit(11)))
    dealt = dealt.repartition("deal").sortWithinPartitions("deal").drop("deal")
    packed = dealt.mapInPandas(_pack(definition, capacity, group, least), "doc_id string, start long, length long, "
                               "doc_tokens long, sequence_id long, offset long, ids binary")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def tokenizer_definition(path: str | None = None) -> str:
    """The JSON text of a tokenizer file; by default the public word vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_definition())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
