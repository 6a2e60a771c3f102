"""Exact merge-type (BPE) piece encoding by backtracking, and decoding.

The vocabulary file's merges are defined by scores: of all neighbouring symbols
whose join is a piece, the best-scored (then leftmost) pair merges first. The
result is the one sequence in which every two neighbours re-merge to themselves.
The encoder walks a text once: an Aho-Corasick automaton over the reversed pieces
lists the pieces that start at each position, longest first; a piece is taken if
the text cut after it has not failed yet and it is compatible with the piece
before it, checked by re-merging the two; else the walk steps back, and a bit
marks the position as failed, so no position is tried twice.

No piece holds characters of two different classes (letters, punctuation, ...)
or a space mark after another character. Both facts are read from the vocabulary;
texts are cut there, and each worker remembers what it did for a bounded number
of such units.

Defined results: a null or empty text has no ids (the digest of an empty list)
and decodes to an empty text; characters outside the vocabulary become byte
pieces; a null id is kept; repeated rows each get their result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table, texts, tidy

SPACE = "▁"
REMEMBERED = 300_000      # units, and verdicts on pairs, that a worker remembers: about 600 bytes for both
ROWS = 500                # rows of a result batch


@dataclass(frozen=True)
class Vocabulary:
    """What the coder needs of a piece vocabulary file. It is read on the driver and
    travels with the tasks, so executors need neither the file nor its parser."""

    name: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str                # one letter a piece: n(ormal), b(yte), c(ontrol), u(nknown)
    prefix: bool              # a space mark is put before a text
    unknown_text: str         # how the library shows an unknown piece

    @classmethod
    def read(cls, model_file: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("only merge-type models with the identity normaliser are supported")
        letter = {kind.NORMAL: "n", kind.BYTE: "b", kind.CONTROL: "c", kind.UNKNOWN: "u"}
        if not {p.type for p in model.pieces} <= set(letter):
            raise ValueError("user-defined and unused pieces are not supported")
        return cls(model_file, tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces),
                   "".join(letter[p.type] for p in model.pieces), spec.add_dummy_prefix, model.trainer_spec.unk_surface)


class PieceCoder:
    """Encoder and decoder over a piece vocabulary."""

    def __init__(self, words: Vocabulary, pairs: int = REMEMBERED):
        import ahocorasick

        self.pairs = pairs  # compatibility verdicts remembered
        self.prefix, self.unknown_text, self.pieces = words.prefix, words.unknown_text, words.pieces
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.unknown, self.hidden = words.kinds.index("u"), set()
        for i, (piece, kind) in enumerate(zip(words.pieces, words.kinds, strict=True)):
            if kind == "n":
                self.score[piece], self.id[piece] = words.scores[i], i
            elif kind == "b":
                self.byte[int(piece[3:5], 16)] = i
            elif kind == "c":
                self.hidden.add(i)
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.known = set("".join(self.id))
        if not self.known <= set(self.id):
            raise ValueError("a character of a piece is no piece itself")
        self.strange = re.compile("([^" + re.escape("".join(sorted(self.known))) + "])")
        self.shorter = {p: q for p in self.id for q in [self._prefix(p)] if q}
        self.surface = [self.unknown_text if i == self.unknown else "" if i in self.hidden else p.replace(SPACE, " ")
                        for i, p in enumerate(self.pieces)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece[::-1], piece)
        self.automaton.make_automaton()
        self.unit = self._units()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def _prefix(self, piece: str) -> str | None:
        """The longest shorter piece that ``piece`` begins with."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.id), None)

    def _units(self) -> re.Pattern:
        """Pattern of the units that never share a piece."""
        group: dict[str, str] = {}
        paired: set[str] = set()  # characters that some piece holds next to another

        def find(c):
            group.setdefault(c, c)
            while group[c] != c:
                c = group[c]
            return c

        for piece in self.id:
            bare = piece.lstrip(SPACE)
            if SPACE in bare:  # a space mark inside a piece: no cut is safe
                return re.compile(r".+", re.S)
            for c in bare:
                find(c)
            for a, b in zip(bare, bare[1:]):
                group[find(a)] = find(b)
                paired.update((a, b))
        classes: dict[str, list[str]] = {}
        for c in group:
            classes.setdefault(find(c), []).append(c)
        runs = ["[" + re.escape("".join(sorted(v))) + "]+" for v in classes.values() if paired.intersection(v)]
        runs.sort(key=len, reverse=True)
        return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+", re.S)

    # -------------------------------------------------------------- encoding

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best-scored, then leftmost, pair until none is a piece."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        verdict = self._pairs.get((a, b))
        if verdict is None:
            if len(self._pairs) >= self.pairs:
                self._pairs = dict(islice(self._pairs.items(), self.pairs // 2))
            verdict = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return verdict

    def stable(self, piece: str) -> bool:
        verdict = self._whole.get(piece)
        if verdict is None:
            verdict = self._whole[piece] = self.merged(piece) == [piece]
        return verdict

    def _walk(self, text: str) -> list[str]:
        n = len(text)
        longest: dict[int, str] = {}  # by the end in the reversed text: the start here
        last = -1
        for end, piece in self.automaton.iter(text[::-1]):  # longest first at each end
            if end != last:
                longest[end] = piece
                last = end
        shorter = self.shorter
        taken: list[str] = []
        failed, at, before, piece = 0, 0, None, longest.get(n - 1)
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed >> end & 1:
                    if before is None:
                        fits = self.stable(piece)
                    else:
                        fits = self._pairs.get((before, piece))
                        if fits is None:
                            fits = self.compatible(before, piece)
                    if fits:
                        break
                piece = shorter.get(piece)
            if piece is not None:
                taken.append(piece)
                at, before, piece = end, piece, longest.get(n - 1 - end)
            else:  # nothing fits here: step back and try the next shorter piece there
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                before, piece = taken[-1] if taken else None, shorter.get(piece)
        return taken

    def encode_unit(self, unit: str) -> list[int]:
        if self.known.issuperset(unit):
            return [self.id[p] for p in self._walk(unit)]
        out: list[int] = []
        for run in self.strange.split(unit):  # runs of known characters, and single unknown ones
            if run and run[0] in self.known:
                out += [self.id[p] for p in self._walk(run)]
            elif run:
                out += [self.byte.get(b, self.unknown) for b in run.encode()] if self.byte else [self.unknown]
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.unit.findall(self.prefix * SPACE + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    # -------------------------------------------------------------- decoding

    def decode_inner(self, ids: list[int]) -> str:
        """Decode without regard to the start of the text."""
        surface = self.surface
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([surface[i] for i in ids])
        out, pending = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if i is not None:
                out.append(surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The first space mark before any text is the one the encoder added."""
        if self.prefix:
            for at, i in enumerate(ids):
                if i in self.byte_of or i == self.unknown:
                    break
                if i not in self.hidden:
                    if self.pieces[i].startswith(SPACE):
                        return self.pieces[i][1:].replace(SPACE, " ") + self.decode_inner(ids[at + 1:])
                    break
        return self.decode_inner(ids)


def _utf8(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that starts no character."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[:e.start].decode() + "�" + _utf8(data[e.start + 1:])


_MEMORIES: dict = {}


class Memory:
    """What a worker remembers of units: ids and decoded text. When full, it keeps the
    first half: frequent units come early."""

    def __init__(self, coder: PieceCoder, form, most: int = REMEMBERED):
        self.coder, self.form, self.most = coder, form, most
        self.ids: dict = {}
        self.text: dict[str, str] = {}

    def learn(self, units: list[str]) -> None:
        for u in set(units).difference(self.ids):
            ids = self.coder.encode_unit(u)
            self.ids[u], self.text[u] = self.form(ids), self.coder.decode_inner(ids)

    def trim(self) -> None:
        if len(self.ids) > self.most:
            self._keep(self.most // 2)

    def _keep(self, n: int) -> None:
        self.ids, self.text = (dict(islice(d.items(), n)) for d in (self.ids, self.text))

    def rest(self) -> None:
        """At the end of a task: what a worker holds for the next one is small."""
        self._keep(self.most // 4)
        self.coder._pairs = dict(islice(self.coder._pairs.items(), self.most // 2))

    def decoded(self, units: list[str]) -> str:
        text = "".join(map(self.text.__getitem__, units))
        return text[1:] if self.coder.prefix and text else text


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _memory(words: Vocabulary, form, most: int) -> Memory:
    """A worker process's memory: one for all its tasks."""
    key = (words.name, form.__name__, most)
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = Memory(PieceCoder(words, most), form, most)
    return _MEMORIES[key]


def _encode(words: Vocabulary, most: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(words, _packed, most)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                values, ends, decoded = [], [0], []
                for text in batch.column("_body").to_pylist():
                    units = memory.coder.units(text or "")
                    memory.learn(units)
                    values.append(b"".join(map(memory.ids.__getitem__, units)))
                    ends.append(ends[-1] + len(values[-1]) // 4)
                    back = memory.decoded(units)
                    decoded.append(back if with_text else back == (text or "").replace(SPACE, " "))
                    memory.trim()
                names = [c for c in batch.schema.names if c != "_body"]
                cuts = np.array(ends, np.int32)
                ids = pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(b"".join(values), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, names), pa.array(np.diff(cuts).astype(np.int64)), ids,
                     pa.array(decoded, pa.string() if with_text else pa.bool_())],
                    names=[*names, "n_tokens", "ids", "decoded" if with_text else "round_trip"])
        memory.rest()
    return tidy(run)


def encode_texts(docs: DataFrame, model_file: str, *keep: str, remember: int = REMEMBERED, with_text: bool = True) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids (array<int>) and decoded or, without
    text, round_trip: whether the decoded text is the text again, a literal space
    mark being a space. ``remember`` bounds what a worker remembers; it changes
    speed and memory only."""
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_tokens long, ids array<int>, "
    schema += "decoded string" if with_text else "round_trip boolean"
    return texts(docs).select(*keep, F.col("text").alias("_body")).mapInArrow(_encode(Vocabulary.read(model_file), remember, with_text), schema)


def _digests(words: Vocabulary, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _memory(words, _joined, most)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                units = memory.coder.units(text) if isinstance(text, str) else []
                memory.learn(units)
                ids = ",".join(map(memory.ids.__getitem__, units))
                rows.append((ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(),
                             sha256(memory.decoded(units).encode()).hexdigest()))
                memory.trim()
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = pdf["doc_id"].astype("Int64").array
            yield out
        memory.rest()
    return tidy(run)


def digest_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return (texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInPandas(_digests(Vocabulary.read(model_file), REMEMBERED),
                         "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def vocabulary() -> str:
    """The public piece vocabulary's file."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
