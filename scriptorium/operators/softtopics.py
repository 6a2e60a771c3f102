"""The numpy side of T5: texts and windows scored against topics, many at a time.

1. ``pack_texts``: a task numbers the kept tokens of about ``BATCH_TOKENS`` tokens' texts, a batch.
2. ``ask``: a batch asks for each of its distinct terms once, whatever the number of its texts and windows.
3. ``answer``: the counts of a part of the terms meet what all batches ask of it. An answer follows the asked terms'
   order and holds numbers only: total count, topics and the counts there. The topics' norms are summed beside.
4. ``score``: a batch meets its answers; its texts are scored a few at a time (``STEP_CELLS``).

Nothing is sampled or cut; a text is whole in its batch, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from scriptorium.operators import packed as K

BATCH_TOKENS = 2_000_000        # tokens of the texts that ask together
PART_ROWS = 1_000_000           # tokens or counts of one part of the terms, about
STEP_CELLS = 4_000_000          # (occurrence, window, topic) cells a task holds at once, about

BATCH = "batch long, tokens long, ids binary, texts binary, codes binary, words binary"
ASKED = "part int, batch long, rows binary"


def pack_texts(batches: Iterable, most: int = BATCH_TOKENS) -> Iterator:
    """Rows (id, kept tokens of each of its texts) as rows of ``BATCH``: the ids; each text's id (by its place among
    the ids) and number of tokens; the tokens' places among the sorted words; the words."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def batch_of(held, number):
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = rows.column(1).combine_chunks()
        doc, texts = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False), pc.list_flatten(texts)
        words = pc.list_flatten(texts).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        size = pc.fill_null(pc.list_value_length(texts), 0)
        return pa.RecordBatch.from_pylist([{
            "batch": number, "tokens": len(words), "ids": K.to_bytes(rows.select([0]).rename_columns(["id"]), types=True),
            "texts": K.to_bytes(pa.table({"doc": pa.array(doc, pa.int64()), "size": size})),
            "codes": K.to_bytes(pa.table({"code": place[words.indices.to_numpy(zero_copy_only=False)]}), split=("code",)),
            "words": K.to_bytes(pa.table({"word": words.dictionary.take(pa.array(order))}))}], schema=schema)

    schema = pa.schema([("batch", pa.int64()), ("tokens", pa.int64()), *[(c, pa.binary()) for c in ("ids", "texts", "codes", "words")]])
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):     # an Arrow batch of long texts may be many batches here
            part = batch.slice(begin, 1024)
            held.append(part)
            size += len(pc.list_flatten(pc.list_flatten(part.column(1))))
            if size >= most:
                yield batch_of(held, number)
                held, size, number = [], 0, number + 1
    if size:
        yield batch_of(held, number)


class _Texts:
    """The occurrences of terms in a batch: of words, then of neighbours where ``pairs``. ``term`` numbers the
    distinct terms: the words, then the pairs."""

    def __init__(self, row: dict, pairs: bool):
        texts = K.from_bytes(row["texts"])
        self.doc, self.size = texts["doc"].to_numpy(), texts["size"].to_numpy()
        self.words = K.from_bytes(row["words"])["word"].combine_chunks()
        code = K.from_bytes(row["codes"])["code"].to_numpy().astype(np.int64)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.code, n = code, len(self.words)
        self.at = np.flatnonzero(self.text[1:] == self.text[:-1]) if pairs else np.zeros(0, np.int64)
        self.pair, number = np.unique(code[self.at] * n + code[self.at + 1], return_inverse=True)
        self.pair_term = number + n

    def parts(self, parts: int) -> np.ndarray:
        """The part of each distinct term."""
        h, n = K.word_hashes(self.words), len(self.words)
        none = np.zeros(n, np.uint64)
        return np.concatenate([K.mixed(h, none, parts), K.mixed(h[self.pair // n], h[self.pair % n], parts)])

    def spelt(self, terms: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(self.words)
        pair = self.pair[terms[terms >= n] - n]
        first, second = (self.words.take(pa.array(x)) for x in (pair // n, pair % n))
        return pa.concat_arrays([self.words.take(pa.array(terms[terms < n])), pc.binary_join_element_wise(first, second, " ")])


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    for p, begin, end in K.cut(part[order]):
        yield p, order[begin:end]


def ask(batches: Iterable, parts: int, pairs: bool) -> Iterator:
    """Rows of ``ASKED``: the distinct terms of a batch in each part, in the order of ``_by_part``."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            texts = _Texts(row, pairs)
            found = [(p, K.to_bytes(pa.table({"term": texts.spelt(terms)}))) for p, terms in _by_part(texts.parts(parts))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([row["batch"]] * len(found), pa.int64()),
                                              pa.array([d for _, d in found], pa.binary())], names=["part", "batch", "rows"])


def answer(batches: Iterable, totals: dict, mean: float, outlier) -> Iterator:
    """One part: rows (part, batch, packed terms) and, with no batch, (topic t, term, n) counts. Gives (part, batch, found,
    entries, norms): per asked term its total count f and number of topics k; those topics and counts, one term after the
    other; and once the part's share (t, v) of the topics' squared norms."""
    import pyarrow as pa
    import pyarrow.compute as pc

    counts, asked, part = [], [], None
    for batch in batches:
        for row in batch.to_pylist():
            part = row["part"]
            if row["batch"] is None:
                counts.append(K.from_bytes(row["rows"]))
            else:
                asked.append((row["batch"], row["rows"]))
    if not counts:
        return                                          # none of the asked terms is known
    rows = pa.concat_tables(counts).combine_chunks()
    names, n = rows["term"].combine_chunks().dictionary_encode(), rows["n"].to_numpy()
    code = names.indices.to_numpy(zero_copy_only=False)
    f = np.zeros(len(names.dictionary), np.int64)
    np.add.at(f, code, n)
    real = np.flatnonzero(pc.not_equal(rows["t"], outlier).to_numpy(zero_copy_only=False))
    real = real[np.argsort(code[real], kind="stable")]
    t, n, code = rows["t"].combine_chunks().take(pa.array(real)), n[real], code[real]
    size = np.bincount(code, minlength=len(f))
    begin = np.cumsum(size) - size
    topics = t.dictionary_encode()
    total = np.array([totals[x] for x in topics.dictionary.to_pylist()], float)
    topic = topics.indices.to_numpy(zero_copy_only=False)
    s = n / total[topic] * np.log(1 + mean / f[code]) if len(n) else np.zeros(0)
    norm = np.bincount(topic, s * s, len(total))
    norms = [{"t": x, "v": v} for x, v in zip(topics.dictionary.to_pylist(), norm.tolist())]
    out = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("found", pa.binary()), ("entries", pa.binary()),
                     ("norms", pa.list_(pa.struct([("t", t.type), ("v", pa.float64())])))])
    yield pa.RecordBatch.from_pylist([{"part": part, "batch": None, "found": None, "entries": None, "norms": norms}], schema=out)
    del rows, counts

    def told(some):
        terms = [K.from_bytes(data)["term"].combine_chunks() for _, data in some]
        place = pc.fill_null(pc.index_in(pa.concat_arrays(terms), value_set=names.dictionary), -1).to_numpy()
        end = 0
        for (number, _), asked_terms in zip(some, terms):
            at, end = place[end:end + len(asked_terms)], end + len(asked_terms)
            known, k = np.where(at < 0, 0, f[at]), np.where(at < 0, 0, size[at])
            entry = np.repeat(begin[at], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            yield pa.RecordBatch.from_pylist([{
                "part": part, "batch": number, "found": K.to_bytes(pa.table({"f": known, "k": k})), "norms": None,
                "entries": K.to_bytes(pa.table({"t": t.take(pa.array(entry)), "n": n[entry]}))}], schema=out)

    few = []
    for one in asked:
        few.append(one)
        if sum(len(data) for _, data in few) >= 4 * PART_ROWS:     # packed: some bytes a term
            yield from told(few)
            few = []
    if few:
        yield from told(few)


class _Known:
    """What a batch was told, by its terms: idf, and where its topics' scores are."""

    def __init__(self, texts: _Texts, answers: list[dict], parts: int, totals: dict, norms: dict, mean: float):
        told = {a["part"]: a for a in answers}
        here = [(terms, told[p]) for p, terms in _by_part(texts.parts(parts)) if p in told]
        n = len(texts.words) + len(texts.pair)
        f, self.k, self.begin = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.ids = sorted(norms)
        code = {x: i for i, x in enumerate(self.ids)}
        weight = np.array([totals[x] for x in self.ids], float), np.array([norms[x] for x in self.ids], float) ** 0.5
        at, topics, scores = 0, [np.zeros(0, np.int64)], [np.zeros(0)]
        for terms, a in here:
            found, entries = K.from_bytes(a["found"]), K.from_bytes(a["entries"])
            f[terms], k = found["f"].to_numpy(), found["k"].to_numpy()
            self.k[terms], self.begin[terms] = k, at + np.cumsum(k) - k
            at += entries.num_rows
            t = entries["t"].combine_chunks().dictionary_encode()
            topic = np.array([code[x] for x in t.dictionary.to_pylist()], np.int64)[t.indices.to_numpy(zero_copy_only=False)]
            idf = np.log(1 + mean / np.repeat(f[terms], k))
            topics.append(topic)
            scores.append(entries["n"].to_numpy() / weight[0][topic] * idf / weight[1][topic])
        self.known = f > 0
        self.idf = np.zeros(n)
        self.idf[self.known] = np.log(1 + mean / f[self.known])
        self.topic, self.score = np.concatenate(topics), np.concatenate(scores)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place in the row of every element of lists of these sizes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _windows(doc, term, p, last, m, idf, docs: int, window: int):
    """(row, count times idf, window) of the terms in the windows of some texts, and each window's text."""
    rows, row = np.unique(doc * len(idf) + term, return_inverse=True)
    of, term = rows // len(idf), rows % len(idf)
    # rows of one id are counted together where their texts are equally long
    wide = int(last.max()) + 1
    lengths, group = np.unique(row * wide + last, return_inverse=True)
    low = np.maximum(p + m - window, 0)
    at, step = _spread(np.minimum(p, last) - low + 1)
    w, row, group = low[at] + step, row[at], group[at]
    # windows of a text are numbered after those of the texts before
    per_text = np.zeros(docs, dtype=np.int64)
    np.maximum.at(per_text, of[row], w + 1)
    first = np.cumsum(per_text) - per_text
    n = int(per_text.sum())
    pair, often = np.unique(group * (n + 1) + first[of[row]] + w, return_counts=True)
    row, win = lengths[pair // (n + 1)] // wide, pair % (n + 1)
    # a window holds no more; repeated rows count so often at most
    return term[row], np.minimum(often, window) * idf[term[row]], win, np.repeat(np.arange(docs), per_text)


def _whole(doc, term, idf, docs: int):
    """As ``_windows``, a text being its only window."""
    rows, often = np.unique(doc * len(idf) + term, return_counts=True)
    term = rows % len(idf)
    return term, often * idf[term], rows // len(idf), np.arange(docs)


def _scored(texts: _Texts, known: _Known, window: int | None, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the id, place of the topic, share) of a batch's texts, some ids at a time."""
    topics = len(known.ids)
    if not topics:
        return
    # the cells of each text, and from them where the steps begin: before the first text of an id
    cells = np.bincount(texts.text, 1.0 + known.k[texts.code], len(texts.size))
    cells += np.bincount(texts.text[texts.at], 1.0 + known.k[texts.pair_term], len(texts.size))
    cells = cells * (window or 1) + (texts.size * topics if window else topics)
    step = (np.cumsum(cells) // STEP_CELLS)
    new = np.concatenate([[True], texts.doc[1:] != texts.doc[:-1]])
    doc_first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    step = step[doc_first]
    last = np.maximum(texts.size - (window or 0), 0)
    for _, begin, end in K.cut(step):
        tokens = slice(texts.begin[begin], texts.begin[end - 1] + texts.size[end - 1])
        pairs = slice(*np.searchsorted(texts.at, [tokens.start, tokens.stop]))
        at = np.concatenate([np.arange(tokens.start, tokens.stop), texts.at[pairs]])
        term = np.concatenate([texts.code[tokens], texts.pair_term[pairs]])
        m = np.repeat([1, 2], [tokens.stop - tokens.start, pairs.stop - pairs.start])
        held = known.known[term]
        at, term, m = at[held], term[held], m[held]
        if not len(at):
            continue
        text = texts.text[at]
        base = int(texts.doc[begin])
        doc, docs = texts.doc[text] - base, int(texts.doc[end - 1]) - base + 1
        if window:
            term, value, win, of = _windows(doc, term, at - texts.begin[text], last[text], m, known.idf, docs, window)
        else:
            term, value, win, of = _whole(doc, term, known.idf, docs)
        norm = np.sqrt(np.bincount(win, value * value, len(of)))
        entry, place = _spread(known.k[term])
        where = known.begin[term[entry]] + place
        cell = win[entry] * topics + known.topic[where]
        dot = np.bincount(cell, value[entry] * known.score[where], len(of) * topics)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = dot / np.repeat(norm, topics)
        kept = np.flatnonzero((np.bincount(cell, minlength=len(sim)) > 0) & (sim >= floor))
        to = of[kept // topics] * topics + kept % topics
        total = np.bincount(to, sim[kept], docs * topics)
        rows = np.unique(to)
        share = total[rows] / np.bincount(rows // topics, total[rows], docs)[rows // topics]
        yield base + rows // topics, rows % topics, share


def score(batches: Iterable, parts: int, totals: dict, norms: dict, mean: float, window: int | None, floor: float, topic_type) -> Iterator:
    """Batches and their answers, dealt by batch, as packed rows (id, topic, share)."""
    import pyarrow as pa

    texts, answers = {}, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                texts[row["batch"]] = row
            else:
                answers.setdefault(row["batch"], []).append(row)
    for number in list(texts):
        row = texts.pop(number)
        held = _Texts(row, pairs=window != 1)
        known = _Known(held, answers.pop(number, []), parts, totals, norms, mean)
        ids, names = K.from_bytes(row["ids"])["id"].combine_chunks(), pa.array(known.ids, topic_type)
        found = [pa.table({"id": ids.take(pa.array(i)), "topic": names.take(pa.array(t)), "share": s})
                 for i, t, s in _scored(held, known, window, floor) if len(i)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([K.to_bytes(pa.concat_tables(found), types=True)], pa.binary())], names=["rows"])


def unpack(batches: Iterable, id_col: str, topic_col: str) -> Iterator:
    for batch in batches:
        for data in batch.column(0):
            yield from K.from_bytes(data.as_py()).rename_columns([id_col, topic_col, "prob"]).to_batches(max_chunksize=1 << 16)
