"""Language ID by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum, and a softmax over the pooled values gives the
window's languages. The network is trained in numpy on windows of a bounded
sample of labelled rows (``LANG_DOCS`` documents of each language, at most
``DOC_WINDOWS`` windows of each, spread over the whole text) and applied in Arrow batches to
every window of every text; windows overlap by the widest filter less one, so no
byte sequence is cut. A text's score is the length-weighted mean of its windows.

Defined results: a null text or one without any letter is ``und`` with score 0;
with no labelled row at all every text is; a null id is never a training row and
is not held out; repeated rows each get their result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import fold, table, texts, tidy

FOLDS, HELD_OUT = 4, 2
LANG_DOCS = 750           # bound on labelled documents of a language the network is fitted on
DOC_WINDOWS = 4
WINDOW = 256
DIM, FILTERS, WIDTHS = 8, 16, (3, 4, 5)
EPOCHS, BATCH, RATE = 6, 64, 3e-3
LEAST_STEPS = 1000        # a small sample is gone through more often
GATHER = 4096             # windows of several texts gathered for one pass
CHUNK = 64                # windows pushed through the network at once
UNKNOWN = "und"
MIN_SCORE = 0.4           # the pipeline stage rejects texts below it

_STEP = WINDOW - max(WIDTHS) + 1


@dataclass
class ByteCNN:
    """Weights: embedding (257, DIM; 256 pads), one (width*DIM, FILTERS) kernel and
    bias a width, and the output layer."""

    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteCNN:
        r, n = np.random.default_rng(seed), len(languages)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        embed = draw(257, DIM, scale=0.5)
        embed[256] = 0
        return cls(languages, embed, [draw(w * DIM, FILTERS, scale=(w * DIM) ** -0.5) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   draw(len(WIDTHS) * FILTERS, n, scale=0.1), np.zeros(n, np.float32))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filters of (n, WINDOW) byte codes. One product
        for all widths: narrow kernels are padded with zeros."""
        wide = max(WIDTHS)
        joint = np.concatenate([np.pad(k, ((0, (wide - w) * DIM), (0, 0))) for w, k in zip(WIDTHS, self.kernels)], axis=1)
        out = np.empty((len(x), joint.shape[1]), np.float32)
        tail = np.full((1, wide - 1), 256, x.dtype)
        for at in range(0, len(x), CHUNK):
            part = x[at:at + CHUNK]
            e = self.embed[np.concatenate([part, np.repeat(tail, len(part), 0)], axis=1)].reshape(len(part), -1)
            views = np.lib.stride_tricks.sliding_window_view(e, wide * DIM, axis=1)[:, ::DIM]
            y = np.ascontiguousarray(views).reshape(-1, wide * DIM) @ joint
            out[at:at + len(part)] = y.reshape(len(part), WINDOW, -1).max(axis=1)
        return np.maximum(out + np.concatenate(self.biases), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> ByteCNN:
    """Adam on the cross-entropy. Only the position that won the pool gets a
    gradient, so the backward pass touches one patch a filter and window."""
    net, r = ByteCNN.fresh(languages, seed), np.random.default_rng(seed)
    params = [net.embed, *net.kernels, *net.biases, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(x))))):
        order = r.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            xb, yb, n = x[rows], y[rows], len(rows)
            e = net.embed[xb].reshape(n, -1)
            pooled, patches, bytes_at = [], [], []
            for w, k, b in zip(WIDTHS, net.kernels, net.biases):
                views = np.lib.stride_tricks.sliding_window_view(e, w * DIM, axis=1)[:, ::DIM]
                act = np.ascontiguousarray(views).reshape(-1, w * DIM) @ k
                act = act.reshape(n, -1, FILTERS)
                win = act.argmax(axis=1)
                pooled.append(np.maximum(np.take_along_axis(act, win[:, None], 1)[:, 0] + b, 0))
                patches.append(views[np.arange(n)[:, None], win])             # n, FILTERS, w*DIM
                bytes_at.append(xb[np.arange(n)[:, None, None], win[:, :, None] + np.arange(w)])
            h = np.concatenate(pooled, axis=1)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            dh = (p @ net.out.T) * (h > 0)
            d_embed, d_k, d_b = np.zeros_like(net.embed), [], []
            for i, (w, k) in enumerate(zip(WIDTHS, net.kernels)):
                d = dh[:, i * FILTERS:(i + 1) * FILTERS]
                d_k.append(np.einsum("nf,nfk->kf", d, patches[i]))
                d_b.append(d.sum(axis=0))
                back = (d[:, :, None] * k.T[None]).reshape(-1, DIM)
                np.add.at(d_embed, bytes_at[i].reshape(-1), back)
            d_embed[256] = 0
            grads = [d_embed, *d_k, *d_b, h.T @ p, p.sum(axis=0)]
            step += 1
            for v, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) byte codes of all windows of a text; 256 pads the last."""
    b = np.frombuffer(data, np.uint8)
    n = max(1, -(-max(len(b) - (WINDOW - _STEP), 1) // _STEP))
    flat = np.full((n - 1) * _STEP + WINDOW, 256, np.int16)
    flat[:len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::_STEP]


def _sample_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            w = windows(text.encode())
            for i in np.unique(np.linspace(0, len(w) - 1, DOC_WINDOWS).astype(int)):
                out.append((w[i].astype(np.int16).tobytes(), lang))
        yield pd.DataFrame(out, columns=["codes", "lang"])


def sample(docs: DataFrame, per_lang: int) -> list[tuple]:
    """(doc_id, lang) of the ``per_lang`` training rows of smallest id hash of each
    language. Hashes fall into levels, each as wide as all below it; the levels a
    language needs follow from its counts, so about twice the rows wanted are
    collected and none is ranked in a window."""
    salt = F.xxhash64("doc_id")
    rows = (docs.filter((fold("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("doc_id", "lang", salt.alias("salt"),
                    F.floor(F.log2(F.greatest(salt.cast("double") + F.lit(2.0 ** 63), F.lit(1.0)))).alias("level")).distinct())
    top, have = {}, {}
    for r in sorted(rows.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n")).collect()):
        if have.get(r["lang"], 0) < per_lang:
            top[r["lang"]], have[r["lang"]] = r["level"], have.get(r["lang"], 0) + r["n"]
    if not top:
        return []
    # one row a language
    enough = F.broadcast(docs.sparkSession.createDataFrame(list(top.items()), "lang string, top long"))
    near, taken = rows.join(enough, "lang").filter("level <= top").select("lang", "salt", "doc_id").collect(), {}
    for r in sorted(near):
        some = taken.setdefault(r["lang"], [])
        if len(some) < per_lang:
            some.append((r["doc_id"], r["lang"]))
    return [row for some in taken.values() for row in some]


def fit(docs: DataFrame) -> ByteCNN | None:
    """Train on the ``LANG_DOCS`` training rows of smallest id hash of each language
    (the driver sees a bounded number of windows a language, so a rare language of
    a large table is learnt as it is on a small one). None without labelled rows."""
    docs = texts(docs)
    rows = sample(docs, LANG_DOCS)
    if not rows:
        return None
    # at most LANG_DOCS narrow rows a language
    ids = F.broadcast(docs.sparkSession.createDataFrame(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string"))
    picked = (docs.filter("text is not null").select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"])
              .select("text", "lang").mapInPandas(_sample_windows, "codes binary, lang string").toPandas())
    picked = picked.sort_values(["lang", "codes"], kind="stable")
    languages = sorted(picked["lang"].unique())
    x = np.stack([np.frombuffer(c, np.int16) for c in picked["codes"]])
    return train(x, picked["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(), languages)


def shares(net: ByteCNN, texts: list[str | None], letters: list[bool]) -> np.ndarray:
    """(len(texts), languages): length-weighted mean of the windows' softmax; zeros
    for texts without letters."""
    total = np.zeros((len(texts), len(net.languages)))
    held, owner, weight, load = [], [], [], 0

    def flush():
        if held:
            p = net.probabilities(np.concatenate(held)) * np.concatenate(weight)[:, None]
            np.add.at(total, np.concatenate(owner), p)
            held.clear(), owner.clear(), weight.clear()

    for i, (text, ok) in enumerate(zip(texts, letters, strict=True)):
        if not ok:
            continue
        w = windows(text.encode())
        for at in range(0, len(w), GATHER):  # a very long text goes in pieces
            part = w[at:at + GATHER]
            held.append(part)
            owner.append(np.full(len(part), i))
            weight.append((part < 256).sum(axis=1))
            load += len(part)
            if load >= GATHER:
                flush()
                load = 0
    flush()
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def _predict(net: ByteCNN):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf["letters"].to_numpy(bool)
            share = shares(net, pdf["text"].tolist(), ok.tolist())
            best = share.argmax(axis=1)
            out = pdf[["doc_id"]].copy()
            out["lang_pred"] = np.where(ok, np.array(net.languages, object)[best], UNKNOWN)
            out["score"] = np.where(ok, share[np.arange(len(best)), best], 0.0)
            yield out
    return tidy(run)


def _keep(net: ByteCNN, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ok = [bool(t and letter.search(t)) for t in texts]
            yield batch.filter(pa.array(shares(net, texts, ok).max(axis=1, initial=0) >= min_score))
    return tidy(run)


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is clear: a letter at all and a score of at least
    ``min_score``. All columns pass through as they are. Without any labelled row
    nothing can be judged, so only texts without letters go."""
    net = fit(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_keep(net, min_score), docs.schema)


def identify(docs: DataFrame, net: ByteCNN | None, *keep: str) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, for every row."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kinds = dict(docs.dtypes)
    return (docs.select("doc_id", "text", letters.alias("letters"))
            .mapInPandas(_predict(net), f"doc_id {kinds['doc_id']}, lang_pred string, score double"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = identify(docs, fit(docs), "doc_id")
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
