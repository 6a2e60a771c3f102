"""Quality classifier by compression.

One zstandard dictionary is built from good and one from bad labelled text. A
text is compressed with each, in consecutive frames of ``FRAME`` bytes (all of
them), so that it never becomes its own dictionary and its end counts as its
beginning does; the normalised difference of the two summed sizes, with the
compression ratio and the length as context, becomes a probability through a
logistic curve fitted on other labelled rows than the dictionaries saw.

Fitting reads bounded samples of labelled training rows: ``DICT_DOCS`` rows a
label for the dictionaries (``PIECES`` pieces of each, spread over the text) and
``CURVE_DOCS`` rows a label for the curve. Scoring reads every whole text.

Defined results: null and empty texts are scored as the empty text; without
labels of both kinds the score is the share of label 1 (0.5 without any label);
a null id is never a training row and is not held out; repeated rows each get
their result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import fold, table, texts, tidy
from scriptorium.llm.logistic import fit_logistic, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
DICT_DOCS, PIECES, PIECE = 2000, 4, 1024
CURVE_DOCS = 4000
DICT_BYTES, LEVEL = 112640, 3
FRAME = 2048              # bytes of a text compressed at once


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    raw: bool             # dictionaries are plain content (too little text to train on)
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    low: np.ndarray | None = None      # the measures' range on the fitted rows: the curve is not
    high: np.ndarray | None = None     # extended beyond it

    def compressors(self):
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_AUTO
        out = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data, dict_type=kind)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False,
                                                write_content_size=False, write_dict_id=False))
        return out

    def scores(self, f: np.ndarray) -> np.ndarray:
        x = (terms(np.clip(f, self.low, self.high)) - self.centre) / self.spread
        return sigmoid(self.weights[0] + x @ self.weights[1:])


def sizes(good, bad, texts) -> np.ndarray:
    """(n, 3): normalised size difference, log compression ratio, log length. The
    sizes are sums over all consecutive frames of a text."""
    out = np.empty((len(texts), 3))
    for i, t in enumerate(texts):
        b = t.encode() if isinstance(t, str) else b""
        frames = [b[at:at + FRAME] for at in range(0, max(1, len(b)), FRAME)]
        g, h = (sum(len(c.compress(f)) for f in frames) for c in (good, bad))
        out[i] = (h - g) / (h + g), np.log((min(g, h) + 1) / (len(b) + 1)), np.log(len(b) + 1)
    return out


def terms(f: np.ndarray) -> np.ndarray:
    """The curve's terms: all products of up to two of the three measures."""
    d, r, n = f.T
    return np.column_stack([d, r, n, d * n, r * n, d * r, d * d, r * r, n * n])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            b = text.encode()
            last = max(0, len(b) - PIECE)
            for at in np.unique(np.linspace(0, last, min(PIECES, last // PIECE + 1)).astype(int)):
                out.append((b[at:at + PIECE], label))
        yield pd.DataFrame(out, columns=["piece", "label"])


def _measure(model: CompressionModel, extra: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = model.compressors()
        for pdf in batches:
            f = sizes(*pair, pdf["text"].tolist())
            out = pdf[extra].copy()
            if model.weights is None:
                out["d"], out["r"], out["n"] = f.T
            else:
                out["score"] = model.scores(f)
            yield out
    return tidy(run)


def sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, per_label: int) -> DataFrame:
    """(doc_id, text, label, turn): up to ``per_label`` training rows of each label,
    those of smallest id hash. ``turn`` (0 or 1) splits them into two halves."""
    rows = labels.filter(fold("doc_id", folds) != held_out).filter("label in (0, 1)").select("doc_id", "label").distinct()
    picked = None
    for v in (0, 1):
        some = rows.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.withColumn("turn", F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(2)))
    # at most 2 * per_label narrow rows
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def _dictionary(pieces: list[bytes]) -> tuple[bytes, bool]:
    size = min(DICT_BYTES, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes(), False
    except (zstandard.ZstdError, ValueError):  # too little text: its plain content serves
        return (b"\n".join(pieces)[-DICT_BYTES:] or b"\n" * 8).ljust(8, b"\n"), True


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel | float:
    """A fitted model, or the constant score where labels of one kind are missing."""
    rows = sample(texts(docs), labels, FOLDS, HELD_OUT, DICT_DOCS + CURVE_DOCS)
    share = DICT_DOCS / (DICT_DOCS + CURVE_DOCS)
    for_dict = F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(1000)) < int(1000 * share)
    pieces = rows.filter(for_dict).select("text", "label").mapInPandas(_pieces, "piece binary, label int").toPandas()
    pieces = pieces.sort_values(["label", "piece"], kind="stable")
    sides = {v: [bytes(p) for p in pieces["piece"][pieces["label"] == v] if len(p)] for v in (0, 1)}
    if not sides[0] or not sides[1]:
        mean = labels.filter(fold("doc_id", FOLDS) != HELD_OUT).agg(F.avg("label")).first()[0]
        return 0.5 if mean is None else float(mean)
    (good, raw_good), (bad, raw_bad) = _dictionary(sides[1]), _dictionary(sides[0])
    raw = raw_good or raw_bad
    if raw:
        good, bad = (b"\n".join(sides[v])[-DICT_BYTES:].ljust(8, b"\n") for v in (1, 0))
    model = CompressionModel(good, bad, raw)
    curve = (rows.filter(~for_dict).select("text", "label")
             .mapInPandas(_measure(model, ["label"]), "label int, d double, r double, n double").toPandas())
    curve = curve.sort_values(["label", "d", "r", "n"])
    if curve["label"].nunique() < 2:
        return float(curve["label"].mean()) if len(curve) else 0.5
    f, y = curve[["d", "r", "n"]].to_numpy(), curve["label"].to_numpy(float)
    model.low, model.high = np.quantile(f, 0.005, axis=0), np.quantile(f, 0.995, axis=0)
    x = terms(np.clip(f, model.low, model.high))
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = fit_logistic((x - model.centre) / model.spread, y)
    # The sample may hold the labels in other shares than the table does.
    counts = {r["label"]: r["n"] for r in labels.filter(fold("doc_id", FOLDS) != HELD_OUT)
              .groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model.weights[0] += np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean()))
    return model


def score(docs: DataFrame, model: CompressionModel | float) -> DataFrame:
    """doc_id and score of every row."""
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    kind = dict(docs.dtypes)["doc_id"]
    return texts(docs).select("doc_id", "text").mapInPandas(_measure(model, ["doc_id"]), f"doc_id {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("label"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
