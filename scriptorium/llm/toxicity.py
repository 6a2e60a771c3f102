"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed and run over the classed words of a clause:

- negation marks the words in its scope;
- reported speech marks what follows a reporting verb or an opening quote;
- target marks a clause in which somebody is addressed;
- insult emits an event for each insult word, as plain, aimed at a target,
  negated or reported;
- threat emits an event for a threat verb near a target.

A clause's events are weighted and summed; a text is scored from the sums of its
clauses by a logistic model whose prior weights are the grammar's own. The insult
words are learnt: words and word beginnings that occur in many different contexts
of toxic training texts and hardly in others. Contexts are counted (by the word
before), not texts, so copies of one text prove nothing.

Fitting reads bounded samples of labelled training rows (``TOXIC_DOCS`` and
``CLEAN_DOCS``); scoring reads every clause with a hit of every whole text.

Defined results: null and empty texts have no events and get the model's base
score; without labels the grammar keeps its prior weights and only threats can
match; a null id is never a training row and is not held out; repeated rows each
get their result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import fold, table, texts, tidy
from scriptorium.llm.logistic import fit_logistic, sigmoid
from scriptorium.session import cut_lineage

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
TOXIC_DOCS, CLEAN_DOCS = 4000, 12000
STEM = 5                  # shortest word beginning that can be an insult stem
MIN_CONTEXTS = 8          # different contexts an insult word needs in toxic texts
MIN_ODDS = 3.0            # and its least log-odds against other texts
MAX_ENTRIES = 20_000      # strongest entries kept
SCOPE = 3                 # words a negation covers

# Small closed word classes of the grammar, in four languages.
NEGATIONS = {"not", "never", "no", "nobody", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "niemals",
             "ne", "pas", "jamais", "aucun", "nunca", "jamás", "tampoco"}
REPORTS = {"said", "says", "say", "wrote", "called", "claimed", "reported", "quoted", "sagte", "sagt", "schrieb", "nannte",
           "dit", "disait", "écrit", "appelé", "dijo", "dice", "escribió", "llamó"}
TARGETS = {"you", "your", "you're", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "euch", "sie",
           "tu", "toi", "te", "vous", "ils", "elles", "tú", "ti", "usted", "ellos", "ellas", "vosotros"}
THREATS = {"kill", "hurt", "destroy", "murder", "shoot", "töten", "umbringen", "vernichten", "tuer", "détruire", "frapper",
           "matar", "destruir", "golpear"}
CLAUSE = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: Events a clause can emit, and the weights the grammar starts from.
EVENTS = ("plain", "aimed", "negated", "reported", "threat")
PRIOR = (-3.0, 2.0, 3.0, 0.3, 0.3, 3.0)


# -------------------------------------------------------------- transducers

@dataclass(frozen=True)
class Transducer:
    """``step(state, symbol)`` gives (next state, output symbol, events). A symbol
    is a word class with the marks added so far; ``end`` gives the events of a
    finished clause."""

    start: object
    step: object
    end: object = field(default=lambda state: ())


def _marks_negation(state, symbol):
    left = SCOPE if symbol[0] == "N" else max(0, state - 1)
    return left, symbol + "-" * (state > 0 and symbol[0] != "N"), ()


def _marks_report(state, symbol):
    return state or symbol[0] in "RQ", symbol + '"' * bool(state), ()


def _marks_target(state, symbol):
    seen = state or symbol[0] == "T"
    return seen, symbol + "@" * bool(seen), ()


def _emits_insults(state, symbol):
    """State: kinds of the insults still waiting for a target in the clause."""
    if symbol[0] != "I":
        if symbol[0] == "T" and state:
            return (), symbol, tuple(("aimed", i) for i in state)
        return state, symbol, ()
    at = symbol[1:].split("|")[0]
    if '"' in symbol:
        return state, symbol, (("reported", at),)
    if "-" in symbol:
        return state, symbol, (("negated", at),)
    if "@" in symbol:
        return state, symbol, (("aimed", at),)
    return (*state, at), symbol, ()


def _emits_threats(state, symbol):
    """State: words since a threat verb and since a target (0: none near)."""
    verb, target = (max(0, x - 1) for x in state)
    quoted = '"' in symbol or "-" in symbol
    if symbol[0] == "H" and not quoted:
        return ((0, 0), symbol, (("threat", ""),)) if target else ((SCOPE + 2, 0), symbol, ())
    if symbol[0] == "T" and not quoted:
        return ((0, 0), symbol, (("threat", ""),)) if verb else ((0, SCOPE + 2), symbol, ())
    return (verb, target), symbol, ()


NEGATION = Transducer(0, _marks_negation)
REPORT = Transducer(False, _marks_report)
TARGET = Transducer(False, _marks_target)
INSULT = Transducer((), _emits_insults, lambda state: tuple(("plain", i) for i in state))
THREAT = Transducer((0, 0), _emits_threats)


def compose(*parts: Transducer) -> Transducer:
    """One transducer that runs ``parts`` in a row, each on the output of the one before."""
    def step(states, symbol):
        after, events = [], ()
        for part, state in zip(parts, states, strict=True):
            state, symbol, emitted = part.step(state, symbol)
            after.append(state)
            events += emitted
        return tuple(after), symbol, events

    return Transducer(tuple(p.start for p in parts), step,
                      lambda states: tuple(e for p, s in zip(parts, states, strict=True) for e in p.end(s)))


GRAMMAR = compose(NEGATION, REPORT, TARGET, INSULT, THREAT)


# --------------------------------------------------------------------- model

@dataclass
class ToxicityModel:
    words: dict[str, float]          # insult words
    stems: dict[str, float]          # insult word beginnings
    weights: np.ndarray = field(default_factory=lambda: np.array(PRIOR))

    def finder(self):
        """Aho-Corasick automaton over everything that can start an event."""
        import ahocorasick
        found = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS]:
            found.add_word(w, len(w))
        found.make_automaton()
        return found

    def insult(self, word: str) -> float:
        """Weight of a word: its own entry, or that of its longest stem; 0 for none."""
        own = self.words.get(word)
        if own is not None:
            return own
        for n in range(len(word), STEM - 1, -1):
            w = self.stems.get(word[:n])
            if w is not None:
                return w
        return 0.0

    def clause_events(self, clause: str) -> np.ndarray:
        """Weighted event sums of one lower-cased clause."""
        sums, state = np.zeros(len(EVENTS)), GRAMMAR.start
        for m in WORD.finditer(clause):
            word = m.group()
            if m.start() and clause[m.start() - 1] in "\"“«„":
                state, _, events = GRAMMAR.step(state, "Q")
                self._add(sums, events)
            w = self.insult(word)
            symbol = (f"I{w:.3f}|" if w else "H" if word in THREATS else "N" if word in NEGATIONS else
                      "R" if word in REPORTS else "T" if word in TARGETS else "X")
            state, _, events = GRAMMAR.step(state, symbol)
            self._add(sums, events)
        self._add(sums, GRAMMAR.end(state))
        return sums

    @staticmethod
    def _add(sums, events):
        for kind, weight in events:
            sums[EVENTS.index(kind)] += float(weight) if weight else 1.0

    def text_events(self, text: str | None, finder) -> np.ndarray:
        """Sums over the clauses with a hit; a clause without one emits nothing."""
        total = np.zeros(len(EVENTS))
        if not text or not len(finder):
            return total
        low, done = text.lower(), 0
        for end, n in finder.iter(low):
            start = end - n + 1
            if start < done or (start and (low[start - 1].isalpha() or low[start - 1] == "'")):
                continue
            left = max((low.rfind(c, done, start) for c in ".!?;:\n"), default=-1) + 1
            stop = CLAUSE.search(low, end + 1)
            right = stop.start() if stop else len(low)
            total += self.clause_events(low[max(left, done):right])
            done = right
        return total

    def score(self, events: np.ndarray) -> np.ndarray:
        return sigmoid(self.weights[0] + np.log1p(events) @ self.weights[1:])


# ------------------------------------------------------------------- fitting

def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label, part): the training sample; part 0 gives the insult
    words, part 1 the weights. Bounded, narrow ids are broadcast."""
    rows = (labels.filter(fold("doc_id", FOLDS) != HELD_OUT).filter("label in (0, 1)")
            .select("doc_id", "label").distinct())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = rows.filter("label = 1").orderBy(*order).limit(TOXIC_DOCS).unionByName(
        rows.filter("label = 0").orderBy(*order).limit(CLEAN_DOCS))
    picked = picked.withColumn("part", F.when(F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) < 2, 0).otherwise(1))
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, label, context): words and their beginnings, with a hash of the word before."""
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            rows, before = set(), ""
            for word in WORD.findall(text.lower()):
                rows.add((word + "$", before))
                for n in range(STEM, min(len(word), STEM + 3)):
                    rows.add((word[:n], before))
                before = word
            out = pd.DataFrame(list(rows), columns=["entry", "context"])
            out["label"] = label
            yield out


def entries(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Insult words and stems with their log-odds, capped at 6."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return {}, {}
    seen = (sample.select("text", "label").mapInPandas(_words, "entry string, context string, label int")
            .select("entry", "label", F.xxhash64("context").alias("context")).distinct())
    counts = seen.groupBy("entry").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = (F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1.0)))
    need = max(3, min(MIN_CONTEXTS, sizes[1] // 8))
    strong = (counts.filter((F.col("toxic") >= need) & (F.col("clean") * 8 <= F.col("toxic")))
              .withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
              .orderBy(F.desc("odds"), "entry").limit(MAX_ENTRIES).collect())
    words = {r["entry"][:-1]: min(6.0, r["odds"]) for r in strong if r["entry"].endswith("$")}
    stems = {r["entry"]: min(6.0, r["odds"]) for r in strong if not r["entry"].endswith("$")}
    return words, stems


def _events(model: ToxicityModel, keep: list[str], scored: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = model.finder()
        for pdf in batches:
            events = np.array([model.text_events(t, finder) for t in pdf["text"].tolist()]).reshape(len(pdf), len(EVENTS))
            out = pdf[keep].copy()
            if scored:
                out["score"] = model.score(events)
            else:
                for i, name in enumerate(EVENTS):
                    out[name] = events[:, i]
            yield out
    return tidy(run)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    sample = cut_lineage(labelled(texts(docs), labels))
    model = ToxicityModel(*entries(sample.filter("part = 0")))
    seen = (sample.filter("part = 1").select("text", "label")
            .mapInPandas(_events(model, ["label"], False), "label int, " + ", ".join(f"{e} double" for e in EVENTS))
            .groupBy("label", *EVENTS).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["label", *EVENTS]))
    if seen["label"].nunique() == 2:
        seen = seen.loc[seen.index.repeat(seen["n"])]
        model.weights = fit_logistic(np.log1p(seen[list(EVENTS)].to_numpy()), seen["label"].to_numpy(float),
                                     prior=np.array(PRIOR), ridge=0.1)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    return texts(docs).select("doc_id", "text").mapInPandas(_events(model, ["doc_id"], True), f"doc_id {kind}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("label"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
