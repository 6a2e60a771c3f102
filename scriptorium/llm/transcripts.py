"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is a table of lines. Hidden states are (role, first line or later
line of a turn); a line's features are its speaker marker, its length class and
whether it ends with a question. Start, transition and emission probabilities are
counted, smoothed, from transcripts whose turns are known. Viterbi's best path
gives every line's role; lines are then grouped into turns and rendered in one
canonical form, without the markers.

A transcript of up to ``BLOCK`` lines is decoded whole, many to a task. A longer one, of any
length, is decoded in blocks: a block of ``BLOCK`` lines is
reduced to its max-plus matrix (best score from each state before it to each state
at its end), blocks of such matrices again, until one matrix a transcript is left;
the path is then opened level by level between known end states. No task holds
more than ``BLOCK`` items of a transcript, and the path is the exact one.

``op8`` writes the ``conversations`` table as plain transcripts first (marker styles
vary, some turns have none) and learns from folds of conversations.

Defined results: a null text is one empty line; a null role is written without a
marker and teaches nothing; a null conversation id or turn is a value of its own
(first in order); rows repeated with the same turn are turns in a row; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import fold, small_side, table
from scriptorium.session import cut_lineage

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
BLOCK = 256
FOLDS, HELD_OUT = 5, 0
LENGTHS = 8               # classes of a line's length: powers of two of its words
BARE_TURNS = 8            # one turn in so many is written without a marker

# How speakers are spelled, by role, in the marker styles read and written.
SPELLINGS = {"system": ("System", "SYSTEM", "[system]", "Instructions"),
             "user": ("User", "USER", "[user]", "Human"),
             "assistant": ("Assistant", "ASSISTANT", "[assistant]", "AI")}
MARKERS = ("none", *ROLES, "other")
MARKER = r"^\s*(?:\*\*|#+\s*)?(?:\[(\w+)\]|(\w[\w ]{0,15}?))(?:\*\*)?\s*:"
NAMES = {"system": "system", "instructions": "system", "user": "user", "human": "user", "question": "user", "q": "user",
         "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant"}


# ------------------------------------------------------------- transcripts

def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, lines, start: every turn with the number of its first
    line. Running sums go over blocks of turns, so a long conversation is not one
    window."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("role").isin(*ROLES), F.col("role")).alias("role"),
        F.split(F.coalesce(F.col("text"), F.lit("")), "\r\n|\n|\r").alias("lines"))
    rows = rows.withColumns({"n": F.size("lines"), "block": F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)})
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("conv_id", "block").orderBy("turn", "role", F.xxhash64("lines"))
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
            .select("conv_id", "turn", "role", "lines", (F.col("offset") + F.col("ahead")).alias("start")))


def transcribe(turns: DataFrame) -> DataFrame:
    """Plain transcript lines (conv_id, line_no, line) with the truth they were made
    from (role, opens). The marker style is the conversation's; one turn in
    ``BARE_TURNS`` has no marker."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(4))
    bare = F.pmod(F.xxhash64(F.lit("bare"), "conv_id", "start"), F.lit(BARE_TURNS)) == 0
    spelled = F.lit(None).cast("string")
    for role, forms in SPELLINGS.items():
        for i, form in enumerate(forms):
            spelled = F.when((F.col("role") == role) & (style == i), form).otherwise(spelled)
    plain = _marker(F.get("lines", F.lit(0))) == 0
    prefix = F.when((bare & plain) | F.col("role").isNull(), "").otherwise(F.concat(spelled, F.lit(": ")))
    return (turns.withColumn("prefix", prefix)
            .select("conv_id", "role", "start", "prefix", F.posexplode("lines").alias("at", "body"))
            .select("conv_id", (F.col("start") + F.col("at")).alias("line_no"),
                    F.when(F.col("at") == 0, F.concat("prefix", "body")).otherwise(F.col("body")).alias("line"),
                    "role", (F.col("at") == 0).alias("opens")))


def _marker(line: Column) -> Column:
    name = F.lower(F.concat(F.regexp_extract(line, MARKER, 1), F.regexp_extract(line, MARKER, 2)))
    known = F.lit(MARKERS.index("other"))
    for spelling, role in NAMES.items():
        known = F.when(name == spelling, MARKERS.index(role)).otherwise(known)
    return F.when(name == "", 0).otherwise(known).cast("int")


def features(lines: DataFrame) -> DataFrame:
    """Adds marker, length and asks: what the model sees of a line."""
    line = F.coalesce(F.col("line"), F.lit(""))
    words = F.regexp_count(line, F.lit(r"\S+"))
    return lines.withColumns({
        "marker": _marker(line),
        "length": F.least(F.floor(F.log2(words + 1)), F.lit(LENGTHS - 1)).cast("int"),
        "asks": line.rlike(r"\?\s*$").cast("int")})


# ------------------------------------------------------------------- model

@dataclass
class RoleModel:
    """Log probabilities: start (S), step (S, S), and one table a feature (S, values)."""

    start: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    asks: np.ndarray

    def emissions(self, pdf: pd.DataFrame) -> np.ndarray:
        return (self.marker[:, pdf["marker"]] + self.length[:, pdf["length"]] + self.asks[:, pdf["asks"]]).T

    def matrices(self, pdf: pd.DataFrame) -> np.ndarray:
        """(n, S+1, S+1) max-plus matrices of lines. State S stands before the first line."""
        s = len(STATES)
        out = np.full((len(pdf), s + 1, s + 1), -np.inf)
        e = self.emissions(pdf)
        out[:, :s, :s] = self.step + e[:, None, :]
        out[:, s, :s] = self.start + e
        return out


def _logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.5
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def fit(turns: DataFrame, lines: DataFrame) -> RoleModel:
    """Smoothed counts over the training folds of conversations. Everything is
    grouped by Spark; the driver sees sums by state and value only."""
    train = fold("conv_id", FOLDS) != HELD_OUT
    n = len(STATES)
    index = {(r, o): i for i, (r, o) in enumerate(STATES)}
    known = features(lines.filter(train & F.col("role").isNotNull()))
    tables = {}
    for name, size in (("marker", len(MARKERS)), ("length", LENGTHS), ("asks", 2)):
        tables[name] = np.zeros((n, size))
    for r in known.groupBy("role", "opens", "marker", "length", "asks").count().collect():
        for name in tables:
            tables[name][index[r["role"], r["opens"]], r[name]] += r["count"]
    start, step = np.zeros(n), np.zeros((n, n))
    spans = turns.filter(train).select("conv_id", "start", "role", F.size("lines").alias("n"))
    for r in spans.filter("start = 0 and role is not null").groupBy("role").count().collect():
        start[index[r["role"], True]] += r["count"]
    for r in spans.filter("role is not null").groupBy("role").agg(
            F.sum((F.col("n") > 1).cast("long")).alias("one"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("more")).collect():
        step[index[r["role"], True], index[r["role"], False]] += r["one"]
        step[index[r["role"], False], index[r["role"], False]] += r["more"]
    after = spans.select("conv_id", (F.col("start") + F.col("n")).alias("start"), F.col("role").alias("from_role"),
                         (F.col("n") == 1).alias("short"))
    for r in (spans.join(after, ["conv_id", "start"]).filter("role is not null and from_role is not null")
              .groupBy("from_role", "short", "role").count().collect()):
        step[index[r["from_role"], r["short"]], index[r["role"], True]] += r["count"]
    step = _logs(step)
    for (r, _), i in index.items():  # a later line continues its own role only
        for q in ROLES:
            if q != r:
                step[i, index[q, False]] = -np.inf
    begin = _logs(start)
    begin[[i for (_, o), i in index.items() if not o]] = -np.inf
    return RoleModel(begin, step, *(_logs(tables[x]) for x in ("marker", "length", "asks")))


# ------------------------------------------------------------------ Viterbi

def product(matrices: np.ndarray) -> np.ndarray:
    """Max-plus product of a sequence of matrices."""
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def path(matrices: np.ndarray, entry: int, leave: int) -> np.ndarray:
    """The best states after each matrix, from state ``entry`` to state ``leave``
    (-1: any). Ties go to the lower state."""
    score = np.full(matrices.shape[1], -np.inf)
    score[entry] = 0
    back = np.empty(matrices.shape[:2], np.int64)
    for i, m in enumerate(matrices):
        reach = score[:, None] + m
        back[i] = reach.argmax(axis=0)
        score = reach.max(axis=0)
    state = int(score.argmax()) if leave < 0 else leave
    out = np.empty(len(matrices), np.int64)
    for i in range(len(matrices) - 1, -1, -1):
        out[i] = state
        state = int(back[i, state])
    return out


_M = "conv_id long, item long, m array<double>"


def _matrices(pdf: pd.DataFrame) -> np.ndarray:
    s = len(STATES) + 1
    return np.stack([np.asarray(m, float) for m in pdf["m"]]).reshape(-1, s, s)


def _reduce(model: RoleModel | None):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        m = product(model.matrices(pdf) if model else _matrices(pdf))
        return pd.DataFrame({"conv_id": pd.array([key[0]], "Int64"), "item": [key[1]], "m": [m.ravel()]})
    return run


def _open(model: RoleModel | None):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        states = path(model.matrices(pdf) if model else _matrices(pdf), int(pdf["entry"].iloc[0]), int(pdf["leave"].iloc[0]))
        before = np.concatenate([[pdf["entry"].iloc[0]], states[:-1]])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "item": pdf["item"], "entry": before, "leave": states})
    return run


def _grouped(items: DataFrame) -> DataFrame:
    return items.withColumn("up", F.floor(F.col("item") / BLOCK))


def _below(levels: DataFrame, known: DataFrame) -> DataFrame:
    ends = known.select(F.col("conv_id").alias("c"), F.col("item").alias("up_item"), "entry", "leave")
    return _grouped(levels).join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("up_item")))


def _whole(model: RoleModel):
    """Viterbi over whole transcripts, which come one after the other in sorted rows. A
    batch's last one may go on in the next batch and is held back."""
    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        conv = pdf["conv"].to_numpy()
        cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1), len(pdf)]
        m, entry = model.matrices(pdf), len(STATES)
        leave = np.concatenate([path(m[lo:hi], entry, -1) for lo, hi in zip(cuts, cuts[1:])])
        return pd.DataFrame({"conv": conv, "line_no": pdf["item"].to_numpy(), "state": leave})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            own = (pdf["conv"] == pdf["conv"].iloc[-1]).to_numpy() if len(pdf) else np.zeros(0, bool)
            if not own.all():
                yield states(pdf[~own])
            held = pdf[own].reset_index(drop=True)
        if held is not None and len(held):
            yield states(held)
    return run


def decode_short(seen: DataFrame, model: RoleModel) -> DataFrame:
    """(conv_id, line_no, state) of transcripts short enough for one batch of rows: many to a task."""
    named = seen.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    dealt = named.drop("conv_id").repartition("conv").sortWithinPartitions("conv", "item")
    out = dealt.mapInPandas(_whole(model), "conv string, line_no long, state int")
    return out.select(F.when(F.col("conv") != "none", F.col("conv").cast("long")).alias("conv_id"), "line_no", "state")


def decode(lines: DataFrame, model: RoleModel) -> DataFrame:
    """(conv_id, line_no, state): the best state of every line, as an index of STATES. Transcripts of up to
    ``BLOCK`` lines are decoded whole, longer ones by products over blocks."""
    seen = cut_lineage(features(lines).select("conv_id", F.col("line_no").alias("item"), "marker", "length", "asks"))
    ends = cut_lineage(seen.filter(F.col("item") >= BLOCK).select(F.col("conv_id").alias("c")).distinct())
    long = F.col("conv_id").eqNullSafe(F.col("c"))
    ends = small_side(ends)
    short = decode_short(seen.join(ends, long, "left_anti"), model)
    return short.unionByName(decode_long(seen.join(ends, long, "left_semi"), model))


def decode_long(seen: DataFrame, model: RoleModel) -> DataFrame:
    """The same by blocks of lines: products up the levels, states down again."""
    s, levels = len(STATES), [seen]
    longest = seen.agg(F.max("item")).first()[0]
    if longest is None:
        return seen.select("conv_id", F.col("item").alias("line_no"), F.lit(0).alias("state"))
    while longest > 0 or len(levels) == 1:
        up = _grouped(levels[-1]).groupBy("conv_id", "up")
        levels.append(cut_lineage(up.applyInPandas(_reduce(model if len(levels) == 1 else None), _M)))
        longest //= BLOCK
    known = levels[-1].select("conv_id", "item", F.lit(s).cast("long").alias("entry"), F.lit(-1).cast("long").alias("leave"))
    for i in range(len(levels) - 2, -1, -1):
        known = (_below(levels[i], known).groupBy("conv_id", "up")
                 .applyInPandas(_open(model if i == 0 else None), "conv_id long, item long, entry long, leave long"))
        known = cut_lineage(known)
    return known.select("conv_id", F.col("item").alias("line_no"), F.col("leave").cast("int").alias("state"))


# ---------------------------------------------------------------- rendering

def render(lines: DataFrame, states: DataFrame) -> DataFrame:
    """One row a recovered turn: conv_id, turn (from 0), role, first_line, n_lines and
    rendered: ``<|im_start|>role``, the lines without their speaker marker,
    ``<|im_end|>``. Turns are numbered by running counts over blocks of lines."""
    role = F.element_at(F.array(*[F.lit(r) for r, _ in STATES]), F.col("state") + 1)
    opens = F.element_at(F.array(*[F.lit(o) for _, o in STATES]), F.col("state") + 1)
    st = states.select(F.col("conv_id").alias("c"), F.col("line_no").alias("l"), "state")
    rows = lines.join(st, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("line_no") == F.col("l")))
    rows = cut_lineage(rows.select("conv_id", "line_no", "line", role.alias("role"), opens.cast("long").alias("opens"),
                                   F.floor(F.col("line_no") / BLOCK).alias("block")))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("opens").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = (rows.withColumn("ahead", F.sum("opens").over(inside))
            .join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
            .withColumn("turn", F.col("offset") + F.col("ahead") - 1))
    marked = (_marker(F.col("line")) > 0) & (_marker(F.col("line")) < len(MARKERS) - 1) & (F.col("opens") == 1)
    body = F.when(marked, F.regexp_replace("line", MARKER + r"\s?", "")).otherwise(F.col("line"))
    turns = rows.groupBy("conv_id", "turn").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max("role").alias("role"),
        F.array_sort(F.collect_list(F.struct("line_no", body.alias("body")))).alias("held"))
    text = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"),
                    F.concat_ws("\n", F.transform("held", lambda x: x["body"])), F.lit("<|im_end|>\n"))
    return turns.select("conv_id", "turn", "role", "first_line", "n_lines", text.alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Transcripts of a conversations table, parsed back into canonical turns."""
    turns = cut_lineage(numbered(conversations))
    lines = transcribe(turns)
    model = fit(turns, lines)
    return render(lines.select("conv_id", "line_no", "line"), decode(lines, model))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
