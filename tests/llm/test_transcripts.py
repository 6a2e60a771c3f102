"""Roles against brute-force Viterbi and against the truth."""

import random

import numpy as np

from scriptorium.llm import transcripts as T

SF = "/root/testdata/sf0.01"


def parts(spark, rows):
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, line string")
    turns = T.numbered(conv)
    return conv, turns, T.transcribe(turns)


def brute(model, pdf):
    """Textbook Viterbi over one transcript."""
    e = model.emissions(pdf)
    score, back = model.start + e[0], []
    for x in e[1:]:
        reach = score[:, None] + model.step + x
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0)
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def test_blocks_give_the_exact_path(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)  # several levels even for short transcripts
    conv = spark.read.parquet(f"{SF}/conversations.parquet").filter("conv_id < 60")
    turns = T.numbered(conv)
    lines = T.transcribe(turns).cache()
    model = T.fit(turns, lines)
    got = {(r.conv_id, r.line_no): r.state for r in T.decode(lines, model).collect()}
    seen = T.features(lines).toPandas().sort_values(["conv_id", "line_no"])
    for conv_id, pdf in seen.groupby("conv_id"):
        assert pdf["line_no"].tolist() == list(range(len(pdf)))
        assert [got[conv_id, n] for n in pdf["line_no"]] == brute(model, pdf)


def test_roles_are_recovered(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = T.numbered(conv)
    lines = T.transcribe(turns).cache()
    states = T.decode(lines, T.fit(turns, lines)).toPandas()
    truth = lines.toPandas().merge(states, on=["conv_id", "line_no"])
    assert len(truth) == lines.count()
    import zlib
    held = truth["conv_id"].map(lambda c: zlib.crc32(str(c).encode()) % T.FOLDS == T.HELD_OUT)
    right = truth["role"] == truth["state"].map(lambda s: T.STATES[s][0])
    assert right[held].mean() > 0.93, right[held].mean()


def test_rendering_keeps_every_line(spark):
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "user", "hi\nthere?", None), (1, 2, "assistant", "hello", "x"),
            (2, 0, "user", None, "x"), (2, 1, "assistant", "", "x"), (2, 2, "tool", "odd role", "x"), (2, 2, "tool", "odd role", "x"),
            (3, None, None, None, None), (None, 0, "user", "no id", None)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"line {i}\nmore of {i}\n" * (1 + i % 3), "y") for i in range(700)]
    conv, turns, lines = parts(spark, rows)
    out = T.format_chats(conv).toPandas()
    assert set(out["role"]) <= set(T.ROLES)
    n = lines.groupBy("conv_id").count().toPandas()
    assert out["n_lines"].sum() == n["count"].sum()
    for _, pdf in out.groupby("conv_id", dropna=False):
        pdf = pdf.sort_values("turn")
        assert pdf["turn"].tolist() == list(range(len(pdf)))
        assert pdf["first_line"].tolist() == np.concatenate([[0], pdf["n_lines"].cumsum()[:-1]]).tolist()
    one = out[out["conv_id"] == 4].sort_values("turn")
    said = "".join(one["rendered"])
    body = said.replace("<|im_end|>", "\n").splitlines()
    assert {f"line {i}" for i in range(700)} <= set(body) and "User:" not in said and "[user]" not in said


def test_empty(spark):
    conv, _, _ = parts(spark, [])
    assert T.format_chats(conv).count() == 0


def test_product_is_associative():
    r = np.random.default_rng(1)
    m = r.standard_normal((9, 7, 7))
    assert np.allclose(T.product(m), T.product(np.stack([T.product(m[:4]), T.product(m[4:])])))


def test_no_word_of_a_text_is_lost(spark):
    """Bodies that begin like a marker come back whole."""
    rng = random.Random(12)
    starts = ["Question: ", "Answer: ", "A: ", "User: ", "[user]: ", "**AI**: ", "", "plain ", "Note: "]
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice(starts) + " ".join(rng.choices(["one", "two?", "three"], k=4)))
            for c in range(60) for t in range(8)]
    made = T.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    found = {}
    for r in made.orderBy("conv_id", "turn").collect():
        body = r.rendered.removeprefix(f"<|im_start|>{r.role}\n").removesuffix("<|im_end|>\n")
        found.setdefault(r.conv_id, []).append(body)
    assert {c: "\n".join(b) for c, b in found.items()} == {c: "\n".join(x[3] for x in rows if x[0] == c) for c in range(60)}
