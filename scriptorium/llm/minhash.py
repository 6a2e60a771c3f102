"""MinHash near-dedup with tensored banding.

Two collections of ``SIDE`` hashes each (every one made of ``DEPTH`` minhashes)
are computed for a document, and every pair (one of each collection) keys a
table: SIDE*SIDE tables of 2*DEPTH minhashes from only 2*SIDE*DEPTH minhash
values. A pair of documents is a candidate when it meets in some table, that is,
when some hash of each collection agrees; at a similarity of 0.8 a pair is missed
with probability 1 - (1 - (1 - 0.8^DEPTH)^SIDE)^2 < 6e-5, and less above.

Documents with the same shingle set are one class. A hash that a class shares
with no other class can't put it in a shared table, so only shared hashes are
paired up. Candidates are confirmed on full shingle sets (64-bit fingerprints):

1. every class against the most central class it meets in any table, and
   the components of what is confirmed;
2. what still meets across components: where a large component stands in a table,
   the other classes there against all of it and each other, in blocks; the classes of
   tables without one by an exact similarity join on prefixes. Shingles are put in one
   order, those of crowded hash buckets last; two sets similar enough share a shingle
   among the first 1/9 of the smaller and the first 1/5 of the larger one (for 80 %). A passage that
   many texts share stands behind these prefixes unless the texts are similar indeed.

So no table's members are expanded into all pairs, and every candidate pair is
either confirmed, refuted, or inside one component already.

Defined results: null, empty and word-less texts have no shingles and link with
nothing; texts of any length are hashed whole; rows with a null id keep n_shingles and have
a null component and kept true; every row is a document of its own, so different texts under one id
are settled one by one, and equal rows alike; extra columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import drop_ids, keep_narrow, mix64, shingle_set, small_side, table, texts, tidy, unused
from scriptorium.llm.components import components, roots
from scriptorium.session import cut_lineage

SIDE, DEPTH = 20, 4
SIMILARITY = 80           # percent
BLOCK = 256               # members of a component compared in one piece
PIECE = 1 << 16           # shingles hashed at once
SMALL = 8                 # a component up to this size stands for itself in no block
BUCKETS = 1 << 20         # of the shingle counts that order the prefixes

_SEEDS = mix64(np.arange(1, 2 * SIDE * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2*SIDE) table-key halves of non-empty shingle sets."""
    sizes = np.array([len(s) for s in sets])
    x, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), 2 * SIDE), np.uint64)
    for c in range(2 * SIDE):
        joined = np.full(len(sets), np.uint64(c + 1))
        for d in range(DEPTH):
            low = np.minimum.reduceat(x * _SEEDS[c * DEPTH + d], starts)
            joined = mix64(joined * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, c] = joined
    return out


def _sign(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(ids, sets):
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full]).view(np.int64) if full else None
            rows, at = [], {i: r for r, i in enumerate(full)}
            for i, (doc_id, s) in enumerate(zip(ids, sets, strict=True)):
                if i in at:
                    h = sig[at[i]]
                    rows.append((doc_id, len(s), blake2b(s.tobytes(), digest_size=16).digest(), h))
                else:
                    rows.append((doc_id, 0, None, None))
            return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"),
                                 "n_shingles": [r[1] for r in rows], "set_id": [r[2] for r in rows],
                                 "halves": [r[3] for r in rows]})

        for pdf in batches:
            ids, sets, load = [], [], 0
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                s = shingle_set(text.encode(), words) if isinstance(text, str) else np.empty(0, np.uint64)
                ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                sets.append(s)
                load += len(s)
                if load >= PIECE:
                    yield flush(ids, sets)
                    ids, sets, load = [], [], 0
            if ids:
                yield flush(ids, sets)
    return tidy(run)


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t.encode(), words).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "set_id": [blake2b(s, digest_size=16).digest() for s in sets],
                                "shingles": sets})
    return tidy(run)


def _named(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [t.encode() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": [sha256(t).hexdigest() for t in raw],
                                "set_id": [blake2b(shingle_set(t, words).tobytes(), digest_size=16).digest() for t in raw]})
    return tidy(run)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(pdf["left"], pdf["right"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]
    return tidy(run)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    size = F.length("left"), F.length("right")
    near = F.least(*size) * 100 >= F.greatest(*size) * percent
    return pairs.join(left, "a").join(right, "b").filter(near).mapInPandas(_confirm(percent), "a long, b long")


def _against_block(percent: int):
    def run(members: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(members) and len(others):
            sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
            sizes, nodes, inside = np.array([len(s) for s in sets]), members["node"].to_numpy(), members["inside"].to_numpy(bool)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for node, x in zip(others["other"].tolist(), others["theirs"], strict=True):
                s = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                hit = (100 * both >= percent * (len(s) + sizes - both)) & (nodes != node)
                links += [(node, int(m)) for m in nodes[hit & inside][:1]]  # one joins it to the whole component
                links += [(node, int(m)) for m in nodes[hit & ~inside]]
        forest = [(r, n) for n, r in roots(links).items() if r != n]
        return pd.DataFrame(forest, columns=["a", "b"]).astype("int64")
    return run


def against_components(tasks: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``tasks`` (node, component): links that join the node to the component, or to
    another node with a task for it, found by comparing it with every one of them.
    They come in blocks of ``BLOCK``, and so do the nodes; a pair of blocks gives a
    spanning forest of its links."""
    whole = members.join(tasks.select("component").distinct(), "component", "left_semi").select(
        "component", "node", F.lit(True).alias("inside")).unionByName(
        tasks.select("component", "node", F.lit(False).alias("inside")))
    n_members = whole.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    n_tasks = tasks.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    shape = keep_narrow(n_members.join(n_tasks, "component"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = (whole.join(shape, "component").join(sets, "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("part", upto("parts")))
    right = (tasks.join(shape, "component").join(sets, "node")
             .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("block", upto("blocks")))
    left = left.select("component", F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part"),
                       "node", "inside", "shingles")
    right = right.select(F.col("component").alias("of"), F.col("block").cast("int").alias("to_block"),
                         F.col("part").cast("int").alias("in_part"), F.col("node").alias("other"),
                         F.col("shingles").alias("theirs"))
    return (left.groupBy("component", "block", "part").cogroup(right.groupBy("of", "to_block", "in_part"))
            .applyInPandas(_against_block(percent), "a long, b long"))


# ------------------------------------------------------- similarity join

def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _crowds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for pdf in batches:
        for x in pdf["shingles"]:
            np.add.at(total, _bucket(np.frombuffer(x, np.uint64)), 1)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Shingles of a set of ``n`` among which one is shared: with any set similar enough of
    its size or more, and with one of any size."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _prefixes(crowded: np.ndarray, n: np.ndarray, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = np.zeros(BUCKETS, np.int64)
        weight[crowded] = n
        for pdf in batches:
            out = []
            for node, component, x in zip(pdf["node"].tolist(), pdf["component"].tolist(), pdf["shingles"], strict=True):
                s = np.frombuffer(x, np.uint64)
                few, more = prefix_lengths(len(s), percent)
                first = s[np.lexsort((s, weight[_bucket(s)]))[:more]]
                out.append(pd.DataFrame({"node": node, "component": component, "size": len(s),
                                         "shingle": first.view(np.int64), "early": np.arange(len(first)) < few}))
            if out:
                yield pd.concat(out)
    return tidy(run)


def prefix_pairs(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``classes`` (node, component) in different components that may be similar
    enough: every pair that is, and few others."""
    own = cut_lineage(classes.join(sets, "node"))
    counts = cut_lineage(own.select("shingles").mapInPandas(_crowds, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    crowded = counts.filter(F.col("n") > 4 * mean + 8).toPandas()  # a quarter of the buckets at most
    rows = cut_lineage(own.mapInPandas(_prefixes(crowded["bucket"].to_numpy(), crowded["n"].to_numpy(), percent),
                                       "node long, component long, size long, shingle long, early boolean"))
    x, y = rows.filter("early").alias("x"), rows.alias("y")
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).filter(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node"))))
        & (100 * F.col("x.size") >= percent * F.col("y.size")))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


# ----------------------------------------------------------------- candidates

def table_rows(classes: DataFrame) -> DataFrame:
    """(key, node): a class's rows in the tables it shares with another class."""
    halves = classes.select("node", F.posexplode("halves").alias("pos", "half"))
    shared = (halves.groupBy("half").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .filter("lo < hi").select("half"))
    kept = halves.join(shared, "half")
    sides = kept.groupBy("node").agg(F.collect_list(F.when(F.col("pos") < SIDE, F.col("half"))).alias("gs"),
                                     F.collect_list(F.when(F.col("pos") >= SIDE, F.col("half"))).alias("hs"))
    rows = (sides.select("node", F.explode("gs").alias("g"), "hs").select("node", "g", F.explode("hs").alias("h"))
            .select(F.xxhash64("g", "h").alias("key"), "node"))
    rows = cut_lineage(rows)
    many = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    return cut_lineage(rows.join(many, "key"))


def near_rows(docs: DataFrame, words: int = 4, percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_id (the digest of its shingles), component_id, kept."""
    docs = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sig = cut_lineage(docs.mapInPandas(_sign(words),
                                       "doc_id long, n_shingles long, set_id binary, halves array<long>"))
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    # A class is numbered, not named by an id: under one id there may be two texts. The numbers
    # are places in the checkpointed table, the same at every reading.
    reps = (keep_narrow(named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")))
            .withColumn("node", F.monotonically_increasing_id()))
    classes = cut_lineage(named.join(reps, ["doc_id", "set_id"]).select("node", "halves"))
    rows = table_rows(classes)

    # The score orders classes by the tables they share; it also names the class.
    score = F.shiftleft(F.count(F.lit(1)), 40) + F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))
    scores = keep_narrow(rows.groupBy("node").agg(score.alias("score")))
    wanted = keep_narrow(reps.join(scores.select("node"), "node", "left_semi"))
    found = (docs.join(small_side(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
             .filter("text is not null").mapInPandas(_sets(words), "doc_id long, set_id binary, shingles binary"))
    sets = cut_lineage(found.join(small_side(wanted), ["doc_id", "set_id"]).select("node", "shingles"))
    scored = cut_lineage(rows.join(scores, "node"))
    best = (scored.join(keep_narrow(scored.groupBy("key").agg(F.max("score").alias("top"))), "key")
            .groupBy("node", "score").agg(F.max("top").alias("top")).filter("top > score"))
    first = best.select(F.col("node").alias("b"), "top").join(
        scores.select(F.col("node").alias("a"), F.col("score").alias("top")), "top").select("a", "b")
    links = cut_lineage(confirm(first, sets, percent))
    joined = components(links)

    # What meets across components.
    member = keep_narrow(scores.select("node").join(joined, "node", "left")
                         .select("node", F.coalesce("component", "node").alias("component")))
    size = keep_narrow(member.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    member = keep_narrow(member.join(small_side(size), "component"))
    seen = cut_lineage(rows.join(member, "node"))
    weight = F.shiftleft(F.col("size"), 32) + F.xxhash64("component").bitwiseAND(F.lit((1 << 32) - 1))
    mixed = keep_narrow(seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                F.max(weight).alias("heavy")).filter("lo < hi").select("key", "heavy"))
    seen = cut_lineage(seen.join(mixed, "key").withColumn("in_heavy", weight == F.col("heavy")))
    large = (F.shiftright(F.col("heavy"), 32) > SMALL)
    heavy = keep_narrow(member.select("component", weight.alias("heavy")).distinct())
    tasks = keep_narrow(seen.filter(~F.col("in_heavy") & large).select("node", "heavy").distinct()
                        .join(heavy, "heavy").select("node", "component"))
    more = against_components(tasks, member.select("node", "component"), sets, percent)

    # The classes of tables in which no large component stands.
    rest = keep_narrow(seen.filter(~large).select("node", "component").distinct())
    links = links.unionByName(more).unionByName(confirm(prefix_pairs(rest, sets, percent), sets, percent))
    final = components(links)

    linked = keep_narrow(reps.select("node", "doc_id").join(final, "node"))
    least = keep_narrow(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    placed = linked.join(small_side(least), "component").select("node", "component_id")
    named_sets = cut_lineage(reps.join(placed, "node", "left")
                             .select("set_id", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = named.join(named_sets, "set_id").select("doc_id", "n_shingles", "set_id", "component_id")
    bare = sig.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", "set_id", F.col("doc_id").alias("component_id"))
    return out.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_components(docs: DataFrame, words: int = 4, percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return near_rows(docs, words, percent).drop("set_id")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """One document of each group of near copies: the one of smallest id. An id alone settles a
    row unless rows of that id differ in their fate; these are settled by id and text. Columns
    keep their names and values."""
    made = cut_lineage(near_rows(docs, words, percent).select("doc_id", "set_id", "kept"))
    gone = keep_narrow(made.filter("not kept").select("doc_id").distinct())
    both = keep_narrow(made.filter("kept").join(small_side(gone), "doc_id", "left_semi").select("doc_id").distinct())
    if not both.take(1):
        return drop_ids(docs, gone)
    unclear, name, digest = unused(docs, "unclear", "name", "digest")
    ids = small_side(both.select(F.col("doc_id").alias(unclear)))
    same = F.col("doc_id") == F.col(unclear)
    apart = docs.join(ids, same, "left_semi")
    shown = apart.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.unhex(F.lit(blake2b(b"", digest_size=16).hexdigest()))       # of a text without words
    told = shown.mapInPandas(_named(words), "doc_id long, set_id binary, digest string")
    stays = keep_narrow(told.join(made.filter("kept").withColumn("set_id", F.coalesce("set_id", bare)).distinct(), ["doc_id", "set_id"])
                        .select(F.col("doc_id").alias(name), F.col("digest").alias(digest)).distinct())
    kept = apart.join(small_side(stays), (F.col("doc_id") == F.col(name))
                      & (F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col(digest)), "left_semi")
    return drop_ids(docs.join(ids, same, "left_anti"), gone).unionByName(kept)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents", "doc_id", "text"))


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
           else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh
  from w where ws is not null),
n as (select doc_id, count(*) as k from s group by 1),
-- exact: two sets of which one holds 80 % of the other share a shingle
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id
      group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y
      where 100 * common >= 80 * (nx.k + ny.k - common)),
u as (select x, y from e union select y, x from e),
r as (select doc_id as x, doc_id as root from documents
      union select u.y, r.root from r join u on u.x = r.x),
c as (select x, min(root) as component_id from r group by 1)
select d.doc_id, coalesce(n.k, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join c on c.x = d.doc_id
"""
