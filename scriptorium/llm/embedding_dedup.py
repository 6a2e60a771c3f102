"""Near-dedup of embeddings by Euclidean p-stable hashing.

Vectors are normalised and projected on Gaussian directions; a projection plus a
random offset, divided by the width and rounded down, is one hash, and ``depth``
hashes key a table. Vectors of one label that share a bucket in any table are
compared by exact cosine in double precision. Depth and number of tables follow
from the number of vectors of the largest label and from ``MISS``, the chance that
a pair at the threshold meets in no table.

Equal vectors are one class with a multiplicity. Buckets are compared in blocks of
``BLOCK`` by ``BLOCK`` vectors, many small buckets to a task; a block gives counts
per vector and a spanning forest of its links, never its pairs, and a pair is
counted only in the first table it shares.

Defined results: a null label or vector, a zero vector, and one with a null or
non-finite component link with nothing; vectors of different length don't either;
every input row is a vector of its own, so a row repeated under one id links with
its twin, and different vectors under one id have links of their own; a null id links with nothing; extra columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import keep_narrow, mix64, small_side, table
from scriptorium.llm.components import components, roots
from scriptorium.session import cut_lineage

COSINE = 0.98
WIDTH = 1.6               # of a hash cell, for unit vectors
MISS = 1e-6               # chance to miss a pair at the threshold
CHANCE = 0.02             # unrelated vectors of one label met by a vector in a table, about
BLOCK = 512
TASK_ROWS = 20_000        # bucket rows compared in one task, about


def collide(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a distance get the same p-stable hash."""
    t = width / distance
    below = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(largest: int, cosine: float = COSINE) -> tuple[int, int]:
    """(depth, tables) for ``largest`` vectors under one label."""
    near, far = collide(math.sqrt(2 - 2 * cosine)), collide(math.sqrt(2))
    depth = max(6, math.ceil(math.log(max(largest, 2) / CHANCE) / -math.log(far)))
    return depth, math.ceil(math.log(MISS) / math.log(1 - near ** depth))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_keys(x: np.ndarray, labels: np.ndarray, depth: int, tables: int) -> np.ndarray:
    """(n, tables) 64-bit bucket keys of unit vectors of one dimension."""
    n, dim = x.shape
    r = np.random.default_rng([97, dim])
    keys = np.empty((n, tables), np.uint64)
    base = mix64(labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
    for t in range(tables):
        cells = np.floor((x @ r.standard_normal((dim, depth)) + r.random(depth) * WIDTH) / WIDTH).astype(np.int64)
        key = base + np.uint64(t + 1)
        for d in range(depth):
            key = mix64(key * np.uint64(0xA24BAED4963EE407) + cells[:, d].view(np.uint64))
        keys[:, t] = key
    return keys


def _keys(depth: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["embedding"].map(len)):
                keys = table_keys(unit(np.stack(part["embedding"].to_list())), part["label"].to_numpy(), depth, tables)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "many": part["many"].to_numpy(),
                                    "embedding": part["embedding"].to_list(), "keys": list(keys.view(np.int64))})
    return run


def compare(x: np.ndarray, y: np.ndarray, xk: np.ndarray, yk: np.ndarray, t: int, cosine: float) -> np.ndarray:
    """Which pairs link and share no table before ``t``."""
    near = x @ y.T >= cosine
    if near.any():
        i, j = np.nonzero(near)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            near[a, b] = ~(xk[a, :t] == yk[b, :t]).any(axis=1)
    return near


def _compare_units(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "left", "right"], kind="stable").reset_index(drop=True)
        unit_id = pdf[["key", "left", "right"]].to_numpy()
        cuts = np.flatnonzero((unit_id[1:] != unit_id[:-1]).any(axis=1)) + 1
        counts: dict[int, int] = {}
        links: list[tuple[int, int]] = []
        nodes, many = pdf["node"].to_numpy(), pdf["many"].to_numpy()
        chunk, table_no = pdf["chunk"].to_numpy(), pdf["t"].to_numpy()
        for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
            if hi - lo < 2:
                continue
            rows = np.arange(lo, hi)
            _, left, right = unit_id[lo]
            a, b = rows[chunk[lo:hi] == left], rows[chunk[lo:hi] == right]
            if len(a) == 0 or len(b) == 0:
                continue
            load = lambda at: (unit(np.stack(pdf["embedding"].iloc[at].to_list())),
                               np.stack(pdf["keys"].iloc[at].to_list()))
            (x, xk), (y, yk) = load(a), load(b) if left != right else (None, None)
            if left == right:
                y, yk = x, xk
            near = compare(x, y, xk, yk, int(table_no[lo]), cosine)
            if left == right:
                np.fill_diagonal(near, False)
            for at, total in ((a, near @ many[b]), (b, many[a] @ near) if left != right else ((), ())):
                for node, n in zip(nodes[at] if len(at) else (), total, strict=True):
                    if n:
                        counts[node] = counts.get(node, 0) + int(n)
            i, j = np.nonzero(near)
            if len(i):
                # a spanning forest of the block's links
                found = roots(zip(nodes[a[i]].tolist(), nodes[b[j]].tolist(), strict=True))
                links += [(r, n) for n, r in found.items() if r != n]
        forest = [(r, n) for n, r in roots(links).items() if r != n]
        out = [(n, c, None) for n, c in counts.items()] + [(n, 0, r) for r, n in forest]
        return pd.DataFrame({"node": pd.array([o[0] for o in out], "Int64"), "n": pd.array([o[1] for o in out], "Int64"),
                             "root": pd.array([o[2] for o in out], "Int64")})
    return run


def near_components(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()
             & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
             & F.exists(e, lambda v: v != 0))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
            .withColumn("sound", F.coalesce(sound, F.lit(False))))
    # 128 bits name a (label, vector)
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    # a class is numbered by its place in the checkpointed table, not named by an id: there may be two vectors under one
    classes = keep_narrow(rows.filter("sound").groupBy("h1", "h2", "label").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("many"))).withColumn("node", F.monotonically_increasing_id())
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    depth, tables = shape(largest, cosine)
    named = (rows.filter("sound").join(classes, ["h1", "h2", "label", "vec_id"])
             .dropDuplicates(["node"]).select("node", "many", "label", "embedding"))
    hashed = cut_lineage(named.mapInPandas(_keys(depth, tables), "node long, many long, embedding array<double>, keys array<long>"))
    entries = hashed.select("node", F.posexplode("keys").alias("t", "key"))
    shared = keep_narrow(entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"),
                                                    F.count(F.lit(1)).alias("size")).filter("lo < hi").select("key", "size"))
    met = entries.join(shared, "key").withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a chunk meets itself and every other chunk of its bucket once
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", "t", "node", "chunk", F.least("chunk", "other").cast("int").alias("left"),
        F.greatest("chunk", "other").cast("int").alias("right"))
    units = cut_lineage(units)
    tasks = max(1, -(-units.count() // TASK_ROWS))
    units = units.withColumn("task", F.pmod(F.xxhash64("key", "left", "right"), F.lit(tasks)))
    done = cut_lineage(units.join(hashed, "node").groupBy("task").applyInPandas(
        _compare_units(cosine), "node long, n long, root long"))
    counts = done.filter("root is null").groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(done.filter("root is not null").select(F.col("root").alias("a"), F.col("node").alias("b")))
    known = keep_narrow(classes.join(counts, "node", "left").join(joined, "node", "left").select(
        "h1", "h2", "label", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component")))
    least = small_side(keep_narrow(known.groupBy("component").agg(F.min("vec_id").alias("component_id"))))
    known = known.drop("vec_id").join(least, "component")
    out = rows.filter("sound").join(known, ["h1", "h2", "label"]).select("vec_id", "n_links", "component_id")
    bare = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(bare).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP2_SQL = f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e,
         label is not null and embedding is not null
         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
         and len(list_filter(embedding, lambda x: x <> 0)) > 0 as sound
  from embeddings),
p as (select a.vec_id as x, b.vec_id as y from v a join v b
      on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
      where a.sound and b.sound and list_cosine_similarity(a.e, b.e) >= {COSINE}),
u as (select x, y from p union all select y, x from p),
n as (select x, count(*) as n_links from u group by 1),
r as (select vec_id as x, vec_id as root from v union select u.y, r.root from r join u on u.x = r.x),
c as (select x, min(root) as component_id from r group by 1)
select v.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v left join n on n.x = v.vec_id join c on c.x = v.vec_id
"""
