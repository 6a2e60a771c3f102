"""Vector code compression by dual-tree Lloyd rounds in whole numbers.

A vector's components become integers (``floor(SCALE * x)``), cut into ``PARTS`` equal
parts; each part position has a codebook of ``ENTRIES``, and a vector's code is its parts'
nearest entries. Vectors are held in blocks. For every part position a block has a tree over
its parts, built once: halves at the median of the widest direction, and for every node the
bounding box and the cached sum of its parts. A round builds a small tree over the entries
as well and walks pairs of nodes. An entry node whose box is farther from a part node's box than
another's farthest corner is pruned for the whole node; a node left with one entry
is assigned by its cached sum and count; only the parts of leaves that several
entries still claim are compared one by one. All distances and bounds are exact
integers, so ties (to the lower entry) are exact as well.

A round returns sums and counts, added up by Spark: at most one row per entry and
component reaches the driver, whatever the number of vectors.

Defined results: a null vector, and one with a null or non-finite component, is
dropped; so is one whose length isn't that of the vector of smallest id. Components beyond
the range in which squared distances fit into 64 bits (about 32,000 at 64
components) count as its ends. A length that ``PARTS`` doesn't divide is filled up with
zeros. A null id comes last in the order of ids, and is kept; of one id the smaller vector
comes first; repeated rows are vectors of their own; null labels are one label; with fewer than
``ENTRIES`` vectors there are as many entries; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import inf, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import small_side, table
from scriptorium.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 16                 # parts of a leaf, about
BLOCK = 1 << 18           # components of a block

_BLOCKS = "n int, ids array<string>, labels array<string>, points binary, place binary, lo binary, hi binary, sums binary"


# -------------------------------------------------------------- the trees

def depth_of(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def starts_of(n: int, level: int) -> np.ndarray:
    """First part of each of a level's nodes; nodes of the next level halve them."""
    return (np.arange(1 << level, dtype=np.int64) * n) >> level


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree over (n, w) parts: the order of the parts, and of all nodes, level
    after level, the corners of their boxes and the sums of their parts."""
    n, order = len(points), np.arange(len(points))
    lo, hi, sums = [], [], []
    for level in range(depth_of(n) + 1):
        starts, p = starts_of(n, level), points[order]
        lo.append(np.minimum.reduceat(p, starts))
        hi.append(np.maximum.reduceat(p, starts))
        sums.append(np.add.reduceat(p, starts, dtype=np.int64))
        if level < depth_of(n):
            node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            widest = (hi[-1] - lo[-1]).argmax(1)
            order = order[np.lexsort((p[np.arange(n), widest[node]], node))]
    return order, np.concatenate(lo), np.concatenate(hi), np.concatenate(sums)


def entry_tree(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree over a codebook: boxes of the nodes, their entry (-1: an inner node)
    and their two children. Of equal entries only the first is in it."""
    lo, hi, entry, children = [], [], [], []

    def add(ids: np.ndarray) -> int:
        at, box = len(lo), entries[ids]
        lo.append(box.min(0))
        hi.append(box.max(0))
        entry.append(ids[0] if len(ids) == 1 else -1)
        children.append((at, at))
        if len(ids) > 1:
            ids = ids[np.argsort(box[:, (hi[at] - lo[at]).argmax()], kind="stable")]
            children[at] = (add(ids[:len(ids) // 2]), add(ids[len(ids) // 2:]))
        return at

    add(np.sort(np.unique(entries, axis=0, return_index=True)[1]))
    return np.array(lo), np.array(hi), np.array(entry), np.array(children)


def _each(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1, one run after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def claims(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray):
    """Nearest entries of a tree's parts (in tree order): (nodes, their entry) of nodes
    assigned whole, and (parts, their entry) of those compared one by one."""
    n, deepest = len(points), depth_of(len(points))
    e_lo, e_hi, e_entry, e_children = entry_tree(entries)
    e_width = ((e_hi - e_lo) ** 2).sum(1)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)     # pairs, those of a node together
    whole, leaves = [], []
    while len(node):
        a, b, c, d = lo[node], hi[node], e_lo[other], e_hi[other]
        near = (np.maximum(0, np.maximum(c - b, a - d)) ** 2).sum(1)
        far = (np.maximum(np.abs(d - a), np.abs(b - c)) ** 2).sum(1)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(np.append(first, len(node)))
        keep = near <= np.repeat(np.minimum.reduceat(far, first), sizes)
        node, other = node[keep], other[keep]

        first = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(np.append(first, len(node)))
        one = e_entry[other] >= 0
        all_single = np.minimum.reduceat(one, first)
        own = node[first]
        bottom = own >= (1 << deepest) - 1
        done = (sizes == 1) & all_single
        open_leaf = ~done & all_single & bottom
        whole.append((own[done], e_entry[other[first[done]]]))
        leaves.append((own[open_leaf], other[_each(first[open_leaf], sizes[open_leaf])], sizes[open_leaf]))

        # Of the two sides the wider one is split.
        wider = ((hi[own] - lo[own]) ** 2).sum(1) >= np.maximum.reduceat(e_width[other], first)
        halve = ~done & ~bottom & (all_single | wider)
        refine = ~done & ~open_leaf & ~halve
        pairs = _each(first[halve], sizes[halve])
        h_node, h_other = node[pairs], other[pairs]
        pairs = _each(first[refine], sizes[refine])
        r_node, r_other = node[pairs], other[pairs]
        twice = 1 + (e_entry[r_other] < 0)
        r_children = e_children[r_other].ravel()[np.column_stack([np.ones(len(twice), bool), twice > 1]).ravel()]
        node = np.concatenate([2 * h_node + 1, 2 * h_node + 2, np.repeat(r_node, twice)])
        other = np.concatenate([h_other, h_other, r_children])
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]

    nodes, got = (np.concatenate(x) for x in zip(*whole, strict=True))
    l_node, l_other, l_size = (np.concatenate(x) for x in zip(*leaves, strict=True))
    starts = np.append(starts_of(n, deepest), n)
    leaf = l_node - ((1 << deepest) - 1)
    span = starts[leaf + 1] - starts[leaf]
    # every part of an open leaf against each entry that the leaf still has
    width = np.repeat(span, l_size)
    part = _each(np.repeat(starts[leaf], l_size), width)
    entry = np.repeat(e_entry[l_other], width)
    distance = ((points[part] - entries[entry]) ** 2).sum(1)
    best = np.lexsort((entry, distance, part))
    best = best[np.flatnonzero(np.diff(part[best], prepend=-1))]
    return (nodes, got), (part[best], entry[best])


def span_of(node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of tree nodes."""
    level = np.frexp(node + 1)[1].astype(np.int64) - 1
    at = node + 1 - (np.int64(1) << level)
    start = (at * n) >> level
    return start, (((at + 1) * n) >> level) - start


# --------------------------------------------------------------- in the tasks

def _blocks(parts: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, n = max(LEAF, BLOCK // max(1, parts * width)), [], 0

        def block() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            x = np.zeros((len(pdf), parts * width), np.int64)
            x[:, :len(pdf["q"].iloc[0])] = np.stack(pdf["q"].to_numpy())
            trees = [grow(x[:, p * width:(p + 1) * width]) for p in range(parts)]
            place, lo, hi, sums = (np.stack(t) for t in zip(*trees, strict=True))
            points = np.stack([x[o, p * width:(p + 1) * width] for p, o in enumerate(place)])
            raw = [points.astype(np.int32), place.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), sums]
            return pd.DataFrame([(len(pdf), pdf["id"].tolist(), pdf["label"].tolist(), *(r.tobytes() for r in raw))],
                                columns=["n", "ids", "labels", "points", "place", "lo", "hi", "sums"])

        for pdf in batches:
            for s in range(0, len(pdf), rows):
                piece = pdf.iloc[s:s + rows - n]
                held.append(piece)
                n += len(piece)
                if n >= rows:
                    yield block()
                    n = 0
                    rest = pdf.iloc[s + len(piece):s + rows]
                    if len(rest):
                        held.append(rest)
                        n = len(rest)
        if n:
            yield block()
    return run


def _unpack(row, parts: int, width: int):
    number = lambda b, kind: np.frombuffer(b, kind).reshape(parts, -1, width)
    points, lo, hi = (number(b, np.int32).astype(np.int64) for b in (row.points, row.lo, row.hi))
    return points, lo, hi, number(row.sums, np.int64), np.frombuffer(row.place, np.int32).reshape(parts, -1)


def _totals(codebooks: np.ndarray):
    parts, k, width = codebooks.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                points, lo, hi, sums, _ = _unpack(row, parts, width)
                for p in range(parts):
                    (node, a), (part, b) = claims(points[p], lo[p], hi[p], codebooks[p])
                    np.add.at(total[p], a, sums[p][node])
                    np.add.at(count[p], a, span_of(node, row.n)[1])
                    np.add.at(total[p], b, points[p][part])
                    np.add.at(count[p], b, 1)
        rows = [(p, e, int(count[p, e]), total[p, e].tolist()) for p in range(parts) for e in range(k) if count[p, e]]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])
    return run


def _codes(codebooks: np.ndarray):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                points, lo, hi, _, place = _unpack(row, parts, width)
                code, error = np.empty((row.n, parts), np.uint8), np.zeros(row.n, np.int64)
                for p in range(parts):
                    (node, a), (part, b) = claims(points[p], lo[p], hi[p], codebooks[p])
                    entry = np.empty(row.n, np.int64)
                    start, n = span_of(node, row.n)
                    entry[_each(start, n)] = np.repeat(a, n)
                    entry[part] = b
                    code[place[p], p] = entry
                    error[place[p]] += ((points[p] - codebooks[p][entry]) ** 2).sum(1)
                yield pd.DataFrame({"vec_id": list(row.ids), "label": list(row.labels),
                                    "code": [c.tobytes().hex() for c in code], "error": error})
    return run


# ---------------------------------------------------------------- operator

def _whole(v: Column, limit: int) -> Column:
    def one(x):
        return F.floor(F.greatest(F.least(x * SCALE, F.lit(float(limit))), F.lit(float(-limit)))).cast("int")
    return F.transform(v, one)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
             ) -> tuple[DataFrame, np.ndarray]:
    """``vectors``: vec_id, embedding, label. Returns (vec_id, label as text, code,
    error) per kept vector and the codebooks, an array (parts, entries, width)."""
    if entries > 256:
        raise ValueError("a code has one byte a part")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf))))
    schema = "vec_id long, label string, code string, error long"
    smallest = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").take(entries)  # the first entries of the codebooks
    if not smallest:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    length = len(smallest[0].v)
    width = -(-length // parts)
    limit = isqrt((1 << 59) // width) // 2
    rows = rows.filter(F.size("v") == length)
    smallest = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select(_whole(F.col("v"), limit).alias("q")).collect()
    first = np.zeros((len(smallest), parts * width), np.int64)
    first[:, :length] = [r.q for r in smallest]
    codebooks = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    ready = rows.select(F.col("id").cast("string").alias("id"), "label", _whole(F.col("v"), limit).alias("q"))
    blocks = cut_lineage(ready.mapInPandas(_blocks(parts, width), _BLOCKS))
    trees = blocks.drop("ids", "labels")
    for _ in range(rounds):
        sums = (trees.mapInPandas(_totals(codebooks), "part int, entry int, n long, sums array<long>")
                .select("part", "entry", "n", F.posexplode("sums").alias("pos", "x"))
                .groupBy("part", "entry", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")))
        codebooks = codebooks.copy()
        for r in sums.collect():  # at most one row a number of the codebooks
            codebooks[r.part, r.entry, r.pos] = r.x // r.n
    codes = blocks.mapInPandas(_codes(codebooks), "vec_id string, label string, code string, error long")
    return codes.withColumn("vec_id", F.col("vec_id").cast("long")), codebooks


def digest(codebooks: np.ndarray) -> str:
    return sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds the error summed over the rows of the same label. Sums are joined back
    by label: broadcast when their counted number allows."""
    sums = small_side(cut_lineage(codes.groupBy("label").agg(F.sum("error").alias("label_error"))
                                  .withColumnRenamed("label", "of")))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    out = with_label_error(cut_lineage(codes))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    nearest = """a{r} as materialized (
  select vec_id, part, x, min([d, e]) as best from (
    select p.vec_id, p.part, p.x, c.e,
           list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from p join c{r} c on c.part = p.part) group by all)"""
    updated = """c{s} as materialized (
  select c.part, c.e, coalesce(n.c, c.c) as c from c{r} c left join (
    select part, e, list(m order by pos) as c from (
      select part, e, pos, floor(sum(v)::double / count(*))::bigint as m from (
        select part, best[2] as e, unnest(x) as v, unnest(range(1, len(x) + 1)) as pos from a{r}) group by 1, 2, 3)
    group by 1, 2) n on n.part = c.part and n.e = c.e)"""
    steps = ",\n".join(nearest.format(r=r) + ",\n" + updated.format(r=r, s=r + 1) for r in range(ROUNDS))
    return f"""
with k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, q[part * len(q) // {PARTS} + 1:(part + 1) * len(q) // {PARTS}] as x
                   from k, (select unnest(range({PARTS})) as part)),
c0 as materialized (
  select part, (row_number() over (partition by part order by vec_id) - 1)::bigint as e, x as c
  from p where vec_id in (select vec_id from k order by vec_id limit {ENTRIES})),
{steps},
{nearest.format(r=ROUNDS)},
f as (select vec_id, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error
      from a{ROUNDS} group by 1),
s as (select sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' order by part, e)) as sha from c{ROUNDS})
select k.vec_id, f.code, f.error, (sum(f.error) over (partition by k.label))::bigint as label_error,
       (select sha from s) as codebooks_sha256
from k join f using (vec_id)
"""


OP13_SQL = _sql()
