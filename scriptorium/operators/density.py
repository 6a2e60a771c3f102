"""Density clustering of document vectors, with noise (-1) and strengths.

Hierarchical density clustering in Spark rounds; no step gathers the vectors, the
graph or the hierarchy in one task or on the driver:

1. ``neighbour_graph``: equal vectors become one node with its number of copies.
   First neighbours come from random orders: a code of hyperplane sides sorts
   the vectors, and every vector meets those around it. Then rounds of neighbour
   exchange compare the neighbours of each vector with each other.
2. ``core_distances`` and ``spanning_tree``: an edge weighs the largest of its length
   and its ends' core distances; every Boruvka round picks each component's
   lightest edge and contracts.
3. ``merges``: the single-linkage hierarchy of the tree. A tree with more than ``bound``
   edges is split at its median edge: the components of the lighter half are hierarchies of their own,
   and single nodes of the heavier half. Problems of at most ``bound`` edges are then
   solved side by side, each by one walk over its edges.
4. ``condense``, ``select``: splits into two sides of ``min_size`` vectors or more make clusters;
   other sides fall out as points. Of a cluster and its descendants the more stable choice stands.

Nodes and edges are numbered without gaps, edges by weight, so that every pick is a minimum of
one number (a hash aggregate that combines before the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage, landed, landing, shuffle_slots

NEIGHBOURS = 15           # of a vector in the graph
MIN_SAMPLES = 10          # vectors within the core distance, the vector itself among them
MIN_SIZE = 10             # vectors of a cluster
ORDERS = 4                # random orders that give the first neighbours
EXCHANGES = 3             # rounds of neighbour exchange
SIDES = 48                # hyperplanes of an order's code
AROUND = 128              # vectors of a sorted run compared with each other and with the next run
GROUPS = 256              # groups whose members are compared in one step
BOUND = 1 << 18           # edges of a hierarchy that one task walks
NEAREST = 1e-6            # smaller distances count as this one in strengths
NOISE = -1


# ---------------------------------------------------------------- numbering

def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of the columns ``order``, which must
    tell rows apart. Rows are range-partitioned and sorted; the driver sees one count a partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = landed(placed.withColumn("_part", F.spark_partition_id())
                         .withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    if not before:
        return placed.drop("_part", "_row").withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.map_from_arrays(F.lit(list(before)), F.lit(list(before.values()))), F.col("_part"))
    row = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, offset.cast("long") + row).drop("_part", "_row")


def nearest_per(df: DataFrame, key: str, n: int, *order: Column, spread: str) -> DataFrame:
    """The first ``n`` rows of each key. Ranked within (key, hash of ``spread``) first,
    so no task sorts a popular key whole."""
    salt = F.pmod(F.xxhash64(spread), F.lit(shuffle_slots(df)))
    ranked = (df.withColumn("_salt", salt)
              .withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).filter(F.col("_r") <= n))
    return (ranked.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
            .filter(F.col("_r") <= n).drop("_salt", "_r"))


def climb(links: DataFrame) -> DataFrame:
    """``links`` (x, up): follows ``up`` to its end. Every round doubles the way."""
    links = landed(links)
    while True:
        nxt = links.select(F.col("x").alias("up"), F.col("up").alias("far"))
        step = landed(links.join(nxt, "up", "left").select(
            "x", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")))
        links = step.select("x", "up")
        if not step.filter("moved").take(1):
            return links


# ------------------------------------------------------------------- graph

def vector_nodes(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(nodes, members). nodes: (node, x, copies), one per distinct direction, ``x`` the
    unit vector as 32-bit floats; members: (id, node). Null, empty and zero vectors, those with
    a null or non-finite component and those whose length isn't the commonest have no node."""
    v = F.col(vec_col).cast("array<double>")
    rows = vecs.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).take(1)
    length = lengths[0]["n"] if lengths else 0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.filter(F.size("v") == length).withColumn("norm", norm).filter("norm > 0")
    unit = F.zip_with("v", F.array_repeat("norm", F.size("v")), lambda x, n: (x / n).cast("float"))
    rows = landed(rows.select("id", unit.alias("x")).withColumn("same", F.sha2(F.to_binary(F.array_join(
        F.transform("x", lambda c: c.cast("string")), ","), F.lit("utf-8")), 256)))
    first = rows.groupBy("same").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    heads = rows.join(first, ["same", "id"]).dropDuplicates(["same"])
    nodes = numbered(heads.select("same", "x", "copies"), ["same"], "node")
    members = rows.select("id", "same").join(nodes.select("same", "node"), "same").select("id", "node")
    return landed(nodes.select("node", "x", "copies")), members


def _top(ids: np.ndarray, d: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of ``others`` per row of the distances ``d``; the row's own id is left out."""
    d = np.where(others[None, :] == ids[:, None], np.inf, d)
    k = min(k, d.shape[1])
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(d, at, 1)
    rows = pd.DataFrame({"a": np.repeat(ids, k), "b": others[at].ravel(), "d": near.ravel()})
    return rows[np.isfinite(rows["d"])]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))


def _codes(seed: int, orders: int, length: int, center: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(seed).normal(size=(orders, length, SIDES + 1))
        bits = np.int64(1) << np.arange(SIDES, dtype=np.int64)[::-1]
        for pdf in batches:
            for o in range(orders if len(pdf) else 0):
                side = (np.stack(pdf["x"].to_numpy()) - np.array(center)) @ planes[o]
                yield pd.DataFrame({"turn": o, "node": pdf["node"], "x": pdf["x"], "code": (side[:, :SIDES] > 0) @ bits,
                                    "place": side[:, SIDES]})
    return run


def _around(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, ids, x = None, None, None             # the run before
        for pdf in batches:
            for now, rows in pdf.groupby("turn"):
                for s in range(0, len(rows), AROUND):
                    part = rows.iloc[s:s + AROUND]
                    new_ids, new_x = part["node"].to_numpy(), np.stack(part["x"].to_numpy())
                    all_ids, all_x = new_ids, new_x
                    if now == turn:
                        all_ids, all_x = np.concatenate([ids, new_ids]), np.concatenate([x, new_x])
                    if len(all_ids) > 1:
                        yield _top(all_ids, _distances(all_x, all_x), all_ids, k)
                    turn, ids, x = now, new_ids, new_x
    return run


def _exchange(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pdf["ids"].map(len).to_numpy()
            for n in np.unique(counts):             # groups of one size are compared together
                alike = np.flatnonzero(counts == n)
                for s in range(0, len(alike), GROUPS):
                    rows = pdf.iloc[alike[s:s + GROUPS]]
                    yield _closer(*(np.concatenate(rows[c].to_numpy()) for c in ("ids", "worst")),
                                  np.stack([x for xs in rows["xs"] for x in xs]), int(n), k)
    return run


def _closer(ids: np.ndarray, worst: np.ndarray, x: np.ndarray, n: int, k: int) -> pd.DataFrame:
    """Of groups of ``n`` rows each: the k nearest of a row's group that are closer than its ``worst``."""
    ids, worst, x = ids.reshape(-1, n), worst.reshape(-1, n), x.astype(np.float64).reshape(len(ids) // n, n, -1)
    length = (x * x).sum(2)
    d = np.sqrt(np.maximum(0.0, length[:, :, None] + length[:, None, :] - 2 * x @ x.transpose(0, 2, 1)))
    d = np.where(ids[:, None, :] == ids[:, :, None], np.inf, d)
    k = min(k, n)
    at = np.argpartition(d, k - 1, axis=2)[:, :, :k]
    near = np.take_along_axis(d, at, 2)
    others = np.take_along_axis(np.broadcast_to(ids[:, None, :], d.shape), at, 2)
    better = np.isfinite(near) & (near < worst[:, :, None])
    return pd.DataFrame({"a": np.broadcast_to(ids[:, :, None], near.shape)[better], "b": others[better], "d": near[better]})


_EDGE = "a long, b long, d double"


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest per node, each neighbour once."""
    once = edges.groupBy("a", "b").agg(F.min("d").alias("d"))
    return landed(nearest_per(once, "a", k, F.col("d"), F.col("b"), spread="b"))


def neighbour_graph(nodes: DataFrame, k: int = NEIGHBOURS, orders: int = ORDERS, exchanges: int = EXCHANGES, seed: int = 42) -> DataFrame:
    """(a, b, d): about the ``k`` nearest nodes of every node."""
    first = nodes.select(F.size("x").alias("n")).take(1)
    if not first:
        return nodes.sparkSession.createDataFrame([], _EDGE)
    length = first[0]["n"]
    parts = nodes.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.avg("c").alias("m")).collect()
    center = [r["m"] for r in sorted(parts)]  # one number a component
    coded = nodes.select("node", "x").mapInPandas(_codes(seed, orders, length, center),
                                                  "turn int, node long, x array<float>, code long, place double")
    order = ["turn", "code", "place"]
    found = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("turn", "node", "x").mapInPandas(_around(k), _EDGE)
    graph = _best(found, k)
    for _ in range(exchanges):
        # A node hears from its neighbours and from the k nearest that name it, so
        # nobody's group has more than 2 k members, nor is anybody in more groups.
        named = nearest_per(graph, "b", k, F.col("d"), F.col("a"), spread="a")
        groups = (named.select(F.col("a").alias("u"), F.col("b").alias("node"))
                  .unionByName(named.select(F.col("b").alias("u"), F.col("a").alias("node"))).distinct())
        worst = graph.groupBy(F.col("a").alias("node")).agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n"))
        worst = worst.select("node", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("worst")).alias("worst"))
        members = groups.join(nodes.select("node", "x").join(worst, "node"), "node")
        rows = members.groupBy("u").agg(F.collect_list(F.struct("node", "worst", "x")).alias("m")).filter(F.size("m") > 1)
        better = rows.select(F.col("m.node").alias("ids"), F.col("m.worst").alias("worst"), F.col("m.x").alias("xs")).mapInPandas(_exchange(k), _EDGE)
        graph = _best(graph.unionByName(better), k)
    return graph


def core_distances(graph: DataFrame, nodes: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(node, core): the distance within which ``min_samples`` vectors lie, copies counted
    and the node's own among them; that of its farthest known neighbour if it has fewer."""
    copies = nodes.select(F.col("node").alias("b"), "copies")
    so_far = F.sum("copies").over(Window.partitionBy("a").orderBy("d", "b").rowsBetween(Window.unboundedPreceding, 0))
    reach = graph.join(copies, "b").withColumn("seen", so_far)   # k rows a node
    own = nodes.select(F.col("node").alias("a"), F.col("copies").alias("own"))
    cores = (reach.join(own, "a").groupBy("a")
             .agg(F.max("own").alias("own"), F.min(F.when(F.col("seen") + F.col("own") >= min_samples, F.col("d"))).alias("core"),
                  F.max("d").alias("far")))
    cores = nodes.select(F.col("node").alias("a"), F.col("copies")).join(cores, "a", "left")
    return cores.select(F.col("a").alias("node"), F.when(F.col("copies") >= min_samples, F.lit(0.0))
                        .otherwise(F.coalesce("core", "far", F.lit(0.0))).alias("core"))


# -------------------------------------------------------------------- tree

def spanning_tree(graph: DataFrame, cores: DataFrame) -> DataFrame:
    """(e, a, b, w): a minimum spanning forest of the graph under w = max(d, both core
    distances), its edges numbered by weight from 0."""
    pairs = (graph.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d")))
    ca, cb = (cores.select(F.col("node").alias(c), F.col("core").alias(f"core_{c}")) for c in "ab")
    weighed = pairs.join(ca, "a").join(cb, "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    edges = landed(numbered(weighed, ["w", "a", "b"], "e"))
    left, picked = edges.select("e", F.col("a").alias("p"), F.col("b").alias("q")), None
    while True:
        left = landed(left)
        ends = left.select(F.col("p").alias("x"), "e").unionByName(left.select(F.col("q").alias("x"), "e"))
        lightest = ends.groupBy("x").agg(F.min("e").alias("e"))
        picks = landed(lightest.join(left, "e").select("x", "e", F.when(F.col("x") == F.col("p"), F.col("q")).otherwise(F.col("p")).alias("up")))
        if not picks.take(1):
            break
        chosen = picks.select("e").distinct()
        picked = chosen if picked is None else picked.unionByName(chosen)
        # Two components that pick the same edge would point at each other: the smaller one is the root.
        back = picks.select(F.col("x").alias("up"), F.col("e").alias("back"))
        links = picks.join(back, "up").filter((F.col("e") != F.col("back")) | (F.col("x") > F.col("up"))).select("x", "up")
        roots = climb(links)
        for c in "pq":
            to = roots.select(F.col("x").alias(c), F.col("up").alias("root"))
            left = left.join(to, c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        left = (left.filter("p <> q").groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min("e").alias("e")))
    if picked is None:
        return edges.limit(0)
    return numbered(edges.join(picked, "e").drop("e"), ["w", "a", "b"], "e")


# --------------------------------------------------------------- hierarchy

def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    problem, parent, size = None, {}, {}
    for pdf in batches:
        out = []
        for prob, e, u, v, nu, nv, top, w in zip(*(pdf[c].tolist() for c in ("problem", "e", "u", "v", "nu", "nv", "top", "w")), strict=True):
            if prob != problem:
                problem, parent, size = prob, {}, {}
            ends = []
            for x, n in ((u, nu), (v, nv)):
                if x not in parent:
                    parent[x], size[x] = x, n
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                ends.append(x)
            x, y = ends
            out.append((top, x, y, size[x], size[y], w))
            parent[x] = parent[y] = parent[top] = top
            size[top] = size[x] + size[y]
        yield pd.DataFrame(out, columns=["node", "left", "right", "n_left", "n_right", "w"])


def _contract(light: DataFrame) -> DataFrame:
    """Components of the ends u, v of ``light`` edges: (x, root)."""
    ends = light.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(light.select(F.col("v").alias("x"), F.col("u").alias("y")))
    ends = landed(ends)
    roots = None
    while True:
        # every component hangs itself on its smallest neighbour, if that is smaller
        lower = ends.groupBy("x").agg(F.min("y").alias("up")).filter("up < x")
        step = climb(lower)
        names = ends.select("x").distinct().join(step, "x", "left").select("x", F.coalesce("up", "x").alias("root"))
        names = landed(names)
        if roots is None:
            roots = names
        else:
            roots = landed(roots.join(names.select(F.col("x").alias("root"), F.col("root").alias("to")), "root", "left")
                                .select("x", F.coalesce("to", "root").alias("root")))
        ends = ends.join(names, "x").select(F.col("root").alias("x"), "y")
        ends = ends.join(names.select(F.col("x").alias("y"), F.col("root").alias("to")), "y").select("x", F.col("to").alias("y"))
        ends = landed(ends.filter("x <> y").distinct())
        if not ends.take(1):
            return roots


def merges(tree: DataFrame, nodes: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, left, right, n_left, n_right, w): the single-linkage hierarchy. Vectors' nodes keep
    their numbers; the merge by edge ``e`` is node ``e`` + 1 + the largest of these."""
    shift = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    size_a, size_b = (nodes.select(F.col("node").alias(c), F.col("copies").alias(n)) for c, n in (("a", "nu"), ("b", "nv")))
    work = (tree.join(size_a, "a").join(size_b, "b")
            .select(F.lit(0).cast("long").alias("problem"), "e", F.col("a").alias("u"), F.col("b").alias("v"), "nu", "nv",
                    (F.col("e") + shift).alias("top"), "w"))
    work = landed(work)
    while True:
        large = work.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("e", 0.5, 10000).alias("middle")).filter(F.col("n") > bound)
        large = landed(large.select("problem", "middle"))
        if not large.take(1):
            break
        marked = work.join(large, "problem", "left").withColumn("light", F.coalesce(F.col("e") <= F.col("middle"), F.lit(False)))
        marked = landed(marked)
        light = marked.filter("light")
        root = _contract(light.select("u", "v"))
        owned = light.join(root.withColumnRenamed("x", "u"), "u")
        # a component's node is its heaviest merge; its vectors are those of its ends, each once
        heads = owned.groupBy("root").agg(F.max("top").alias("head"))
        ends = light.select(F.col("u").alias("x"), F.col("nu").alias("n")).unionByName(light.select(F.col("v").alias("x"), F.col("nv").alias("n"))).distinct()
        sizes = ends.join(root, "x").groupBy("root").agg(F.sum("n").alias("size"))
        whole = landed(root.join(heads.join(sizes, "root"), "root").select("x", "root", "head", "size"))
        lower = (light.join(whole.select(F.col("x").alias("u"), F.col("head").alias("_h")), "u")
                 .select(F.col("_h").alias("problem"), "e", "u", "v", "nu", "nv", "top", "w"))
        upper = marked.filter("not light").select("problem", "e", "u", "v", "nu", "nv", "top", "w")
        for c, n in (("u", "nu"), ("v", "nv")):
            to = whole.select(F.col("x").alias(c), "head", "size")
            upper = (upper.join(to, c, "left").withColumn(n, F.coalesce("size", n))
                     .withColumn(c, F.coalesce("head", c)).drop("head", "size"))
        work = landed(upper.select(*lower.columns).unionByName(lower))
    dealt = work.repartition("problem").sortWithinPartitions("problem", "e")
    return landed(dealt.mapInPandas(_walk, "node long, left long, right long, n_left long, n_right long, w double"))


def strength(w: Column) -> Column:
    return 1.0 / F.greatest(w, F.lit(NEAREST))


def condense(hierarchy: DataFrame, nodes: DataFrame, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """(clusters, points). clusters: (cluster, parent, birth, size), one per side of ``min_size``
    vectors of a split into two such sides, and per tree of the forest that has as many; ``parent`` is null
    there. points: (node, copies, cluster, strength): the last cluster a node is in
    and its strength there; a null cluster for those of small trees."""
    sides = hierarchy.select(F.col("left").alias("x"), F.col("n_left").alias("n"), F.col("n_right").alias("beside"), F.col("node").alias("up"), "w").unionByName(
        hierarchy.select(F.col("right").alias("x"), F.col("n_right").alias("n"), F.col("n_left").alias("beside"), F.col("node").alias("up"), "w"))
    sides = landed(sides)
    everything = (hierarchy.select(F.col("node").alias("x"), (F.col("n_left") + F.col("n_right")).alias("n"), "w")
                  .unionByName(nodes.select(F.col("node").alias("x"), F.col("copies").alias("n"), F.lit(0.0).alias("w"))))
    everything = landed(everything)

    out = climb(sides.filter(F.col("n") < min_size).select("x", "up"))
    points = nodes.select(F.col("node").alias("x"), "copies").join(out, "x", "left").select(
        F.col("x").alias("node"), "copies", F.coalesce("up", "x").alias("x"))
    points = points.join(everything.filter(F.col("n") >= min_size).select("x", "w", F.lit(True).alias("large")), "x", "left")

    kept = climb(sides.filter((F.col("n") >= min_size) & (F.col("beside") < min_size)).select("x", "up"))
    kept = kept.select("x", F.col("up").alias("cluster"))
    points = points.join(kept, "x", "left").select(
        "node", "copies", F.when(F.col("large"), F.coalesce("cluster", "x")).alias("cluster"), strength(F.col("w")).alias("strength"))

    born = sides.filter((F.col("n") >= min_size) & (F.col("beside") >= min_size)).select("x", "n", "w", F.col("up").alias("split"))
    born = (born.join(kept.select(F.col("x").alias("split"), "cluster"), "split", "left")
            .select(F.col("x").alias("cluster"), F.coalesce("cluster", "split").alias("parent"), strength(F.col("w")).alias("birth"), F.col("n").alias("size")))
    tops = (everything.filter(F.col("n") >= min_size).join(sides.select("x"), "x", "left_anti")
            .select(F.col("x").alias("cluster"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("birth"), F.col("n").alias("size")))
    return landed(born.unionByName(tops)), landed(points)


def _chains(links: DataFrame) -> DataFrame:
    """``links`` (x, down, a, b), a value of x being max(a, b + that of ``down``): followed down to the
    end of each chain. Every round doubles the way."""
    links = landed(links)
    while True:
        nxt = links.select(F.col("x").alias("down"), F.col("down").alias("far"), F.col("a").alias("far_a"), F.col("b").alias("far_b"))
        step = landed(links.join(nxt, "down", "left").select(
            "x", F.coalesce("far", "down").alias("down"), F.greatest("a", F.col("b") + F.col("far_a")).alias("a"),
            (F.col("b") + F.coalesce("far_b", F.lit(0.0))).alias("b"), F.col("far").isNotNull().alias("moved")))
        links = step.select("x", "down", "a", "b")
        if not step.filter("moved").take(1):
            return links


def best_totals(stable: DataFrame) -> DataFrame:
    """(cluster, best): the larger of a cluster's own stability and its children's best totals together.

    Every round takes the leaves off the tree, then shrinks each chain of clusters with one open child to
    the chain's end, so at least half of the rest goes however deep the tree is. An open cluster's best is
    max(a, b + what its open children give), and it gives max(p, q + best) to its parent; chains of such
    steps are steps of the same form."""
    tree = stable.select(F.col("cluster").alias("x"), F.col("parent").alias("up"), F.col("stability").alias("a"), F.lit(0.0).alias("b"),
                         F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("q"))
    bests, shrunk = None, []
    while True:
        tree = landed(tree)
        if not tree.take(1):
            break
        open_ups = tree.filter("up is not null").select(F.col("up").alias("x")).distinct()
        leaves = landed(tree.join(open_ups, "x", "left_anti").withColumn("best", F.greatest("a", "b")))
        found = leaves.select("x", "best")
        bests = found if bests is None else bests.unionByName(found)
        given = leaves.filter("up is not null").groupBy(F.col("up").alias("x")).agg(F.sum(F.greatest("p", F.col("q") + F.col("best"))).alias("given"))
        rest = landed(tree.join(leaves.select("x"), "x", "left_anti").join(given, "x", "left")
                      .withColumn("b", F.col("b") + F.coalesce("given", F.lit(0.0))).drop("given"))
        single = (rest.filter("up is not null").groupBy(F.col("up").alias("x"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("down")).filter("n = 1"))
        steps = rest.select(F.col("x").alias("down"), F.col("p").alias("down_p"), F.col("q").alias("down_q"))
        links = _chains(rest.join(single, "x").join(steps, "down").select(
            "x", "down", F.greatest("a", F.col("b") + F.col("down_p")).alias("a"), (F.col("b") + F.col("down_q")).alias("b")))
        shrunk.append(links)
        # the end of a chain stands where the chain's top stood
        tops = (rest.select("x", "up", "p", "q").join(links, "x").join(links.select(F.col("x").alias("up")), "up", "left_anti")
                .select(F.col("down").alias("x"), F.col("up").alias("top_up"), F.greatest("p", F.col("q") + F.col("a")).alias("top_p"),
                        (F.col("q") + F.col("b")).alias("top_q")))
        tree = rest.join(links.select("x"), "x", "left_anti").join(tops, "x", "left").select(
            "x", F.when(F.col("top_q").isNull(), F.col("up")).otherwise(F.col("top_up")).alias("up"), "a", "b",
            F.coalesce("top_p", "p").alias("p"), F.coalesce("top_q", "q").alias("q"))
    if bests is None:
        return stable.select("cluster", F.col("stability").alias("best"))
    for links in reversed(shrunk):
        ends = bests.select(F.col("x").alias("down"), "best")
        bests = landed(bests.unionByName(links.join(ends, "down").select("x", F.greatest("a", F.col("b") + F.col("best")).alias("best"))))
    return bests.withColumnRenamed("x", "cluster")


def select(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(cluster, chosen): for every cluster the chosen one it belongs to, null if none.
    A cluster is chosen if it is at least as stable as its descendants together
    and no larger one above it is; a forest's only tree is never one cluster."""
    own = points.groupBy("cluster").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("strength")).alias("s"))
    below = clusters.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(
        F.sum("size").alias("m"), F.sum(F.col("size") * F.col("birth")).alias("t"))
    stable = clusters.join(own, "cluster", "left").join(below, "cluster", "left").select(
        "cluster", "parent", (F.coalesce("s", F.lit(0.0)) + F.coalesce("t", F.lit(0.0))
                              - F.col("birth") * (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)))).alias("stability"))
    only = clusters.filter("parent is null").limit(2).count() < 2
    stable = landed(stable)
    under = (stable.filter("parent is not null").join(best_totals(stable), "cluster")
             .groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("under")))
    allowed = F.col("parent").isNotNull() if only else F.lit(True)
    takes = (F.col("stability") >= F.coalesce("under", F.lit(0.0))) & allowed
    state = stable.join(under, "cluster", "left").select("cluster", F.col("parent").alias("up"), F.when(takes, F.col("cluster")).alias("chosen"))
    state = landed(state)
    # The topmost taker on the way up: every round doubles the way looked at.
    while state.filter("up is not null").take(1):
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("far"), F.col("chosen").alias("higher"))
        state = landed(state.join(above, "up", "left").select("cluster", F.col("far").alias("up"), F.coalesce("higher", "chosen").alias("chosen")))
    return state.select("cluster", "chosen")


def density_clusters(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS,
                     min_samples: int = MIN_SAMPLES, min_size: int = MIN_SIZE, bound: int = BOUND, seed: int = 42) -> DataFrame:
    """(id, cluster_id, probability) for every row of ``vecs``. Clusters are numbered from 0, the largest
    first (ties: the one with the smallest id); noise is -1 with probability 0. The probability
    is the strength of a vector in its cluster against the strongest one's. Null, zero and malformed vectors
    are noise; rows repeated under one id get a row each."""
    with landing(vecs.sparkSession):
        nodes, members = vector_nodes(vecs, id_col, vec_col)
        members = landed(members)
        graph = neighbour_graph(nodes, k, seed=seed)
        tree = landed(spanning_tree(graph, core_distances(graph, nodes, min_samples)))
        clusters, points = condense(merges(tree, nodes, bound), nodes, min_size)
        chosen = select(clusters, points)
        placed = landed(points.join(chosen, "cluster").filter("chosen is not null").select("node", "copies", "chosen", "strength"))
        firsts = members.join(placed.select("node", "chosen"), "node").groupBy("chosen").agg(F.min("id").alias("first_id"))
        sizes = placed.groupBy("chosen").agg(F.sum("copies").alias("size"), F.max("strength").alias("strongest"))
        topics = sizes.join(firsts, "chosen").withColumn(  # one row a topic
            "cluster_id", (F.row_number().over(Window.orderBy(F.desc("size"), "first_id")) - 1).cast("int"))
        topics = landed(topics.select("chosen", "cluster_id", "strongest"))
        found = placed.join(topics, "chosen").select("node", "cluster_id", (F.col("strength") / F.col("strongest")).alias("probability"))
        per_id = members.join(found, "node").groupBy("id").agg(F.max(F.struct("probability", "cluster_id")).alias("f"))
        out = vecs.select(F.col(id_col)).join(per_id.withColumnRenamed("id", id_col), id_col, "left")
        return cut_lineage(out.select(id_col, F.coalesce("f.cluster_id", F.lit(NOISE)).alias("cluster_id"), F.coalesce("f.probability", F.lit(0.0)).alias("probability")))
