"""Connected components by repeated label minima and pointer jumping.

Links never leave Spark: every round is two joins and a grouped minimum over
tables of the nodes that have links. Each partition first contracts its own
links to a forest (union-find inside the task), so chains shrink at once and
the number of rounds grows with the logarithm of the longest chain left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import keep_narrow


def roots(pairs) -> dict:
    """Union-find over (a, b) pairs: node -> smallest node of its set."""
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:  # one Arrow batch at a time: memory stays bounded
        root = roots(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        out = [(r, x) for x, r in root.items() if x != r]
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def components(links: DataFrame) -> DataFrame:
    """``links``: long columns a, b (undirected, repeats allowed). Returns one row
    per linked node: node, component (the smallest node reachable). An empty
    table of links gives an empty table."""
    forest = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    forest = keep_narrow(forest.mapInPandas(_contract, "a long, b long").distinct())
    both = forest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        forest.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = keep_narrow(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        heard = (both.join(labels.withColumnRenamed("node", "other"), "other")
                 .groupBy("node").agg(F.min("component").alias("heard")))
        told = labels.join(heard, "node").select("node", F.least("component", "heard").alias("label"),
                                                 F.col("component").alias("old"))
        # Pointer jumping: a label is itself a node; take that node's label.
        jump = told.join(labels.select(F.col("node").alias("label"), F.col("component").alias("far")), "label", "left")
        step = keep_narrow(jump.select("node", F.least("label", F.coalesce("far", "label")).alias("component"),
                                       (F.col("old") != F.least("label", F.coalesce("far", "label"))).alias("moved")))
        labels = step.select("node", "component")
        if not step.filter("moved").take(1):
            return labels
