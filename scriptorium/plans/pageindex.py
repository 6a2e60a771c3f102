"""L4 by a stored index: any page of the cards for one lookup and one pruned read.

``build`` sorts the papers once by the card order (L3), numbers them and stores them in runs
of ``DEPTH`` consecutive cards, with a table of the runs: how many cards lie before each one.
A page is looked up there (the runs that hold its first and last card, at most two for a page shorter
than a run) and read from those runs alone: the run's number is a filter that Parquet prunes by.
A deep page costs what the first one does, and no page counts the table again. The index is as of its commit;
papers that change are in it from the next ``build`` on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.density import numbered
from scriptorium.plans.papers import PageInfo, card_order, clamp_page, order_keys
from scriptorium.session import landed
from scriptorium.sources.martset import MartSet

DEPTH = 4096              # cards of a run


def build(mart_set: MartSet, papers: DataFrame, depth: int = DEPTH) -> int:
    """Stores papers (paper_id, year, citation_count and whatever a card shows) as tables cards and card_runs, in one
    commit beside the set's other tables. Paper ids must tell papers apart."""
    start = mart_set.latest()
    keys = dict(zip(("_k0", "_k1", "_k2"), order_keys(), strict=True))
    cards = landed(numbered(papers.withColumns(keys), list(keys), "place").drop(*keys)
                   .withColumn("run", F.floor(F.col("place") / depth)))
    runs = cards.groupBy("run").agg(F.min("place").alias("before"), F.count(F.lit(1)).alias("cards"))
    ordered = cards.repartitionByRange("run").sortWithinPartitions("place")
    entries = {"cards": mart_set.write(ordered, "cards"),
               "card_runs": mart_set.write(runs.repartitionByRange("run").sortWithinPartitions("run"), "card_runs")}
    return mart_set.publish({**mart_set.manifest(start), **entries}, start)


def page(mart_set: MartSet, number, size: int, commit: int | None = None) -> tuple[DataFrame, PageInfo]:
    """The rows of a page in card order, and its place among all pages (L4's clamp)."""
    runs = mart_set.read("card_runs", commit)
    total = runs.agg(F.sum("cards")).first()[0] or 0
    info = clamp_page(number, total, size)
    first = (info.current_page - 1) * size
    held = runs.filter((F.col("before") < first + size) & (F.col("before") + F.col("cards") > first)).select("run").collect()
    rows = mart_set.read("cards", commit).filter(
        F.col("run").isin([r["run"] for r in held]) & (F.col("place") >= first) & (F.col("place") < first + size))
    return card_order(rows.drop("place", "run")), info
