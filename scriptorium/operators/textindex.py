"""F6 by an index: case-insensitive substring search through trigram postings.

Rows are numbered; every distinct trigram of a row's upper-cased text has the row's
number in its postings, kept in sorted blocks: a block holds a trigram's numbers among
``BLOCK`` consecutive rows, as the first one and the steps to the next. Blocks are written in
ranges of (trigram, block), so a search reads the row groups of its own trigrams and no
others, and a frequent trigram is many blocks in many files.

A search takes its text's trigrams in order of frequency, the rarest first. Each next one
is read only for the blocks in which a candidate is left. What remains is verified on the
text itself, so the answer is exact. A text of fewer than three characters has no
trigram and is searched in all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.density import numbered
from scriptorium.session import landed
from scriptorium.sources.martset import MartSet

GRAM = 3
BLOCK = 1024              # rows a block looks after
ROUNDS = 4                # trigrams intersected before the candidates are verified
FEW = 1000                # candidates up to which the rows are asked for by number


def grams(text):
    """Distinct trigrams of an upper-cased text."""
    n = F.length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))),
                                                          lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def build(mart_set: MartSet, name: str, rows: DataFrame, id_col: str, text_col: str) -> int:
    """Indexes (id, text) as tables ``name``_rows, ``name``_postings and ``name``_grams of ``mart_set``, in one
    commit. A null text has no trigrams and is never found; rows repeated under one id are found each for itself."""
    start = mart_set.latest()
    text = rows.select(F.col(id_col).alias("id"), F.upper(F.col(text_col)).alias("text"))
    texts = landed(numbered(text.withColumn("_tie", F.xxhash64("text")), ["id", "_tie"], "row").drop("_tie"))
    found = texts.filter("text is not null").select("row", F.explode(grams(F.col("text"))).alias("gram"))
    blocks = (found.groupBy("gram", F.floor(F.col("row") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("row")).alias("r"))
              .select("gram", "block", F.size("r").alias("n"), F.get("r", F.lit(0)).alias("first"),
                      F.zip_with(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))),
                                 lambda a, b: (a - b).cast("int")).alias("steps")))
    placed = landed(blocks.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"))
    counts = placed.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    entries = {f"{name}_rows": mart_set.write(texts, f"{name}_rows"), f"{name}_postings": mart_set.write(placed, f"{name}_postings"),
               f"{name}_grams": mart_set.write(counts.repartitionByRange("gram").sortWithinPartitions("gram"), f"{name}_grams")}
    return mart_set.publish({**mart_set.manifest(start), **entries}, start)


def _numbers(postings: DataFrame) -> DataFrame:
    """(block, row) of posting blocks: the first number and the running sums of the steps."""
    run = F.aggregate("steps", F.array(F.col("first")), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
    return postings.select("block", F.explode(run).alias("row"))


def rarest(mart_set: MartSet, name: str, text: str, number: int | None = None) -> list[str] | None:
    """The text's trigrams, rarest first; None if one of them is nowhere."""
    upper = mart_set.spark.range(1).select(F.upper(F.lit(text)).alias("t")).first()["t"]
    wanted = {upper[i:i + GRAM] for i in range(len(upper) - GRAM + 1)}
    known = mart_set.read(f"{name}_grams", number).filter(F.col("gram").isin(list(wanted))).collect()  # a row a trigram of the text
    if len(known) < len(wanted):
        return None
    return [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))]


def candidates(mart_set: MartSet, name: str, order: list[str], number: int | None = None) -> DataFrame:
    """(block, row): the rows that have all of ``order``, taken one after the other."""
    postings = mart_set.read(f"{name}_postings", number)
    left = _numbers(postings.filter(F.col("gram") == order[0]))
    for gram in order[1:]:
        blocks = postings.filter(F.col("gram") == gram).join(left.select("block").distinct(), "block", "left_semi")
        left = left.join(_numbers(blocks), ["block", "row"], "left_semi")
    return left


def search(mart_set: MartSet, name: str, text: str, number: int | None = None) -> DataFrame:
    """(id): the rows whose text contains ``text``, case aside; an id once per such row."""
    rows = mart_set.read(f"{name}_rows", number)
    holds = F.contains(F.col("text"), F.upper(F.lit(text)))
    if len(text) < GRAM:
        return rows.filter(holds).select("id")
    order = rarest(mart_set, name, text, number)
    if order is None:
        return rows.limit(0).select("id")
    left = landed(candidates(mart_set, name, order[:ROUNDS], number).select("row"))
    if left.count() <= FEW:  # numbers as a filter of the scan: row groups without one aren't read
        return rows.filter(F.col("row").isin([r["row"] for r in left.collect()]) & holds).select("id")
    return rows.join(left, "row", "left_semi").filter(holds).select("id")


def search_papers(mart_set: MartSet, text: str, bridge: DataFrame) -> DataFrame:
    """F6 (paper_id): title or any author's name contains the text. ``mart_set`` has the indexes ``titles``
    (by paper) and ``names`` (by author); ``bridge`` is (paper_id, author_id)."""
    by_title = search(mart_set, "titles", text).select(F.col("id").alias("paper_id"))
    authors = search(mart_set, "names", text).select(F.col("id").alias("author_id")).distinct()
    return by_title.unionByName(bridge.join(authors, "author_id", "left_semi").select("paper_id")).distinct()
