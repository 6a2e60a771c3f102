"""T2, the wanted number of topics: similar topics become one until so many are left.

Average-linkage agglomeration over the cosines of the topics' c-TF-IDF vectors. The cosines come
from the inverted index (one row a term, with the topics that have it), so topics without a common
term form no pair. A pair of clusters keeps the sum of its members' cosines; their mean is the sum over the
product of the sizes, and a merge adds sums. Each round merges every pair of
clusters that are each other's nearest: under average linkage no other merge changes
that, so the rounds give the merges that one-by-one agglomeration gives, about as many
rounds as the logarithm of the topics. The merges above the cut then count, the most similar first.

Topics without any similarity stay apart until all others are one; then they join in the order
of their ids. The outlier topic (-1) takes no part. Merged topics are numbered by their
documents, the largest first, and their keywords follow from the summed term counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import topics as T
from scriptorium.session import dealt, landed, landing

_MERGE = "a int, b int, similarity double"


def topic_similarities(terms: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """(a, b, s): the cosine of every two real topics that share a term, a < b."""
    lookup = T.topic_lookup(terms, topic_col).select("in_topics").filter(F.size("in_topics") > 1)
    pairs = lookup.select(F.col("in_topics").alias("all"), F.explode("in_topics").alias("x")).select("x", F.explode("all").alias("y"))
    return (pairs.filter(F.col("x.t") < F.col("y.t")).groupBy(F.col("x.t").alias("a"), F.col("y.t").alias("b"))
            .agg(F.sum(F.col("x.s") * F.col("y.s")).alias("s")))


def merges(similarities: DataFrame, topic_ids: DataFrame) -> DataFrame:
    """(a, b, similarity): all merges of clusters named by their smallest topic, by rounds of mutually
    nearest pairs."""
    pairs = landed(similarities.filter("s > 0"))
    sizes = landed(topic_ids.select("topic_id", F.lit(1).cast("long").alias("n")))
    done = None
    while pairs.take(1):
        mean = pairs.join(sizes.select(F.col("topic_id").alias("a"), F.col("n").alias("na")), "a").join(
            sizes.select(F.col("topic_id").alias("b"), F.col("n").alias("nb")), "b").withColumn("mean", F.col("s") / (F.col("na") * F.col("nb")))
        mean = landed(mean)
        # one order over all pairs, so the best pair of all is always mutual
        ends = mean.select(F.explode(F.array("a", "b")).alias("c"), "a", "b", "mean")
        best = (ends.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("mean"), "a", "b")))
                .filter("_r = 1").groupBy("a", "b").agg(F.max("mean").alias("similarity"), F.count(F.lit(1)).alias("n")))
        joined = landed(best.filter("n = 2").select("a", "b", "similarity"))
        done = joined if done is None else landed(done.unionByName(joined))
        to = joined.select(F.col("b").alias("old"), F.col("a").alias("new"))

        def renamed(df, column):
            mapped = to.select(F.col("old").alias(column), "new")
            return df.join(mapped, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        sizes = landed(renamed(sizes, "topic_id").groupBy("topic_id").agg(F.sum("n").alias("n")))
        pairs = renamed(renamed(pairs, "a"), "b").filter("a <> b")
        pairs = landed(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
    return done if done is not None else similarities.sparkSession.createDataFrame([], _MERGE)


def reduce_topics(terms: DataFrame, topic_sizes: DataFrame, wanted: int, topic_col: str = "topic_id") -> DataFrame:
    """(topic_id, new_topic_id): the topics as at most ``wanted`` merged ones. ``terms`` is T1's output, ``topic_sizes``
    (topic_id, n) the documents of each topic. One row a topic reaches the driver."""
    if wanted < 1:
        raise ValueError("at least one topic must be wanted")
    spark = terms.sparkSession
    real = topic_sizes.filter(F.col("topic_id") != X.OUTLIER_TOPIC_ID)
    sizes = {r["topic_id"]: r["n"] for r in real.collect()}
    with landing(spark):
        found = merges(topic_similarities(terms, topic_col), real.select("topic_id")).collect() if len(sizes) > wanted else []
    root = {t: t for t in sizes}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    left = len(sizes)
    for r in sorted(found, key=lambda r: (-r["similarity"], r["a"], r["b"])):
        if left > wanted:
            a, b = sorted((find(r["a"]), find(r["b"])))
            root[b] = a
            left -= 1
    for t in sorted(t for t in root if root[t] == t)[wanted:] if left > wanted else []:
        root[t] = min(t for t in root if root[t] == t)      # no similarity decides
    groups: dict[int, list[int]] = {}
    for t in sizes:
        groups.setdefault(find(t), []).append(t)
    order = sorted(groups, key=lambda g: (-sum(sizes[t] for t in groups[g]), g))
    rows = [(t, i) for i, g in enumerate(order) for t in groups[g]] + [(X.OUTLIER_TOPIC_ID, X.OUTLIER_TOPIC_ID)]
    return spark.createDataFrame(rows, "topic_id int, new_topic_id int")


def merged_terms(terms: DataFrame, mapping: DataFrame, topic_col: str = "topic_id", rows: int = 0) -> DataFrame:
    """T1's counts under the new topics. ``rows``, the rows of ``terms``, decides how many tasks hold them."""
    moved = terms.join(mapping.withColumnRenamed("topic_id", topic_col), topic_col).select(F.col("new_topic_id").alias(topic_col), "term", "n")
    return dealt(moved, rows, topic_col, "term").groupBy(topic_col, "term").agg(F.sum("n").alias("n"))
