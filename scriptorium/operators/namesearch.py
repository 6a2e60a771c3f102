"""J14's search step over a table: all candidate names within an edit distance of a name.

The original asks a search service and takes its first hit. Here names meet through their deletion
neighbourhoods: two names within distance k have a common form after at most k
characters are deleted from each. Forms are hashed and joined, so only names that share
one are compared, and the exact distance decides. A form that many candidates have is
dealt into pieces of ``PIECE`` of them, each met by its own copy of the asking names: no task gets a popular
form whole. Names are compared without case and outer blanks; each distinct one is expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage

DISTANCE = 2
PIECE = 1000              # candidates of one form compared in one piece


def _shorter(form):
    """All forms with one character less."""
    n = F.length(form)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(
        F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def forms(name: Column, distance: int) -> Column:
    """Hashes of a name and of what is left after deleting up to ``distance`` characters."""
    found = last = F.array(name)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _shorter)))
        found = F.concat(found, last)
    return F.array_distinct(F.transform(found, lambda f: F.xxhash64(f)))


def key_of(name: Column) -> Column:
    return F.lower(F.trim(name))


def near_names(names: DataFrame, candidates: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(name, candidate, distance): every pair of a name of ``names`` (name) and one of ``candidates`` (name) within
    the distance, each once, as lower-case trimmed keys. Null and blank names find nothing."""
    def distinct(df):
        return df.select(key_of(F.col("name")).alias("name")).filter("name <> ''").distinct()

    asked = distinct(names).select("name", F.explode(forms(F.col("name"), distance)).alias("form"))
    held = cut_lineage(distinct(candidates).select(F.col("name").alias("candidate"), F.explode(forms(F.col("name"), distance)).alias("form")))
    pieces = held.groupBy("form").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")).filter("pieces > 1")
    many = F.coalesce("pieces", F.lit(1))
    held = held.join(pieces, "form", "left").withColumn("piece", F.pmod(F.xxhash64("candidate"), many).cast("int")).drop("pieces")
    asked = asked.join(pieces, "form", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), many - 1))).drop("pieces")
    met = asked.join(held, ["form", "piece"]).select("name", "candidate").distinct()
    return (met.withColumn("distance", F.levenshtein("name", "candidate", distance)).filter("distance >= 0")
            .select("name", "candidate", "distance"))


def resolve_near(names: DataFrame, candidates: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """J14 with misspelt names: ``names`` plus openalex_id, the candidate of the nearest name within the distance; of
    equally near ones that of the best rank, then id. ``candidates``: name, candidate_id, rank. Null without a hit.

    A name's candidates are reduced to its best by partial minima, never gathered."""
    own = candidates.select(key_of(F.col("name")).alias("candidate"), "candidate_id", "rank")
    rank = own.groupBy("candidate").agg(F.min("rank").alias("rank"))
    best = own.join(rank, ["candidate", "rank"]).groupBy("candidate", "rank").agg(F.min("candidate_id").alias("candidate_id"))
    hits = near_names(names, candidates, distance).join(best, "candidate")
    least = hits.groupBy("name").agg(F.min("distance").alias("distance"))
    hits = hits.join(least, ["name", "distance"])
    least = hits.groupBy("name").agg(F.min("rank").alias("rank"))
    found = hits.join(least, ["name", "rank"]).groupBy(F.col("name").alias("_key")).agg(F.min("candidate_id").alias("openalex_id"))
    return names.join(found, key_of(names["name"]) == F.col("_key"), "left").drop("_key")
