"""Keyed writes as DataFrame transforms.

``upsert`` is the set form of INSERT ... ON CONFLICT DO UPDATE: a full outer
join on the key; listed columns take the update's value, other columns keep
the base's. Inside one batch the last row per key wins (W3), where the
original's database would reject a second hit on one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.marts import last_per_key


def one_per_key(updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: that of the largest ``order`` (null: before all others); of rows equal
    in it, or without ``order``, the one of the largest hash over its columns, so a rerun picks the same.

    Only rows of keys that come twice are compared; the others pass after one join against the (few) such keys."""
    rest = [c for c in updates.columns if c not in keys and c != order]
    twice = (updates.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    among = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    once = updates.join(twice, among, "left_anti").select(*keys, *rest)
    return once.unionByName(_last_of(updates.join(twice, among, "left_semi"), keys, rest, order))


def _last_of(updates: DataFrame, keys: list[str], rest: list[str], order: str | None) -> DataFrame:
    numbered = updates
    if order is not None:
        ranked = updates.select("*", F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))).alias("_o"))
        numbered = last_per_key(ranked, keys, ["_o"], rest)  # all rows of the largest order
    tie = F.xxhash64(*[F.col(c) for c in keys], *rest) if rest else F.lit(0).cast("long")
    picked = last_per_key(numbered.select(*keys, *rest, tie.alias("_tie")), keys, ["_tie"], rest)
    return picked.distinct()  # what is left are rows equal in every column


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str],
           order: str | None = None) -> DataFrame:
    """Insert new keys; for existing keys replace ``update_cols`` only.
    ``order`` (a whole-number column of ``updates``) picks the last row per key in a
    batch; ties are settled by ``one_per_key``, so a key gets one row of the batch at most. Null
    keys equal nothing: base rows with one stay as they are, the batch's row with one is inserted."""
    return laid_over(base, one_per_key(updates, keys, order), keys, update_cols)


def laid_over(base: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """``upsert`` of a batch that has one row per key."""
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in keys],
                       F.lit(True).alias("_u_present"))
    j = base.withColumn("_b_present", F.lit(True)).join(u, keys, "full_outer")
    cols = []
    for c in base.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update_cols and f"_u_{c}" in u.columns:
            cols.append(F.when(F.col("_u_present"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        elif f"_u_{c}" in u.columns:
            # inserted rows take the update's value; existing rows keep theirs
            cols.append(F.when(F.col("_b_present"), F.col(c)).otherwise(F.col(f"_u_{c}")).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def append_distinct(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: new keys only (anti-join), each
    once."""
    new = updates.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return base.unionByName(new.select(*base.columns))
