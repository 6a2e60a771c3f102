"""Filter interaction audit: what each filter removes alone, after others, and in every order.

Every document is judged once by each filter. Per part and id range, a filter has a
posting list: the sorted numbers of the documents that fail it (a document's number
is its place in id order among the part's documents of that range). Unions and
differences of the lists come from galloping merges: the ids of the shorter list
are searched for in the longer one, each search going on from where the last
one ended, and the longest list is the spine of a k-way union. Their sizes are
summed over the ranges. The union sizes of all 32 sets of filters give every figure of all
120 orders, so no order is replayed over the documents.

The posting lists are a table of their own (``posting_lists``): a new audit, with other
orders or other marks, reads them and no text.

Defined results: a null text counts as empty, a null source as the part ''; texts of
any length are judged whole; a document equal to one of the same id isn't a copy of
it, and rows repeated under one id each count; a row with a null id is judged by
A-D and is never a copy nor the first of copies; a null label marks nothing, and of labels
repeated under an id one mark is enough; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import UPPER, table
from scriptorium.session import cut_lineage

FILTERS = "ABCDE"
MARKS = ("good", "toxic")
WORD = r"[^\x20\x09-\x0D]+"
RANGE = 1 << 16           # documents of an id range, about
_SETS = 1 << len(FILTERS)
_NO_ID = -(1 << 63)       # stands for a null id in a range's first_id: null ids come first
_POSTINGS = ", ".join(["part string", "first_id long", "last_id long", "documents int",
                       *(f"{c} array<int>" for c in (*FILTERS, *MARKS))])


# --------------------------------------------------------------- the filters

def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D): one row per document, read once. ``digest``
    is the SHA-256 of the text; E, which looks at other documents, follows from it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.select("doc_id", "part", "text", F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0].alias("w"))
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                       (F.col("w.n") < 200).alias("A"), (100 * F.col("w.different") < 50 * F.col("w.n")).alias("B"),
                       (100 * capitals > 2 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds E: the text is that of a smaller id. The join goes by (id, digest), which
    no group of copies shares: a row is no copy if it is the first of its digest."""
    firsts = (rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("first", F.lit(True)))
    return (rows.join(firsts, ["doc_id", "digest"], "left")
            .withColumn("E", F.col("first").isNull() & F.col("doc_id").isNotNull()).drop("first"))


def with_marks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic, false where no label says so."""
    marks = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
             .filter("good or toxic"))
    out = rows.join(marks, "doc_id", "left")
    return out.select(*rows.columns, *[F.coalesce(m, F.lit(False)).alias(m) for m in MARKS])


# ------------------------------------------------------------ posting lists

def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for part, own in rows.groupby("part", sort=False):
        bits = own["bits"].to_numpy()
        out.append((part, own["id"].iloc[0], own["id"].iloc[-1], len(own),
                    *(np.flatnonzero(bits >> k & 1).astype(np.int32) for k in range(len(FILTERS) + len(MARKS)))))
    return pd.DataFrame(out, columns=["part", "first_id", "last_id", "documents", *FILTERS, *MARKS])


def _post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= RANGE:
            yield _lists(pd.concat(held))
            held, n = [], 0
    if n:
        yield _lists(pd.concat(held))


def posting_lists(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part and id range: first_id, last_id, documents, and the sorted
    list of the numbers of its documents that fail each filter or bear each mark."""
    rows = with_marks(with_copies(cut_lineage(verdicts(docs))), labels)
    bits = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate((*FILTERS, *MARKS))), F.lit(0))
    rows = cut_lineage(rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "digest", "part", bits.alias("bits")))
    ordered = rows.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest")
    return ordered.select("id", "part", "bits").mapInPandas(_post, _POSTINGS)


def inside(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ids`` are in the sorted ``other``."""
    if len(ids) <= len(other):
        at = np.minimum(np.searchsorted(other, ids), len(other) - 1)
        return other[at] == ids if len(ids) else np.zeros(0, bool)
    hit = np.zeros(len(ids), bool)
    if len(other):
        at = np.searchsorted(ids, other)
        there = at < len(ids)
        at, other = at[there], other[there]
        hit[at[ids[at] == other]] = True
    return hit


def union(lists: list[np.ndarray]) -> np.ndarray:
    """K-way union of sorted lists, from the longest one down."""
    out, *others = sorted(lists, key=len, reverse=True)
    for ids in others:
        new = ids[~inside(ids, out)]
        if len(new):
            out = np.insert(out, np.searchsorted(out, new), new)
    return out


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            lists = [np.asarray(getattr(row, c)) for c in FILTERS]
            marks = [np.asarray(getattr(row, m)) for m in MARKS]
            for s in range(_SETS):
                fail = union([x for k, x in enumerate(lists) if s >> k & 1]) if s else lists[0][:0]
                out.append((row.part, s, row.documents, len(fail), *(int(inside(fail, m).sum()) for m in marks)))
        yield pd.DataFrame(out, columns=["part", "filters", "documents", "failing", *MARKS])


def union_sizes(postings: DataFrame) -> DataFrame:
    """(part, filters, documents, failing, good, toxic): per set of filters (a bit
    mask), the documents that fail at least one of them, and the marked ones of these."""
    columns = ["documents", "failing", *MARKS]
    sizes = postings.mapInPandas(_sizes, "part string, filters int, documents long, failing long, good long, toxic long")
    return sizes.groupBy("part", "filters").agg(*[F.sum(c).alias(c) for c in columns])


# ------------------------------------------------------------------ orders

def _steps() -> list[dict]:
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append({"o": "".join(FILTERS[i] for i in order), "s": step, "k": k, "b": before, "a": before | 1 << k})
            before |= 1 << k
    return out


def _credit(k: int) -> Column:
    """Removals of filter ``k`` summed over all orders: each set of filters before it
    stands in |set|! * (others)! of them."""
    weight = [0] * _SETS
    for s in range(_SETS):
        if not s >> k & 1:
            n = bin(s).count("1")
            w = factorial(n) * factorial(len(FILTERS) - 1 - n)
            weight[s] -= w
            weight[s | 1 << k] += w
    terms = F.zip_with("u", F.array(*[F.lit(w) for w in weight]), lambda u, w: u["failing"] * w)
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    sizes = union_sizes(posting_lists(docs, labels))
    sets = sizes.groupBy("part").agg(  # 32 entries a part
        F.max("documents").alias("documents"),
        F.array_sort(F.collect_list(F.struct("filters", "failing", *MARKS))).alias("u"))
    sets = sets.select("part", "documents", "u", F.array(*[_credit(k) for k in range(len(FILTERS))]).alias("credit"))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<o:string,s:int,k:int,b:int,a:int>>")
    rows = sets.select("*", F.explode(steps).alias("x"))
    before, after, k = F.get("u", F.col("x.b")), F.get("u", F.col("x.a")), F.col("x.k")
    one = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), k + 1)
    alone, others, every = F.get("u", one), F.get("u", F.lit(_SETS - 1) - one), F.get("u", F.lit(_SETS - 1))
    removed = after["failing"] - before["failing"]
    return rows.select("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
                       (F.col("documents") - after["failing"]).alias("kept"), removed.alias("removed"),
                       (alone["failing"] - removed).alias("redundant"),
                       (every["failing"] - others["failing"]).alias("unique_fails"),
                       (after["good"] - before["good"]).alias("good_lost"),
                       (after["toxic"] - before["toxic"]).alias("toxic_lost"),
                       F.get("credit", k).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "doc_id", "source", "text"),
                 table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             min(doc_id) over (partition by t) as first_id from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
f as (select part,
             (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (first_id < doc_id)::int as mask,
             coalesce(good, false) as good, coalesce(toxic, false) as toxic
      from w left join l using (doc_id)),
m as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from f group by 1, 2),
b as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(letter, bit)),
o as (select b1.letter || b2.letter || b3.letter || b4.letter || b5.letter as filter_order,
             [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] as bits
      from b b1, b b2, b b3, b b4, b b5 where b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31
        and (b1.bit | b2.bit | b3.bit | b4.bit | b5.bit) = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
      from o, (select unnest(range(1, 6))::int as step)),
r as (select part, filter_order, step, bit,
             coalesce(sum(n) filter ((mask & (before | bit)) = 0), 0)::bigint as kept,
             coalesce(sum(n) filter ((mask & before) = 0 and (mask & bit) <> 0), 0)::bigint as removed,
             coalesce(sum(n) filter ((mask & before) <> 0 and (mask & bit) <> 0), 0)::bigint as redundant,
             coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
             coalesce(sum(g) filter ((mask & before) = 0 and (mask & bit) <> 0), 0)::bigint as good_lost,
             coalesce(sum(x) filter ((mask & before) = 0 and (mask & bit) <> 0), 0)::bigint as toxic_lost
      from m, s group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""
