"""Temperature mixing of sources, realised as budgeted block permutations.

Source token shares are raised to an exponent (the inverse temperature) and
normalised. The exponent is bisected on a grid of 2^-LEVELS until the weights
meet a target entropy or the largest repetition of a source meets a limit. A
weight times the total budget is the source's token budget: some whole epochs of
the source and part of one more. Every epoch orders the source's blocks of
documents anew, and inside a block its sub-blocks and documents; the partial
epoch is a prefix of that order, cut where the budget ends.

Without a total budget, the largest source is read exactly once, so with an
exponent of at most 1 every document is read at least once.

The cut is found by exact sums at three levels (block, sub-block, document), each
of at most ``BLOCKS`` rows a source but the last, which holds one sub-block: no
source is ever sorted as a whole. A row then knows its fate from its own hashes
and its source's three cut keys, so texts are not shuffled.

Defined results: a null source is a source of its own (named null in the result);
null and empty texts have no tokens and are read once an epoch; a source without
any token is read once; rows repeated with the same id share their fate; a null
id takes part; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import keep_narrow, table
from scriptorium.session import cut_lineage

BLOCKS = 1024             # blocks of a source, and sub-blocks of a block
LEVELS = 40               # halvings of the exponent's interval [0, 1]
AT_ONCE = 5               # halvings settled by one pass over the source table
MAX_REPETITION = 2.0      # limit of the registered query and the pipeline stage
BROADCAST_SOURCES = 50_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column | str) -> Column:
    """Words of a text: maximal runs outside space and 0x09-0x0D."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _name(source: Column) -> Column:
    """A non-null, unique spelling of a source."""
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))


def _part(digest: Column, start: int) -> Column:
    """A number in [0, BLOCKS) from four hex digits of a digest."""
    return (F.conv(F.substring(digest, start, 4), 16, 10).cast("int") % F.lit(BLOCKS)).cast("int")


def keys(epoch: Column) -> dict[str, Column]:
    """The order keys of a row in an epoch: block, sub-block and document digests."""
    name, doc = F.col("_source"), F.col("_doc")
    return {"bk": _digest(F.lit(SEED), epoch.cast("string"), name, F.col("_block").cast("string")),
            "sk": _digest(F.lit(SEED), epoch.cast("string"), name, F.col("_sub").cast("string")),
            "dk": _digest(F.lit(SEED), epoch.cast("string"), doc)}


def placed(docs: DataFrame) -> DataFrame:
    """Adds _source, _doc, _block and _sub: where a row stands in its source."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.md5(doc.cast("binary"))
    return docs.withColumns({"_source": _name(F.col("source").cast("string")), "_doc": doc,
                             "_block": _part(digest, 1), "_sub": _part(digest, 5)})


# ----------------------------------------------------------------- exponent

def bisect(meets, lo: float = 0.0, hi: float = 1.0, levels: int = LEVELS) -> float:
    """The smallest grid point of (lo, hi] found by halving that meets a condition
    which holds from some point on. ``meets`` takes a list of points, so several
    halvings are settled by one evaluation."""
    while levels > 0:
        n = min(AT_ONCE, levels)
        step = (hi - lo) / (1 << n)
        points = [lo + step * i for i in range(1, 1 << n)]
        ok = meets(points)
        k = next((i for i, v in enumerate(ok, 1) if v), 1 << n)
        lo, hi = lo + step * (k - 1), lo + step * k
        levels -= n
    return hi


def exponent(sources: DataFrame, budget: int | None, max_repetition: float | None,
             target_entropy: float | None) -> float:
    """The bisected exponent of a table (tokens > 0 a source). Repetition: the
    smallest exponent within the limit. Entropy (nats): the largest exponent that
    still reaches the target, so the mix stays as close to the shares as it can."""
    top = sources.agg(F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not top["most"]:
        return 1.0
    most, least = float(top["most"]), float(top["least"])
    p = F.col("tokens") / F.lit(most)

    def sums(points):
        rows = (sources.select(p.alias("p"), F.explode(F.array(*[F.lit(x) for x in points])).alias("x"))
                .groupBy("x").agg(F.sum(F.pow("p", "x")).alias("z"),
                                  F.sum(F.pow("p", "x") * F.log("p")).alias("l")).collect())
        by = {r["x"]: (r["z"], r["l"]) for r in rows}
        return [by[x] for x in points]

    if target_entropy is not None:
        def meets(points):  # in 1 - exponent, entropy grows
            return [math.log(z) - x * s / z >= target_entropy
                    for x, (z, s) in zip([1 - y for y in points], sums([1 - y for y in points]), strict=True)]
        return 1.0 - bisect(meets)
    if max_repetition is None:
        return 1.0
    if budget is None:
        return bisect(lambda points: [(most / least) ** (1 - x) <= max_repetition for x in points])
    return bisect(lambda points: [budget / most * (least / most) ** (x - 1) / z <= max_repetition
                                  for x, (z, _) in zip(points, sums(points), strict=True)])


# --------------------------------------------------------------------- plan

def plan(docs: DataFrame, budget: int | None = None, max_repetition: float | None = MAX_REPETITION,
         target_entropy: float | None = None) -> DataFrame:
    """One row a source: _source, tokens, weight, budget (tokens), epochs (whole
    ones), rest (tokens of the partial epoch) and the cut keys cb, cs, cd."""
    rows = cut_lineage(placed(docs).select("_source", "_doc", "_block", "_sub", n_tokens("text").alias("n")))
    blocks = keep_narrow(rows.groupBy("_source", "_block").agg(F.sum("n").alias("n")))
    sources = keep_narrow(blocks.groupBy("_source").agg(F.sum("n").alias("tokens")))
    full = sources.filter("tokens > 0")
    a = exponent(full, budget, max_repetition, target_entropy)
    top = full.agg(F.max("tokens").alias("most")).first()["most"] or 1
    share = F.pow(F.col("tokens") / F.lit(float(top)), F.lit(a))
    total = full.agg(F.sum(share).alias("z")).first()["z"] or 1.0
    tokens = (F.floor(F.lit(float(top)) * share) if budget is None
              else F.floor(F.lit(float(budget)) * share / F.lit(total)))
    made = sources.withColumn("weight", F.when(F.col("tokens") > 0, share / F.lit(total)).otherwise(F.lit(0.0)))
    made = made.withColumn("budget", F.when(F.col("tokens") > 0, tokens).otherwise(F.lit(0)).cast("long"))
    if budget is None:  # rounding must not cost a document
        made = made.withColumn("budget", F.greatest("budget", "tokens"))
    made = made.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens"))
                           .otherwise(F.lit(1)).cast("int"))
    made = keep_narrow(made.withColumn("rest", F.col("budget") - F.when(F.col("tokens") > 0, F.col("epochs") * F.col("tokens"))
                                       .otherwise(F.col("budget"))))
    # Cut keys, level by level: what precedes the cut in full is summed, what holds it is opened.
    at = made.filter("rest > 0").select("_source", "epochs", "rest")
    at = _cut(blocks.join(_small(at), "_source"), "bk", "cb")
    inside = _open(rows, at, "bk", "cb").groupBy("_source", "_sub", "epochs", "rest", "cb").agg(F.sum("n").alias("n"))
    at = _cut(inside, "sk", "cs", "cb")
    inside = (_open(_open(rows, at, "bk", "cb"), None, "sk", "cs")
              .groupBy("_source", "_doc", "epochs", "rest", "cb", "cs").agg(F.sum("n").alias("n")))
    at = _cut(inside, "dk", "cd", "cb", "cs")
    return keep_narrow(made.join(at.select("_source", "cb", "cs", "cd"), "_source", "left"))


def _small(sources: DataFrame) -> DataFrame:
    """One row a source: broadcast when there are few, else joined by Spark's choice."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _cut(parts: DataFrame, key: str, cut: str, *keep: str) -> DataFrame:
    """The part in which the running sum of n reaches rest; rest becomes what is
    still to be taken inside it."""
    order = Window.partitionBy("_source").orderBy(key)
    missing = {c: F.lit(0) for c in ("_block", "_sub") if c not in parts.columns}
    missing |= {"_doc": F.lit("")} if "_doc" not in parts.columns else {}
    run = (parts.withColumns(missing).withColumn(key, keys(F.col("epochs"))[key])
           .withColumn("upto", F.sum("n").over(order)).filter("upto >= rest and upto - n < rest and n > 0"))
    return keep_narrow(run.select("_source", "epochs", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"),
                                  F.col(key).alias(cut), *keep))


def _open(rows: DataFrame, at: DataFrame | None, key: str, cut: str) -> DataFrame:
    joined = rows.join(_small(at), "_source") if at is not None else rows
    return joined.filter(keys(F.col("epochs"))[key] == F.col(cut))


def realise(docs: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the plan says, with mix_epoch (from 0),
    mix_block, mix_key (the order inside the epoch: rows of all sources sorted by
    it are the epoch's block permutation), mix_weight and mix_budget."""
    added = ["mix_epoch", "mix_block", "mix_key", "mix_weight", "mix_budget"]
    kept = [c for c in docs.columns if c not in added]
    # the caller's columns travel under names that nothing here uses
    bare = docs.select("doc_id", "source", *[F.col(f"`{c}`").alias(f"column_{i}") for i, c in enumerate(kept)])
    own = ("weight", "budget", "epochs", "cb", "cs", "cd")
    taken = _small(plan_rows.select("_source", *[F.col(c).alias(f"_mix_{c}") for c in own]))
    row = placed(bare).join(taken, "_source")
    cb, cs, cd = (F.col(f"_mix_{c}") for c in ("cb", "cs", "cd"))
    k = keys(F.col("_mix_epochs"))
    last = ((k["bk"] < cb) | ((k["bk"] == cb) & ((k["sk"] < cs) | ((k["sk"] == cs) & (k["dk"] <= cd)))))
    times = F.col("_mix_epochs") + F.coalesce(last, F.lit(False)).cast("int")
    row = (row.withColumn("_n", times).filter("_n > 0")
           .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    k = keys(F.col("mix_epoch"))
    key = F.concat(F.substring(k["bk"], 1, 12), F.substring(k["sk"], 1, 8), F.substring(k["dk"], 1, 12))
    row = row.withColumns({"mix_key": key, "mix_block": F.col("_block"), "mix_weight": F.col("_mix_weight"),
                           "mix_budget": F.col("_mix_budget")})
    return row.select(*[F.col(f"column_{i}").alias(c) for i, c in enumerate(kept)], *added)


def mix(docs: DataFrame, **options) -> DataFrame:
    return realise(docs, plan(docs.select("doc_id", "source", "text"), **options))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    out = realise(docs.drop("text"), plan(docs))
    return out.select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"),
                      F.col("mix_key").alias("order_key"), F.round("mix_weight", 6).alias("weight"),
                      F.col("mix_budget").alias("budget"))


OP1_SQL = rf"""
with recursive d as (
  select doc_id, source, coalesce('s:' || source, 'null') as src, coalesce(doc_id::varchar, 'null') as dn,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as n from documents),
r as (select *, ('0x' || substr(md5(dn), 1, 4))::int % {BLOCKS} as block, ('0x' || substr(md5(dn), 5, 4))::int % {BLOCKS} as sub
      from d),
s as (select src, sum(n)::bigint as tokens from r group by 1),
m as (select max(tokens)::double as most, min(tokens)::double as least from s where tokens > 0),
b(lo, hi, k) as (
  select 0.0::double, 1.0::double, 0
  union all
  select case when pow(most / least, 1 - (lo + hi) / 2) <= {MAX_REPETITION} then lo else (lo + hi) / 2 end,
         case when pow(most / least, 1 - (lo + hi) / 2) <= {MAX_REPETITION} then (lo + hi) / 2 else hi end, k + 1
  from b, m where k < {LEVELS}),
a as (select hi as a from b where k = {LEVELS}),
w as (select src, tokens, case when tokens > 0 then pow(tokens / most, a) else 0 end as share, most from s, m, a),
p as (select src, tokens, share / sum(share) over () as weight,
             case when tokens > 0 then greatest(floor(most * share)::bigint, tokens) else 0 end as budget from w),
e as (select *, case when tokens > 0 then budget // tokens else 1 end as epochs,
             case when tokens > 0 then budget % tokens else 0 end as rest from p),
-- the partial epoch is a prefix of its order: no need for levels here
o as (select r.doc_id, r.source, r.src, r.dn, r.block, r.sub, e.epochs, e.rest, e.weight, e.budget, r.n,
             md5(concat_ws('|', '{SEED}', e.epochs::varchar, r.src, r.block::varchar)) as bk,
             md5(concat_ws('|', '{SEED}', e.epochs::varchar, r.src, r.sub::varchar)) as sk,
             md5(concat_ws('|', '{SEED}', e.epochs::varchar, r.dn)) as dk
      from r join e using (src)),
l as (select *, sum(n) over (partition by src order by bk, sk, dk range unbounded preceding) as upto,
             sum(n) over (partition by src, bk, sk, dk) as same from o),
f as (select src, max((bk || sk || dk)) filter (upto >= rest and upto - same < rest and same > 0 and rest > 0) as cut
      from l group by 1),
t as (select l.*, l.epochs + case when f.cut is not null and (bk || sk || dk) <= f.cut then 1 else 0 end as times
      from l join f using (src)),
x as (select *, unnest(range(0, times::bigint)) as epoch from t)
select doc_id, source, epoch::int as epoch, block::int as block,
       substr(md5(concat_ws('|', '{SEED}', epoch::varchar, src, block::varchar)), 1, 12)
         || substr(md5(concat_ws('|', '{SEED}', epoch::varchar, src, sub::varchar)), 1, 8)
         || substr(md5(concat_ws('|', '{SEED}', epoch::varchar, dn)), 1, 12) as order_key,
       round(weight, 6) as weight, budget::bigint as budget
from x
"""
