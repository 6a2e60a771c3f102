"""Topic operators: terms, c-TF-IDF keywords, labels, outliers, soft topics.

T1 term counts, T2 c-TF-IDF keywords, W6 top terms, A9 diversity, T3 topic
assignment, T4 outlier reassignment, T5 soft topics, T6 multi-labels, J13 topic
names, T7 enrichment, A8 row normalisation, F2 model-ready documents, U7 stop
words, X12 token filter.

Dimensions that are bounded by the number of topics (names, centroids) are
attached to rows as scalar subqueries (``DataFrame.scalar()``): Spark runs the
one-row subquery once and evaluates the rest row-locally, so there is neither
a cross join nor a shuffle of the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from scriptorium.functions import text as X
from scriptorium.functions.stopwords import ENGLISH_STOP_WORDS
from scriptorium.operators import packed as K
from scriptorium.operators import softtopics as S
from scriptorium.session import cut_lineage, landed, landing, shuffle_slots

# The academic stop words added to the English list, in the
# order the original lists them (duplicates included there; a set here).
ACADEMIC_STOP_WORDS = [
    "finding", "findings", "illustrate", "significant", "provide", "provides", "potential", "associated",
    "effective", "aspect", "aspects", "challenge", "challenges",
    "paper", "study", "research", "result", "results", "method", "methodology",
    "proposed", "propose", "approach", "based", "using", "used", "use", "to", "we", "source",
    "analysis", "model", "system", "data", "application", "new", "development",
    "performance", "conclusion", "abstract", "introduction", "work", "time",
    "significant", "shown", "show", "demonstrate", "experiment", "experimental",
    "university", "department", "author", "et", "al", "figure", "table",
    "high", "low", "large", "small", "different", "various", "property", "properties", "increase", "effect",
    "activity",
    "structure", "compound", "condition", "quality", "entry", "contain", "parameter", "observe", "report",
    "present", "evaluate",
]
# Fixed values of the topic rules.
TOP_N_WORDS = 15          # keywords kept per topic
NAME_WORDS = 5            # keywords joined into a fallback topic name
MULTI_ABS = 0.05          # multi-label: absolute probability floor
MULTI_REL = 0.3           # multi-label: fraction of the row maximum
OUTLIER_THRESHOLD = 0.5   # outlier reassignment: minimum cosine
SOFT_MIN_SIMILARITY = 0.01
# Word tokens of two or more word characters (the vectorizer's default).
TOKEN_PATTERN = r"\b\w\w+\b"


def stop_words() -> list[str]:
    """English stop words union the academic list, sorted, distinct."""
    return sorted(set(ENGLISH_STOP_WORDS) | set(ACADEMIC_STOP_WORDS))


# ---------------------------------------------------------------- documents

def topic_docs(papers: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """add ``doc`` = trimmed ``title. abstract``; keep rows of length >= 10."""
    return (papers.withColumn("doc", X.doc_text(title, abstract))
            .filter(F.length("doc") >= 10))


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens of 2+ word characters."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def keep_tokens(docs: DataFrame, text_col: str = "text", stop: list[str] | None = None,
                out_col: str = "tokens") -> DataFrame:
    """Adds ``out_col`` = tokens that are not stop words (a JVM hash-set lookup
    by Spark ML's ``StopWordsRemover``), not number-like, longer than 2.
    (The lemmatiser is not built; see README.)"""
    kept = _remove_stop_words(docs.withColumn("_tok", tokens(text_col)), stop)
    return (kept.withColumn(out_col, F.filter("_kept", lambda t: ~t.rlike(r"^[0-9.,]+$") & (F.length(t) > 2)))
            .drop("_tok", "_kept"))


def _remove_stop_words(docs: DataFrame, stop: list[str] | None) -> DataFrame:
    from pyspark.ml.feature import StopWordsRemover
    remover = StopWordsRemover(inputCol="_tok", outputCol="_kept", caseSensitive=True,
                               stopWords=stop if stop is not None else stop_words())
    return remover.transform(docs)


def with_terms(docs: DataFrame, text_col: str = "text", stop: list[str] | None = None,
               out_col: str = "terms") -> DataFrame:
    """T1 row part on a DataFrame: adds ``out_col`` = unigrams and bigrams
    after stop-word removal. Stop words are removed by Spark ML's
    ``StopWordsRemover`` (a JVM hash-set lookup per token); bigrams pair
    neighbours of the kept tokens, as a count vectorizer does when stop words
    are removed before n-grams are formed."""
    kept = _remove_stop_words(docs.withColumn("_tok", tokens(text_col)), stop)
    return kept.withColumn(out_col, F.concat("_kept", _bigrams(F.col("_kept")))).drop("_tok", "_kept")


def _bigrams(k: Column) -> Column:
    """The pairs of neighbours in an array of tokens."""
    nxt = F.slice(k, 2, F.greatest(F.size(k), F.lit(1)))
    return F.filter(F.zip_with(k, nxt, lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))),
                    lambda b: b.isNotNull())


def _kept_by_id(docs: DataFrame, id_col: str, text_col: str, stop: list[str] | None) -> DataFrame:
    """(id, ``_kept``): per id the kept tokens of its texts, an array a text (rows of one id count together)."""
    words = stop if stop is not None else stop_words()
    texts = docs.filter(F.col(text_col).isNotNull()).groupBy(id_col).agg(F.collect_list(text_col).alias("_texts"))
    return texts.select(id_col, F.transform("_texts", lambda t: F.filter(tokens(t), lambda w: ~w.isin(words))).alias("_kept"))


def topic_terms(docs: DataFrame, topic_col: str = "topic_id", text_col: str = "text",
                stop: list[str] | None = None, tasks: int = 0) -> DataFrame:
    """(topic, term, n) term counts per topic.

    Tokens are cut and filtered row-locally in the JVM; a task then counts the terms of many texts at once
    (``_term_counts``), so only terms that differ there become rows. Their counts are summed after one shuffle of
    packed tables (``packed``), by parts of the terms, into ``tasks`` partitions (``text_tasks``) where the session
    has fewer; a topic that holds a large share of the documents only adds rows to many tasks."""
    words = stop if stop is not None else stop_words()
    kept = docs.select(topic_col, F.filter(tokens(text_col), lambda w: ~w.isin(words)).alias("_kept"))
    out = StructType([kept.schema[topic_col], StructField("term", StringType()), StructField("n", LongType())])
    parts = max(tasks, shuffle_slots(docs))
    counted = kept.mapInArrow(lambda batches: K.pack(_term_counts(batches), parts), K.PACKED)
    return counted.repartitionById(parts, "part").mapInArrow(lambda batches: _summed(batches), out)


SUMMED_ROWS = 4_000_000         # rows of counts a task holds before it sums them


def _summed(batches, most: int = SUMMED_ROWS):
    """The packed counts of one part of the terms, summed by topic and term."""
    import pyarrow as pa

    def total(tables):
        topic, term, n = tables[0].schema.names
        return pa.concat_tables(tables).group_by([topic, term], use_threads=False).aggregate([(n, "sum")]).rename_columns([topic, term, n])

    held, size = [], 0
    for batch in batches:
        for data in batch.column("rows"):
            held.append(K.from_bytes(data.as_py()))
            size += held[-1].num_rows
            if size >= 2 * most:
                held = [total(held)]
                size, most = held[0].num_rows, max(most, held[0].num_rows)
    if held:
        yield from total(held).to_batches(max_chunksize=1 << 16)


COUNTED_TOKENS = 2_000_000      # tokens of the texts that a task counts together
TASK_TEXT = 16 << 20            # bytes of text whose terms one task holds


def text_tasks(texts: DataFrame, text_col: str = "text") -> int:
    """Tasks for the terms of ``texts``, about ``TASK_TEXT`` bytes a task: what a task holds stays as the table
    grows, whatever its files and the session's partitions are. Reads the texts' lengths once."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(-(-size // TASK_TEXT), texts.sparkSession.sparkContext.defaultParallelism)


def _term_counts(batches, most: int = COUNTED_TOKENS):
    """(topic, term, n) of rows (topic, kept tokens): unigrams and the pairs of neighbours, counted over texts
    of about ``most`` tokens. Tokens are numbered, so a pair is a number and is spelt out once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def counts(rows):
        texts = rows.column(1)
        row = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
        topics, words = rows.column(0).dictionary_encode("encode"), texts.flatten().dictionary_encode()
        size = len(words.dictionary)
        if len(topics.dictionary) * size * size >= 1 << 63:      # the pairs of these texts have no 64-bit numbers
            half = rows.num_rows // 2
            yield from counts(rows.slice(0, half))
            yield from counts(rows.slice(half))
            return
        word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = topics.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + word
        together = row[1:] == row[:-1]
        for number, pair in ((first, False), ((first[:-1] * size + word[1:])[together], True)):
            number, n = np.unique(number, return_counts=True)
            term = words.dictionary.take(pa.array(number % size))
            if pair:
                number = number // size
                term = pc.binary_join_element_wise(words.dictionary.take(pa.array(number % size)), term, " ")
            found = pa.Table.from_arrays([topics.dictionary.take(pa.array(number // size)), term, pa.array(n, pa.int64())],
                                         [rows.schema.names[0], "term", "n"])
            yield from found.to_batches(max_chunksize=1 << 16)

    def together(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        return counts(rows.to_batches()[0])

    held, size = [], 0
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(1).flatten())
        if size >= most:
            yield from together(held)
            held, size = [], 0
    if held:
        yield from together(held)


def explode_terms(df: DataFrame, *keep: str) -> DataFrame:
    """One row per term of ``terms``.

    ``explode_outer`` + a null filter instead of ``explode``: for a plain
    explode Catalyst infers ``size(terms) > 0`` and pushes that filter into the
    scan, which would run the whole cleaning and tokenising chain a second time
    inside the scan tasks, below any repartition and before any join."""
    return (df.select(*keep, F.explode_outer("terms").alias("term"))
            .filter(F.col("term").isNotNull()))


def term_weights(terms: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """T2 in one row a term: (term, idf, in_topics), ``in_topics`` an array of (t, n, class_total,
    s), one entry per topic that has the term. s is ``tf(t,c) / |c| * ln(1 + A / f(t))`` with |c| the term
    total of class c, A the integer mean of |c| over classes and f(t) the total count of the term
    over all classes (class-based TF-IDF, Grootendorst 2022); idf is the logarithm alone.

    The (topic, term) counts are shuffled once, by term. Class totals and A are scalar subqueries
    (one entry a topic) over the same counts, whose exchange Spark reuses."""
    per_class = terms.groupBy(topic_col).agg(F.sum("n").alias("class_total"))
    totals = per_class.agg(F.map_from_entries(F.collect_list(F.struct(topic_col, "class_total"))).alias("m"),
                           F.floor(F.avg("class_total")).cast("double").alias("A"))
    by_term = (terms.groupBy("term").agg(F.sum("n").alias("f"), F.collect_list(F.struct(F.col(topic_col).alias("t"), "n")).alias("c"))
               .withColumn("_totals", totals.select("m").scalar())
               .withColumn("idf", F.log(1 + totals.select("A").scalar() / F.col("f"))))
    size = F.size("c")
    cells = F.zip_with("c", F.array_repeat("idf", size), lambda x, idf: F.struct(
        x["t"].alias("t"), x["n"].alias("n"), F.element_at(F.col("_totals"), x["t"]).alias("class_total"), idf.alias("idf")))
    scored = F.transform(cells, lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n"), x["class_total"].alias("class_total"),
                                                   (x["n"] / x["class_total"] * x["idf"]).alias("s")))
    return by_term.select("term", "idf", scored.alias("in_topics"))


def ctfidf(terms: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """T2 scores per (topic, term); see ``term_weights``."""
    rows = term_weights(terms, topic_col).select("term", F.explode("in_topics").alias("x"))
    return rows.select(F.col("x.t").alias(topic_col), "term", F.col("x.n").alias("n"), F.col("x.class_total").alias("class_total"),
                       F.col("x.s").alias("score"))


def top_terms(scores: DataFrame, group_col: str, n: int = TOP_N_WORDS, term_col: str = "term",
              score_col: str = "score") -> DataFrame:
    """The ``n`` best terms per group (score desc, term asc) as an ordered
    array ``keywords``.

    Every task keeps the n best of each group among its own rows before the shuffle (Spark's
    window group limit, for n up to ``spark.sql.optimizer.windowGroupLimitThreshold``), so a group
    that holds a third of all terms sends n rows a task."""
    order = [F.desc(score_col), F.asc(term_col)]
    best = (scores.withColumn("_r", F.row_number().over(Window.partitionBy(group_col).orderBy(*order)))
            .filter(F.col("_r") <= n))
    return (best.groupBy(group_col)
            .agg(F.sort_array(F.collect_list(F.struct("_r", term_col))).alias("_k"))
            .select(group_col, F.col(f"_k.{term_col}").alias("keywords")))


def topic_keywords(terms: DataFrame, topic_ids: DataFrame, topic_col: str = "topic_id",
                   n: int = TOP_N_WORDS) -> DataFrame:
    """Top ``n`` c-TF-IDF words for every topic id of ``topic_ids``
    (0..n-1 in the original); a topic without terms gets an empty list. Runs at once: the counts are
    landed, so the passes of ``best_scores`` read them and not the texts."""
    with landing(terms.sparkSession):
        top = cut_lineage(top_terms(best_scores(landed(terms), topic_col, n), topic_col, n=n))
    return (topic_ids.select(topic_col).join(top, topic_col, "left")
            .select(topic_col, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")))


BROADCAST_TERMS = 1_000_000   # counted rows, at most, whose terms every task may hold


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` landed, for a broadcast when they are counted to be few; else the join is left to Spark."""
    rows = landed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


PROBED = 20               # times the wanted words: the most frequent terms of a topic, whose scores give the bound


def best_scores(counts: DataFrame, topic_col: str = "topic_id", n: int = TOP_N_WORDS) -> DataFrame:
    """``ctfidf`` (topic, term, score), exact, without the terms that can't be among the ``n`` best of their topic.

    A term's total count over the classes is at least its count in one, so a count k scores at most
    ``k / |c| * ln(1 + A / k)``, which grows with k. The n-th best score of a topic's most frequent terms is a lower bound
    of its n-th best of all; counts whose highest score is below it need no totals. ``counts`` must be cheap to read again."""
    levels = landed(counts.groupBy(topic_col, "n").agg(F.count(F.lit(1)).alias("m")))
    classes = levels.groupBy(topic_col).agg(F.sum(F.col("n") * F.col("m")).alias("class_total"))
    mean = classes.agg(F.floor(F.avg("class_total")).cast("double").alias("A"))

    def score(k, total):
        return k / F.col("class_total") * F.log(1 + mean.scalar() / total)

    def scored(least):
        rows = landed(counts.join(_few(least), topic_col).filter(F.col("n") >= F.col("least")).select(topic_col, "term", "n"))
        totals = counts.join(_few(rows.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("f"))
        return rows.join(totals, "term").join(classes, topic_col).select(topic_col, "term", score(F.col("n"), F.col("f")).alias("score"))

    above = F.sum("m").over(Window.partitionBy(topic_col).orderBy(F.desc("n")))
    probe = scored(levels.select(topic_col, "n", (above - F.col("m")).alias("before")).filter(F.col("before") < PROBED * n)
                   .groupBy(topic_col).agg(F.min("n").alias("least")))
    nth = (probe.withColumn("_r", F.row_number().over(Window.partitionBy(topic_col).orderBy(F.desc("score")))).filter(F.col("_r") == n)
           .select(topic_col, F.col("score").alias("bound")))
    # a topic with fewer terms has no bound; the factor is far above what rounding takes from a score
    highest = score(F.col("n"), F.col("n")) * (1 + 1e-9)
    least = (levels.join(classes, topic_col).join(landed(nth), topic_col, "left").filter(highest >= F.coalesce("bound", F.lit(0.0)))
             .groupBy(topic_col).agg(F.min("n").alias("least")))
    return scored(least)


def topic_diversity(keywords: DataFrame, n: int = TOP_N_WORDS) -> DataFrame:
    """Distinct words / total words over the first ``n`` keywords of each
    topic; 0 when there are none."""
    words = keywords.select(F.explode(F.slice("keywords", 1, n)).alias("w"))
    return words.agg(F.coalesce(F.try_divide(F.count_distinct("w"), F.count("w")), F.lit(0.0))
                     .cast("double").alias("diversity"))


# ------------------------------------------------------------- distributions

def normalise(dist: Column | str) -> Column:
    """Divide a row by its sum; a zero row stays zero."""
    d = F.col(dist) if isinstance(dist, str) else dist
    s = F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    s1 = F.when(s == 0, F.lit(1.0)).otherwise(s)
    # The sum is an argument of the walk, evaluated once; inside the lambda it
    # would be evaluated per element.
    return F.zip_with(d, F.array_repeat(s1, F.size(d)), lambda x, total: x / total)


def names_map(topic_names: DataFrame, id_col: str = "topic_id", name_col: str = "name") -> Column:
    """Topic id -> name as a scalar-subquery map (bounded by the topic count)."""
    return topic_names.agg(F.map_from_entries(F.collect_list(F.struct(id_col, name_col)))).scalar()


def multi_labels(df: DataFrame, topic_names: DataFrame, id_col: str = "cluster_id",
                 dist_col: str = "topic_distribution", abs_floor: float = MULTI_ABS,
                 rel_floor: float = MULTI_REL) -> DataFrame:
    """``predicted_multi_labels``: the primary label first, then by topic
    id every other topic with ``p > abs_floor`` and ``p >= rel_floor * max(p)``;
    outliers and empty distributions get only their own label."""
    # The map is projected as a column first: Spark accepts no subquery
    # inside a lambda, but a column holding its value is fine.
    df = df.withColumn("_names", names_map(topic_names))
    names = F.col("_names")
    tid = F.col(id_col)
    dist = F.col(dist_col)
    own = X.cluster_label(tid, F.element_at(names, tid))
    # the row's own threshold travels with each element (evaluated once a row)
    floor = F.array_repeat(F.array_max(dist) * rel_floor, F.size(dist))
    cells = F.zip_with(F.transform(dist, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), floor,
                       lambda x, least: F.struct(x["i"].alias("i"), x["p"].alias("p"), least.alias("least")))
    alts = F.filter(cells, lambda x: (x["i"] != tid) & (x["p"] > abs_floor) & (x["p"] >= x["least"]))
    alt_labels = F.transform(alts, lambda x: X.cluster_label(x["i"], F.element_at(names, x["i"])))
    plain = (tid == X.OUTLIER_TOPIC_ID) | dist.isNull() | (F.size(dist) == 0)
    return (df.withColumn("predicted_multi_labels",
                          F.when(plain, F.array(own)).otherwise(F.concat(F.array(own), alt_labels)))
            .drop("_names"))


def topic_labels(keywords: DataFrame, topic_names: DataFrame | None = None,
                 topic_col: str = "topic_id") -> DataFrame:
    """Topic name = the supplied name, else the first 5 keywords joined by
    ', '; adds ``cluster_label`` (X6)."""
    kw = keywords
    if topic_names is not None:
        kw = kw.join(topic_names.select(topic_col, F.col("name").alias("_given")), topic_col, "left")
    else:
        kw = kw.withColumn("_given", F.lit(None).cast("string"))
    name = F.coalesce("_given", F.array_join(F.slice("keywords", 1, NAME_WORDS), ", "))
    return (kw.withColumn("name", name)
            .withColumn("cluster_label", X.cluster_label(topic_col, "name"))
            .drop("_given"))


def enrich(papers: DataFrame, assign: DataFrame, labels: DataFrame, key: str = "seq") -> DataFrame:
    """Five topic columns onto each paper: ``cluster_id``, ``cluster_label``,
    ``predicted_multi_labels``, ``topic_keywords``, ``topic_distribution``.

    ``assign(key, cluster_id, topic_distribution)``; ``labels(topic_id, name,
    keywords, cluster_label)`` from J13 (bounded: one row per topic)."""
    lab = labels.select(F.col("topic_id").alias("cluster_id"), F.col("keywords").alias("_kw"))
    out = (papers.join(assign, key)
           .join(lab, "cluster_id", "left")
           .withColumn("topic_keywords", F.when(F.col("cluster_id") == X.OUTLIER_TOPIC_ID,
                                                F.array().cast("array<string>"))
                       .otherwise(F.coalesce(F.slice("_kw", 1, TOP_N_WORDS), F.array().cast("array<string>"))))
           .drop("_kw"))
    out = multi_labels(out, labels.select("topic_id", "name"))
    names = names_map(labels.select("topic_id", "name"))
    return out.withColumn("cluster_label", X.cluster_label("cluster_id", F.element_at(names, F.col("cluster_id"))))


# --------------------------------------------------------------- vectors

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda s, v: s + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def topic_centroids(vecs: DataFrame, topic_col: str = "topic_id", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per non-outlier topic: (topic, centroid ARRAY<DOUBLE>).

    Element-wise mean through ``posexplode`` + ``groupBy(topic, pos)`` with
    partial aggregation (hot topics only add partial rows), then re-assembled
    in position order; one row per topic, so the result is bounded."""
    parts = (vecs.filter(F.col(topic_col) != X.OUTLIER_TOPIC_ID)
             .select(topic_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
             .groupBy(topic_col, "pos").agg(F.avg("x").alias("m")))
    return (parts.groupBy(topic_col)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_c"))
            .select(topic_col, F.col("_c.m").alias("centroid")))


def _unit_centroids(cents: DataFrame, topic_col: str) -> Column:
    """All centroids, scaled to length 1, as one scalar value: array of (t, c) by
    topic id. One row a topic times the vector's length."""
    n = _norm(F.col("centroid"))
    unit = F.zip_with("centroid", F.array_repeat(n, F.size("centroid")), lambda x, length: x / length)
    return cents.agg(F.array_sort(F.collect_list(F.struct(F.col(topic_col).alias("t"), unit.alias("c"))))).scalar()


def centroid_distribution(vecs: DataFrame, id_col: str = "vec_id", topic_col: str = "topic_id",
                          vec_col: str = "embedding", out_col: str = "topic_distribution") -> DataFrame:
    """(id, topic, distribution): the cosine of each vector with every topic's mean
    vector, negative ones as 0, normalised to sum 1 (A8); entry t is topic t, 0 for
    an id without a centroid. Reads whole vectors."""
    packed = _unit_centroids(topic_centroids(vecs, topic_col, vec_col), topic_col)
    rows = vecs.select(id_col, topic_col, vec_col).withColumn("_cents", packed)
    near = F.transform("_cents", lambda c: F.struct(c["t"].alias("t"), F.greatest(
        _dot(F.col(vec_col), c["c"]), F.lit(0.0)).alias("p")))
    rows = rows.withColumn("_near", F.map_from_entries(near))
    last = F.coalesce(F.array_max(F.map_keys("_near")), F.lit(-1))
    dense = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last),
                                          lambda t: F.coalesce(F.try_element_at(F.col("_near"), t), F.lit(0.0))))
    return rows.select(id_col, topic_col, normalise(F.coalesce(dense, F.array().cast("array<double>"))).alias(out_col))


def reassign_outliers(vecs: DataFrame, threshold: float = OUTLIER_THRESHOLD, id_col: str = "vec_id",
                      topic_col: str = "topic_id", vec_col: str = "embedding") -> DataFrame:
    """T4: an outlier (-1) moves to the topic whose mean vector has the highest
    cosine with it, if that cosine is at least ``threshold``; others keep their
    topic. Returns (id, old topic, ``new_topic_id``, ``best_similarity``).

    Centroids (one per topic) travel as a scalar subquery; each outlier row
    scores all of them row-locally and keeps the best (ties: lower topic id)."""
    cents = topic_centroids(vecs, topic_col, vec_col)
    packed = _unit_centroids(cents, topic_col)
    vecs = vecs.withColumn("_cents", packed)   # no subquery inside the lambda
    # A row's norm doesn't change which centroid is nearest: it divides the best
    # score once, outside the walk over the centroids.
    scored = F.transform(F.col("_cents"), lambda c: F.struct(_dot(F.col(vec_col), c["c"]).alias("s"),
                                                             (-c["t"]).alias("nt")))
    best = F.array_max(scored)
    is_out = F.col(topic_col) == X.OUTLIER_TOPIC_ID
    cosine = best["s"] / _norm(F.col(vec_col))
    sim = F.when(is_out, cosine)
    moved = is_out & (cosine >= threshold)
    return vecs.select(id_col, topic_col,
                       F.when(moved, -best["nt"]).otherwise(F.col(topic_col)).alias("new_topic_id"),
                       F.round(sim, 6).alias("best_similarity"))


def assign_topics(vecs: DataFrame, k: int, seed: int = 42, vec_col: str = "embedding",
                  id_col: str = "vec_id", max_iter: int = 50, components: int = 5) -> DataFrame:
    """Topic assignment with a soft distribution per document.

    Re-aimed on Spark ML: the vectors are reduced to ``components`` dimensions
    (PCA, standing in for the original's 5-component reduction), then a
    Gaussian mixture gives a hard ``cluster_id`` (most probable component) and
    ``topic_distribution`` (the component probabilities). Both fits are
    distributed (tree aggregation per iteration). The clusters are not those of
    the original density clustering; only shape and invariants are checked."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    data = vecs.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("raw"))
    reduced = PCA(k=components, inputCol="raw", outputCol="features").fit(data).transform(data)
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(reduced)
    out = model.transform(reduced)
    return out.select(id_col, F.col("prediction").cast("int").alias("cluster_id"),
                      vector_to_array("probability").alias("topic_distribution"))


def topic_lookup(terms: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """(term, idf, in_topics): one row a term; ``in_topics`` its score in every real topic that has
    it, divided by the topic's norm (t, s), at most one entry a topic."""
    weights = term_weights(terms, topic_col)
    real = F.filter("in_topics", lambda x: x["t"] != X.OUTLIER_TOPIC_ID)
    norms = (weights.select(F.explode(real).alias("x")).groupBy(F.col("x.t").alias("t")).agg(F.sqrt(F.sum(F.col("x.s") * F.col("x.s"))).alias("tn"))
             .agg(F.map_from_entries(F.collect_list(F.struct("t", "tn")))).scalar())
    return (weights.select("term", "idf", real.alias("x"), norms.alias("_norms"))
              .select("term", "idf", F.transform("x", lambda x: F.struct(
                  x["t"].alias("t"), (x["s"] / F.element_at(F.col("_norms"), x["t"])).alias("s"))).alias("in_topics")))


def soft_topics(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                topic_col: str = "topic_id", min_similarity: float = SOFT_MIN_SIMILARITY,
                stop: list[str] | None = None) -> DataFrame:
    """T5: per document, cosine of its c-TF-IDF vector with each (non-outlier)
    topic's c-TF-IDF vector; similarities below ``min_similarity`` are dropped
    and the rest normalised to sum 1 (A8). Long form (doc, topic, prob).

    ``terms`` is T1's output for the fitted topics. Whole documents are scored;
    ``window_topics`` scores sliding token windows. Runs at once, see ``_shares``."""
    return _shares(docs, terms, id_col, text_col, topic_col, min_similarity, stop, None)


# terms landed front-coded and compressed
_SMALL = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def _shares(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, topic_col: str, min_similarity: float,
            stop: list[str] | None, window: int | None) -> DataFrame:
    """(id, topic, prob) of whole documents, or of their windows summed (``softtopics``).

    Kept tokens travel as numbers, in batches of many texts. A batch asks for each of its distinct terms once, and
    the answers go back to it, so no (document, term) pair is a row. Every step is landed, and its shuffles
    are gone before the next."""
    spark = docs.sparkSession
    topic_type = terms.schema[topic_col].dataType
    with landing(spark):
        counts = landed(terms.select(F.col(topic_col).alias("t"), "term", "n"), **_SMALL)
        classes = counts.groupBy("t").agg(F.sum("n").alias("total"))
        row = classes.agg(F.collect_list(F.struct("t", "total")).alias("c"), F.floor(F.avg("total")).cast("double").alias("A")).first()
        totals, mean = {x["t"]: x["total"] for x in row["c"]}, row["A"] or 0.0
        batches = landed(_kept_by_id(docs, id_col, text_col, stop).mapInArrow(lambda b: S.pack_texts(b), S.BATCH))
        n_batches, tokens = batches.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        tasks = spark.sparkContext.defaultParallelism
        parts = max(-(-max(tokens, counts.count()) // S.PART_ROWS), tasks)
        pairs = window != 1
        known = counts.mapInArrow(lambda b: K.pack(b, parts), K.PACKED).select("part", F.lit(None).cast("long").alias("batch"), "rows")
        asked = batches.select("batch", "texts", "codes", "words").mapInArrow(lambda b: S.ask(b, parts, pairs), S.ASKED)
        out = StructType([StructField("part", IntegerType()), StructField("batch", LongType()), StructField("found", BinaryType()),
                          StructField("entries", BinaryType()),
                          StructField("norms", ArrayType(StructType([StructField("t", topic_type), StructField("v", DoubleType())])))])
        answers = landed(known.unionByName(asked).repartitionById(parts, "part")
                         .mapInArrow(lambda b: S.answer(b, totals, mean, X.OUTLIER_TOPIC_ID), out))
        norms = {x["t"]: x["v"] for x in answers.select(F.explode("norms").alias("x")).groupBy("x.t").agg(F.sum("x.v").alias("v")).collect()}
        met = (batches.drop("tokens").unionByName(answers.filter("batch is not null").drop("norms"), allowMissingColumns=True)
               .repartition(max(2 * n_batches, tasks), "batch"))
        arrow = to_arrow_type(topic_type)
        scored = cut_lineage(met.mapInArrow(lambda b: S.score(b, parts, totals, norms, mean, window, min_similarity, arrow), "rows binary"))
    out = StructType([docs.schema[id_col], StructField(topic_col, topic_type), StructField("prob", DoubleType())])
    return scored.mapInArrow(lambda b: S.unpack(b, id_col, topic_col), out).select(id_col, topic_col, F.round("prob", 6).alias("prob"))


WINDOW = 4                # tokens scored together


def window_topics(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  topic_col: str = "topic_id", window: int = WINDOW, min_similarity: float = SOFT_MIN_SIMILARITY,
                  stop: list[str] | None = None) -> DataFrame:
    """T5 by sliding windows: every run of ``window`` kept tokens (one token further each time; a
    shorter text is one window) is scored against the topics by the cosine of c-TF-IDF vectors, similarities
    below ``min_similarity`` are dropped window by window, the rest summed over the text and normalised
    to sum 1 (A8). Long form (doc, topic, prob).

    A text's windows are scored where its tokens and the scores of its batch's terms meet (``_shares``; numpy,
    many texts at a time), so no window of a term becomes a row. Work grows with the text's length. Runs at once."""
    return _shares(docs, terms, id_col, text_col, topic_col, min_similarity, stop, window)
