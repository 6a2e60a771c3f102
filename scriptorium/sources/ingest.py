"""Ingest of landed API responses (S8, S9, W5, J14, L7, U2) and the clean
projection (F1).

The HTTP clients are not rebuilt: responses are landed as files and read as
DataFrames, and these functions apply the original's row rules to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.session import shuffle_slots

# Fixed values of the ingest rules.
NO_TITLE = "(No Title)"


def _truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def roster_from_staff(staff: DataFrame, institution: str, requested_faculty: str | Column | None = None) -> DataFrame:
    """Roster rows from staff rows: skip rows missing a first or last name;
    name = trimmed first + ' ' + trimmed last; faculty = the row's own faculty
    or else the requested one, trimmed; email trimmed or null; constant
    institution. ``staff`` may carry the requested faculty as ``faculty_en``."""
    req = (F.col("faculty_en") if requested_faculty is None else
           (F.lit(requested_faculty) if isinstance(requested_faculty, str) else requested_faculty))
    first, last = F.col("First_Name_En"), F.col("Last_Name_En")
    return (staff.filter(_truthy(first) & _truthy(last))
            .select(F.concat(F.trim(first), F.lit(" "), F.trim(last)).alias("name"),
                    F.lit(institution).alias("institution"),
                    F.trim(F.when(_truthy(F.col("Faculty_Name_En")), F.col("Faculty_Name_En")).otherwise(req))
                     .alias("faculty"),
                    F.when(_truthy(F.col("Email")), F.trim("Email")).alias("email")))


def works_from_raw(items: DataFrame) -> DataFrame:
    """Raw work items to raw papers: drop works without a DOI, strip the
    resolver prefix, rename ``publication_year``/``venue_name``/
    ``cited_by_count``; title defaults to '(No Title)' and citations to 0.
    (The original defaults only a *missing* key; a DataFrame cannot tell a
    missing key from null, so null is defaulted too.)"""
    return (items.filter(_truthy(F.col("doi")))
            .select(X.strip_doi_prefix("doi").alias("doi"),
                    F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
                    "authorships",
                    F.col("publication_year").alias("year"),
                    F.col("venue_name").alias("venue"),
                    "abstract_inverted_index",
                    F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
                    *([c for c in ("seq",) if c in items.columns])))


def clean_papers(raw: DataFrame) -> DataFrame:
    """the clean-record projection of raw papers."""
    authors = X.flatten_authors("authorships")
    return raw.select(
        *([c for c in ("seq",) if c in raw.columns]),
        "doi",
        X.clean_text("title").alias("title"),
        X.rebuild_abstract("abstract_inverted_index").alias("abstract"),
        authors.alias("authors_struct"),
        "year", "venue",
        F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
        X.authors_text(authors).alias("authors_text"),
    )


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, salts: int | None = None,
                    salt_col: str | None = None) -> DataFrame:
    """Exact top ``n`` rows per group by ``order``, skew-safe: rank inside
    (group, salt) buckets first, keep ``n`` per bucket, then rank the
    survivors per group. Adds ``rank`` (1-based)."""
    salts = salts or shuffle_slots(df)
    salt_src = F.col(salt_col) if salt_col else F.xxhash64(*[F.col(c) for c in df.columns])
    s = df.withColumn("_salt", F.pmod(F.xxhash64(salt_src), F.lit(salts)))
    s1 = (s.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)))
          .filter(F.col("_r") <= n))
    return (s1.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
            .filter(F.col("rank") <= n).drop("_salt", "_r"))


def cap_per_author(works: DataFrame, n: int, author: str = "author", date: str = "publication_date",
                   work_id: str = "work_id") -> DataFrame:
    """Per author, the newest ``n`` works (date desc, id for ties), applied
    before the DOI filter, as the fetch cap does."""
    return top_n_per_group(works, author, [F.desc_nulls_last(date), F.asc(work_id)], n, salt_col=work_id)


def resolve_author(names: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """External id per author name: the best-ranked candidate (rank asc,
    id asc) of that name's search results, else null. ``candidates(name,
    candidate_id, rank)``. A ``min_by`` aggregate, not a window."""
    best = (candidates.groupBy(name)
            .agg(F.min_by("candidate_id", F.struct("rank", "candidate_id")).alias("openalex_id")))
    return names.join(best, name, "left")


def head_by(roster: DataFrame, n: int | None, seq: str = "seq") -> DataFrame:
    """The first ``n`` roster rows when ``n`` > 0, else all."""
    return roster.orderBy(seq).limit(n) if n and n > 0 else roster


def union_works(*dfs: DataFrame) -> DataFrame:
    """Append the works of all authors."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
