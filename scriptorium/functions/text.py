"""Scalar text functions (X1-X13) as Column expressions.

Every function returns a JVM-side expression: no Python UDF, so the work stays
inside whole-stage codegen and runs row-local with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original application's output.
OUTLIER_LABEL = "Outlier / Noise"
OUTLIER_TOPIC_ID = -1
LABEL_PREFIX = "Topic "

# X1 regex steps. Java's '.' also stops at '\r' and other terminators, so the
# tag pattern runs in UNIX_LINES mode (?d), where only '\n' ends a line, as in
# Python. Java's \s lacks the information separators \x1C-\x1F that Python's
# \s matches, so they are added explicitly.
_TAG = r"(?d)<.*?>"
_NON_ASCII = r"[^\x00-\x7F]+"
_SPACE_RUN = r"[\s\x1C-\x1F]+"
_SPACE_BEFORE_PUNCT = r" +([.,;:?!])"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row however often ``use`` refers to it, also
    inside lambdas: it is bound as the variable of a one-element walk."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(pairs: Column) -> Column:
    """An array of (w, p) -> an array of (w, ps): the pairs are sorted and cut where ``w`` changes, so ``ps``
    holds the sorted p of a word. Row-local; linear but for the sort."""
    def cut(a: Column) -> Column:
        n = F.size(a)
        last = F.zip_with(a, F.slice(a, 2, n), lambda x, y: y.isNull() | (x["w"] != y["w"]))
        ends = F.filter(F.transform(last, lambda end, i: F.when(end, i + 1)), lambda i: i.isNotNull())
        return once(ends, lambda e: F.zip_with(F.concat(F.array(F.lit(0)), e), e, lambda i, j: F.when(j.isNotNull(), F.struct(
            F.get(a, i)["w"].alias("w"), F.transform(F.slice(a, i + 1, j - i), lambda x: x["p"]).alias("ps")))))

    return F.filter(once(F.sort_array(pairs), cut), lambda r: r.isNotNull())


def clean_text(col: Column | str) -> Column:
    """Tags and non-ASCII runs become blanks, whitespace runs collapse to one
    blank, the result is trimmed and blanks before ``.,;:?!`` are dropped.
    Null and empty input give ''."""
    c = _c(col)
    no_tags = F.regexp_replace(c, _TAG, " ")
    ascii_only = F.regexp_replace(no_tags, _NON_ASCII, " ")
    collapsed = F.trim(F.regexp_replace(ascii_only, _SPACE_RUN, " "))
    return F.coalesce(F.regexp_replace(collapsed, _SPACE_BEFORE_PUNCT, "$1"), F.lit(""))


def rebuild_abstract(index: Column | str) -> Column:
    """Rebuild text from a word -> positions inverted index, then X1.

    Every (position, map ordinal, word) triple is sorted; for a position held by
    several words the one from the later map entry wins, as when the positions
    are written into a list in map order. Gaps need no blanks because X1
    collapses whitespace anyway. Null or empty maps give ''.

    The sorted array is compared with itself shifted by one (``zip_with``
    pads the shorter side with null): a triple is kept when the next one has
    another position. Linear in the text length; the sorted array is bound
    once (``once``), not made again for each use."""
    idx = _c(index)
    triples = F.sort_array(F.flatten(F.transform(
        F.map_entries(idx),
        lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))),
    )))

    def words(t: Column) -> Column:
        following = F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
        return F.zip_with(t, following, lambda x, y: F.when(y.isNull() | (y["p"] != x["p"]), x["w"]))

    return clean_text(F.array_join(once(triples, words), " "))   # which leaves nulls out


def flatten_authors(authorships: Column | str) -> Column:
    """Keep authorships with a non-empty raw display name; clean the name
    with X1 and keep the external id. Null input gives an empty array."""
    a = _c(authorships)
    kept = F.filter(a, lambda x: F.coalesce(x["author"]["display_name"], F.lit("")) != "")
    out = F.transform(kept, lambda x: F.struct(
        clean_text(x["author"]["display_name"]).alias("name"),
        x["author"]["id"].alias("openalex_id"),
    ))
    return F.coalesce(out, F.array().cast("array<struct<name:string,openalex_id:string>>"))


def authors_text(authors: Column | str) -> Column:
    """Author names joined by ', '."""
    return F.array_join(F.transform(_c(authors), lambda x: x["name"]), ", ")


def author_key(openalex_id: Column | str, name: Column | str) -> Column:
    """External id when present and non-empty, else the lower-cased name."""
    return F.coalesce(F.nullif(_c(openalex_id), F.lit("")), F.lower(_c(name)))


def cluster_label(topic_id: Column | str, name: Column | str) -> Column:
    """``Topic {id}: {name}``; the outlier topic is 'Outlier / Noise'."""
    t = _c(topic_id)
    return (F.when(t == OUTLIER_TOPIC_ID, F.lit(OUTLIER_LABEL))
            .otherwise(F.concat(F.lit(LABEL_PREFIX), t.cast("string"), F.lit(": "), _c(name))))


def label_name(label: Column | str) -> Column:
    """Everything after the first ': ', else the whole label."""
    return F.element_at(F.split(_c(label), ": ", 2), -1)


def label_topic_id(label: Column | str) -> Column:
    """Text before the first ':', minus 'Topic ', trimmed, as INT; labels
    that do not parse give null (the caller skips them)."""
    head = F.split_part(_c(label), F.lit(":"), F.lit(1))
    return F.trim(F.replace(head, F.lit(LABEL_PREFIX), F.lit(""))).try_cast("int")


def node_size(count: Column | str) -> Column:
    """``(count | 1) + 2``: bitwise or, so even counts go up by one."""
    return _c(count).bitwiseOR(F.lit(1)) + 2


def round4(col: Column | str) -> Column:
    """Round half up to 4 places (DOUBLE)."""
    return F.round(_c(col).cast("double"), 4)


def year_text(col: Column | str) -> Column:
    """Year as text."""
    return _c(col).cast("string")


def doc_text(title: Column | str, abstract: Column | str) -> Column:
    """F2 text: ``title + '. ' + abstract`` with nulls as '' and stripped of
    surrounding whitespace (Unicode white space and \x1C-\x1F, as Python's
    ``str.strip``)."""
    joined = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(". "), F.coalesce(_c(abstract), F.lit("")))
    return F.regexp_replace(joined, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def split_names(text: Column | str) -> Column:
    """Topic filter string form: split on ',', trim, drop empties."""
    parts = F.transform(F.split(_c(text), ","), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def strip_doi_prefix(doi: Column | str) -> Column:
    """Drop the resolver prefix of a DOI URL."""
    return F.replace(_c(doi), F.lit("https://doi.org/"), F.lit(""))


def place(seq: Column | str, pos: Column | str) -> Column:
    """One sortable number for (seq, pos): exact for any long seq and any array
    position (a decimal of 19 + 10 digits), and cheap to take the minimum of."""
    a = F.col(seq) if isinstance(seq, str) else seq
    b = F.col(pos) if isinstance(pos, str) else pos
    return (a.cast("decimal(19,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + b.cast("decimal(10,0)")).cast("decimal(38,0)")
