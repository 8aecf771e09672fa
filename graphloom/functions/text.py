"""Scalar functions on labels, names and values, as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that count as null, compared in lower case.
NULL_TOKENS = ("none", "null", "", " ", "-")


def is_not_null(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(c.cast("string")).isin(*NULL_TOKENS)


def local_name(uri: Column) -> Column:
    name = F.regexp_extract(uri, r"[/#]([^/#]+)$", 1)
    return F.when(name != "", name)


def namespace(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^(.*/)", 1)


def valid_name(c: Column) -> Column:
    """Characters that an IRI may not hold become underscores."""
    return F.regexp_replace(c, r"[/\\%# ]", "_")


def normalise_label(c: Column) -> Column:
    """Brackets and commas go, underscores become blanks, the words `p`, `VALUE` and `ATTR` of generated names go, and so does `has` before `is`. Only whole words, unlike a plain text replacement."""
    out = F.regexp_replace(F.regexp_replace(c, r"[\[\],]", ""), "_", " ")
    out = F.regexp_replace(out, r"(^| )p ", "$1")
    out = F.regexp_replace(out, r" (VALUE|ATTR)( |$)", "$2")
    return F.regexp_replace(out, "^has is", "is")


def remove_punctuation(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[!-/:-@\[-`{-~]", " "))


def split_camel(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"[A-Z]+(?=[A-Z][a-z]|$|[^A-Za-z])|[A-Z]?[a-z]+"), F.lit(0)), " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda v: v != "")) for c in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def length_difference(a: Column, b: Column) -> Column:
    """In percent of the mean length."""
    return F.try_divide(F.abs(F.length(a) - F.length(b)), (F.length(a) + F.length(b)) / 2) * 100


def word_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, all places of a at once as the bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for y in b:
        hit = open_ & at.get(y, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def _indel(a: str, b: str) -> float:
    """200 * longest common subsequence / total length: the indel similarity in percent."""
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """The best similarity of the shorter text to a stretch of the longer of its length."""
    x, y = sorted((a, b), key=len)
    if x in y:
        return 100.0 if x or not y else 0.0
    return max(_indel(x, y[i : i + len(x)]) for i in range(len(y) - len(x) + 1))


def _of_pairs(measure):
    """A vectorised function of two columns of texts; each different pair of a batch is measured once."""

    @F.pandas_udf(T.DoubleType())
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b, strict=True):
            p = (p[0] or "", p[1] or "")
            if p not in known:
                known[p] = measure(*p)
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    return measured


def _sorted_words(x: str) -> str:
    return " ".join(sorted(x.lower().split()))


ratio = _of_pairs(_indel)
partial_ratio = _of_pairs(_partial)
partial_token_sort_ratio = _of_pairs(lambda a, b: _partial(_sorted_words(a), _sorted_words(b)))


def date_format_of(c: Column) -> Column:
    """The pattern of a date text with . / or - between its parts, months first where both fit; null if it is none. Years from 1900 to 2199."""
    part = lambda p, i: F.regexp_extract(c, p, i).try_cast("int")
    ymd, mdy, ym, my = r"^(\d{4})[./-](\d{1,2})[./-](\d{1,2})$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", r"^(\d{4})[./-](\d{1,2})$", r"^(\d{1,2})[./-](\d{4})$"
    year = lambda y: y.between(1900, 2199)
    return (
        F.when(c.rlike(ymd) & year(part(ymd, 1)) & part(ymd, 2).between(1, 12) & part(ymd, 3).between(1, 31), F.lit("y-M-d"))
        .when(c.rlike(ymd) & year(part(ymd, 1)) & part(ymd, 3).between(1, 12) & part(ymd, 2).between(13, 31), F.lit("y-d-M"))
        .when(c.rlike(mdy) & year(part(mdy, 3)) & part(mdy, 1).between(1, 12) & part(mdy, 2).between(1, 31), F.lit("M-d-y"))
        .when(c.rlike(mdy) & year(part(mdy, 3)) & part(mdy, 2).between(1, 12) & part(mdy, 1).between(13, 31), F.lit("d-M-y"))
        .when(c.rlike(ym) & year(part(ym, 1)) & part(ym, 2).between(1, 12), F.lit("y-M"))
        .when(c.rlike(my) & year(part(my, 2)) & part(my, 1).between(1, 12), F.lit("M-y"))
        .when(c.rlike(r"^\d{4}$") & year(c.try_cast("int")), F.lit("y"))
    )


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd of a date text, missing parts as 01; null if it is none or no such day."""
    form = date_format_of(c)
    n = lambda i: F.get(F.split(c, "[./-]"), i)
    y = F.when(form.startswith("y"), n(0)).otherwise(F.when(form == "M-y", n(1)).otherwise(n(2)))
    m = F.when(form.isin("y-M-d", "y-M"), n(1)).when(form == "y-d-M", n(2)).when(form.isin("M-d-y", "M-y"), n(0)).when(form == "d-M-y", n(1)).otherwise(F.lit("1"))
    d = F.when(form == "y-M-d", n(2)).when(form.isin("y-d-M", "M-d-y"), n(1)).when(form == "d-M-y", n(0)).otherwise(F.lit("1"))
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(form.isNotNull(), F.date_format(F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd"))
