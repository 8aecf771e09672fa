"""Scalar functions on identifiers, spans, paths and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of day columns in files to be loaded.
LOADER_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd")
#: Words that a thesaurus isn't asked for.
STOPWORDS = ("a", "an", "the", "of", "and", "or", "in", "on", "to", "for", "with", "by", "is", "has")


def split_identifier(c: Column) -> Column:
    """The words of a programming name: pieces that begin with a digit or a capital; pieces of one capital that follow one another are one word."""
    pieces = F.regexp_extract_all(c, F.lit("^[a-z]+|[0-9A-Z][a-z]*"), F.lit(0))
    single = lambda x: x.rlike("^[0-9A-Z]$")

    def step(s: Column, x: Column) -> Column:
        glued = s["open"] & single(x)
        words = F.when(glued, F.concat(F.slice(s["w"], 1, F.greatest(F.size(s["w"]) - 1, F.lit(0))), F.array(F.concat(F.element_at(s["w"], -1), x)))).otherwise(F.concat(s["w"], F.array(x)))
        return F.struct(words.alias("w"), single(x).alias("open"))

    return F.aggregate(pieces, F.struct(F.array().cast("array<string>").alias("w"), F.lit(False).alias("open")), step, lambda s: F.array_join(s["w"], " "))


def annotation_text(c: Column, identifiers: bool = False) -> Column:
    """A label as it is indexed: underscores as blanks, names cut into words if asked, lower case."""
    plain = F.replace(c, F.lit("_"), F.lit(" "))
    return F.lower(F.array_join(F.transform(F.split(plain, " "), split_identifier), " ") if identifiers else plain)


def thesaurus_tokens(c: Column) -> Column:
    """Words to look up: slashes, apostrophes, underscores and hyphens part words, other punctuation and digits go, and so do stop words."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(c, "['/_-]", " "), r"[^\p{L} ]", "")), " +")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def named_codes(text: Column, names: Column) -> Column:
    """The text with every code in brackets replaced by its name, where it has one. names: a map from code, brackets included, to name."""
    codes = F.regexp_extract_all(text, F.lit(r"\(.*?\)"), F.lit(0))
    parts = F.split(text, r"\(.*?\)", -1)
    return F.array_join(F.zip_with(parts, codes, lambda p, c: F.concat(p, F.coalesce(names[c], c, F.lit("")))), "")


def file_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def processed_path(path: Column, folder: str = "processed") -> Column:
    """Where the repaired form of a file lies: a folder beside it, the same stem, as CSV."""
    return F.concat(F.regexp_extract(path, r"^(.*[/\\])?", 0), F.lit(folder + "/"), file_stem(path), F.lit(".csv"))


def loaded_date(c: Column) -> Column:
    """A timestamp in one of the loader's patterns, the first that fits."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in LOADER_FORMATS))


def second_share(first: Column, second: Column) -> Column:
    """The softmax share of the second of two scores."""
    return 1 / (1 + F.exp(first - second))


def ends_of(path: Column) -> tuple[Column, Column]:
    """The first and the last step of a path; null where it has none."""
    return F.get(path, 0), F.get(path, F.size(path) - 1)


def substituted(text: Column, spans: Column) -> Column:
    """The text with spans replaced, given in order and apart: array of struct(start, end, new), from 0, the end not included."""
    step = lambda s, x: F.struct(F.concat(s["t"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), x["new"]).alias("t"), x["end"].alias("at"))
    return F.aggregate(spans, F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), step, lambda s: F.concat(s["t"], F.substr(text, s["at"] + 1, F.length(text))))


def runs_of(numbers: Column) -> Column:
    """Sorted numbers as runs of consecutive ones: array of struct(low, high)."""

    def step(s: Column, x: Column) -> Column:
        on = F.when(F.size(s) > 0, F.try_element_at(s, F.lit(-1))["high"] + 1 == x).otherwise(F.lit(False))
        return F.when(on, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(s, F.lit(-1))["low"].alias("low"), x.alias("high"))))).otherwise(F.concat(s, F.array(F.struct(x.alias("low"), x.alias("high")))))

    return F.aggregate(numbers, F.array().cast("array<struct<low:int,high:int>>"), step)


def uniqified(c: Column) -> Column:
    """Different elements in the order they come first, without empty ones."""
    return F.array_distinct(F.filter(c, lambda x: x != ""))


def product(options: Column) -> Column:
    """All ways to take one of each list, joined by blanks."""
    return F.aggregate(options, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda x: F.btrim(F.concat_ws(" ", a, x))))))


def value_of_boolean(c: Column) -> Column:
    """The truth value of a text that stands for one: 1 and true, 0 and false; null for any other."""
    t = F.lower(c)
    return F.when(t.isin("1", "true"), F.lit(True)).when(t.isin("0", "false"), F.lit(False))
