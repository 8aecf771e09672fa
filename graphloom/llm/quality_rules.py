"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a Column over the whole text, every rule a row (measure, lower bound, upper bound)
of a table. `verdict` turns the table into one boolean expression, so a scan evaluates all of it in
one projection: no shuffle, no join, no Python.

Defined results: a null or empty text has no words and all measures 0, and fails the base rules. A
ratio whose divisor is 0 is 0. Repeated rows are judged one by one. An empty table gives an empty
result. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole_text

#: White space that separates words: blank, tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-ZÀ-ÖØ-Þ]"
#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "au ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf aus das dem den der die ein eine einen er für im ist mit nicht sich sie und von zu "
    "con del el es esta las los no para por se su una y"
).split()

#: measure, least, most: a document keeps its place if every measure lies in its range.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.2),
    ("upper_ratio", None, 0.6),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
)


def words(text: Column) -> Column:
    """The words of a text: runs of anything but the six ASCII white-space characters."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _count_of(text: Column, character_class: str) -> Column:
    """How many characters of the text are in the class: the pieces between them, less one."""
    return F.size(F.split(text, character_class, -1)).cast("long") - 1


def repeated_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are hashed to 64 bits. A text whose hashes are all different is done. Else they are sorted
    with their position, and neighbours with the same hash mark each other: n log n for any text,
    without a row per window.
    """

    def of_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, of_sorted))

    def of_sorted(s: Column) -> Column:
        marked = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return let(F.sort_array(F.transform(marked, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        """Each marked window adds its three words, less those the window before it has."""
        return F.aggregate(p, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(3), x - s["at"])).alias("n")), lambda s: s["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""

    def of_words(ws: Column) -> Column:
        return let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda ls: of_lines(ws, ls))

    def of_lines(ws: Column, ls: Column) -> Column:
        n = F.size(ws).cast("long")
        word_chars = F.length(F.array_join(ws, "")).cast("long")
        lines = F.size(ls).cast("long")
        per = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
        symbols = _count_of(text, SYMBOLS)
        upper = _count_of(text, CAPITALS)
        dups = lines - F.size(F.array_distinct(ls)).cast("long")
        return F.struct(
            n.alias("n_words"),
            word_chars.alias("word_chars"),
            symbols.alias("n_symbols"),
            dups.alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
            per(word_chars, n).alias("mean_word_chars"),
            per(symbols, word_chars).alias("symbol_ratio"),
            per(upper, word_chars).alias("upper_ratio"),
            per(F.size(F.filter(ws, lambda w: w.isin(*STOP_WORDS, *(x.title() for x in STOP_WORDS)))), n).alias("stop_word_ratio"),
            per(dups, lines).alias("dup_line_ratio"),
            per(F.size(F.filter(ls, lambda x: F.rtrim(x).endswith("..."))), lines).alias("ellipsis_line_ratio"),
            per(F.size(F.filter(ls, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("•"))), lines).alias("bullet_line_ratio"),
        )

    return let(words(text), of_words)


def verdict(m, rules=RULES) -> Column:
    """The threshold table as one expression; m: name of a measure to its Column."""
    out = F.lit(True)
    for name, least, most in rules:
        for bound in ([m(name) >= F.lit(least)] if least is not None else []) + ([m(name) <= F.lit(most)] if most is not None else []):
            out = out & bound
    return out


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, all measures, base_failed and kept of every document."""
    out = docs.select(F.col("doc_id"), measures(whole_text()).alias("m")).select("doc_id", "m.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(F.col, rules))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
