"""Rows to triples, and the personal-data report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import is_not_null

BASE = "urn:graphloom:"
#: The XSD type of a column kind.
XSD = {"int": "xsd:integer", "long": "xsd:integer", "double": "xsd:decimal", "string": "xsd:string", "time": "xsd:dateTime"}


#: Characters that no name in a line may hold.
_ILLEGAL = '<>"{}|^`\\ \t\n\r'


def key_text(keys: list[str]) -> Column:
    """The key's values as a part of a name, told apart: each is encoded, semicolons part them, a null is a tilde."""
    return F.concat_ws(";", *(F.coalesce(F.url_encode(F.col(k).cast("string")), F.lit("~")) for k in keys))


def row_uri(table: str, rank: int, keys: list[str], base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}{table}_{rank}_"), key_text(keys))


def triples(table: str, rows: DataFrame, rank: int, keys: list[str], attributes: dict[str, str], fks: dict[str, tuple[str, int, str]], others: dict[str, DataFrame], base: str = BASE, unique: bool = True) -> DataFrame:
    """s, p, o, o_kind, datatype of every row: its type, its attributes and its foreign keys both ways.

    Type and attributes come from one pass over the rows. A foreign key that the target holds is an edge; the join moves the two keys only. unique says that the
    keys are a key (checked before, as a surrogate key is by its making): then no triple can come twice and nothing is shuffled to find such ones.
    """
    triple = lambda p, o, kind, datatype: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"))
    parts = [triple("rdf:type", F.lit(base + table), "iri", None)]
    for c, kind in attributes.items():
        value = (F.col(c).cast("decimal(18,2)") if kind == "double" else F.col(c)).cast("string")
        parts.append(triple(f"has_{c}", F.when(is_not_null(F.col(c)), value), "lit", XSD[kind]))
    out = [rows.select(row_uri(table, rank, keys, base).alias("s"), F.inline(F.filter(F.array(*parts), lambda x: x["o"].isNotNull())))]
    for c, (other, other_rank, key) in fks.items():
        held = rows.join(others[other].select(F.col(key).alias("__key")).distinct(), F.col(c) == F.col("__key"), "left_semi")
        me, them = row_uri(table, rank, keys, base), row_uri(other, other_rank, [c], base)
        edge = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
        out.append(held.select(F.inline(F.array(edge(me, f"p_{table}_{other}", them), edge(them, f"p_{other}_{table}", me)))))
    both = reduce(DataFrame.unionByName, out)
    return both if unique else both.distinct()


def ntriples(t: DataFrame, beside: str | None = None) -> DataFrame:
    """One line for each triple, beside a column if asked; literals and names are escaped as the format asks, so no line holds a break."""
    def iri(c: Column) -> Column:
        for char in _ILLEGAL:
            c = F.replace(c, F.lit(char), F.lit(f"%{ord(char):02X}"))
        return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    escaped = F.col("o")
    for char, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(char), F.lit(written))
    typed = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^"), iri(F.col("datatype")))).otherwise(F.lit(""))
    o = F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), typed))
    lang = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.lit("")) if "lang" in t.columns else F.lit("")
    end = F.when(F.col("o_kind") == "iri", F.lit(" .")).otherwise(F.concat(lang, F.lit(" .")))
    return t.select(*([beside] if beside else []), F.concat(iri(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), o, end).alias("line"))


def pii_flags(closed: DataFrame, matches: DataFrame) -> DataFrame:
    """Per column whether a match is, or lies below, the three anchors."""
    below = matches.join(closed, F.col("match") == F.col("node"))
    flag = lambda x: F.bool_or(F.col("ancestor") == x)
    return below.groupBy("table", "column").agg(flag("PersonalData").alias("is_personal"), flag("Identifying").alias("is_identifying"), flag("SpecialCategoryPersonalData").alias("is_special"))


def most_specific(closed: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches without those that another match of the column lies below; no order matters."""
    above = matches.join(closed.where("depth > 0"), F.col("match") == F.col("node")).select("table", "column", F.col("ancestor").alias("match"))
    return matches.distinct().join(above, ["table", "column", "match"], "left_anti")


def ends_in(names: DataFrame, column: str, suffixes: DataFrame) -> DataFrame:
    """The rows whose name ends in one of the suffixes: each name's own endings are looked up, so it is a join on equality."""
    met = names.select(F.col(column).alias("__n")).distinct().select("__n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__n"), F.lit(1))), lambda i: F.substr(F.col("__n"), i))).alias("suffix"))
    return names.join(met.join(suffixes.select("suffix"), "suffix", "left_semi").select("__n").distinct(), F.col(column) == F.col("__n"), "left_semi")


def append_notified(found: DataFrame, columns: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Columns whose name ends in a notified one count as personal unless they are found already."""
    told = ends_in(columns, "column", suffixes).select("table", "column").distinct()
    return found.unionByName(told.join(found, ["table", "column"], "left_anti").withColumn("is_personal", F.lit(True)))
