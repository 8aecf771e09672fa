"""Alignment files: mapping tables, alignment RDF, triples, JSON lines and repaired JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_mappings(spark: SparkSession, path: str, threshold: float = 0.0, reference: bool = False) -> DataFrame:
    """SrcEntity, TgtEntity, Score of a .tsv or .csv with a header; rows under the threshold go, a reference scores 1. The texts NULL and n/a stay texts."""
    rows = spark.read.option("header", True).option("sep", "," if path.endswith(".csv") else "\t").csv(path)
    score = F.lit(1.0) if reference else F.col("Score").try_cast("double")
    return rows.select("SrcEntity", "TgtEntity", score.alias("Score")).where(F.col("Score") >= threshold)


def read_alignment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reference, ignored) of an alignment in RDF: entity1, entity2, relation, measure; a relation of ? is to be ignored."""
    schema = "entity1 struct<`_rdf:resource`: string>, entity2 struct<`_rdf:resource`: string>, relation string, measure string"
    cells = spark.read.format("xml").option("rowTag", "Cell").schema(schema).load(path)
    rows = cells.select(F.col("entity1.`_rdf:resource`").alias("src"), F.col("entity2.`_rdf:resource`").alias("tgt"), F.btrim("relation").alias("relation"), F.col("measure").try_cast("double").alias("measure"))
    return rows.where(F.col("relation").isin("=", ">", "<")), rows.where("relation = '?'")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text column `value` for each line that is not blank, without a byte order mark."""
    return spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.btrim("value") != "")


def repair_json(text):
    """Objects that follow one another in lines become an array; valid JSON stays as it is."""
    between = r"\}\s*\n\s*\{"  # no valid JSON holds this, as texts hold no line breaks
    joined = F.concat(F.lit("["), F.regexp_replace(F.btrim(text), between, "},\n{"), F.lit("]"))
    return F.when(F.try_parse_json(text).isNotNull() & ~text.rlike(between), text).otherwise(F.regexp_replace(joined, r",\s*\]$", "]"))


_TERM = r"(<[^>]*>|_:\S+)"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?'


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """s, p, o, o_kind, datatype, lang of N-Triples lines; comments and blank lines are no triples."""
    line = F.btrim(F.col(column))
    pattern = rf"^{_TERM}\s+<([^>]*)>\s+(?:{_TERM}|{_LITERAL})\s*\.\s*(?:#.*)?$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    iri = part(3) != ""
    hold = "\x00"
    literal = F.replace(part(4), F.lit("\\\\"), F.lit(hold))
    for written, char in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (hold, "\\")):
        literal = F.replace(literal, F.lit(written), F.lit(char))
    given = lambda i: F.when(part(i) != "", part(i))
    return lines.where(line.rlike(pattern)).select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(iri, bare(part(3))).otherwise(literal).alias("o"), F.when(iri, "iri").otherwise("lit").alias("o_kind"), given(5).alias("datatype"), given(6).alias("lang"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """An N-Triples file or folder; it splits, unlike Turtle and RDF/XML, so that is what graphs are exchanged in here."""
    return parse_ntriples(spark.read.text(path))
