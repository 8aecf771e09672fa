"""Table profiling: keys, inclusion dependencies, column types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import date_format_of, is_not_null


def unpivot(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) of every cell, as strings: one pass for all columns."""
    names = columns or df.columns
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names))
    return df.select(F.inline(cells))


def candidate_keys(df: DataFrame, table: str) -> DataFrame:
    """Per column the number of rows and different values (null is one), and whether it is a key. One aggregation over unpivoted cells, combined before it shuffles."""
    counts = unpivot(df).groupBy("column", "value").agg(F.count("*").alias("c"))
    out = counts.groupBy("column").agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_values"))
    return out.select(F.lit(table).alias("table"), "column", "n_rows", "n_values", (F.col("n_rows") == F.col("n_values")).alias("is_key"))


Pair = tuple[tuple[str, str], tuple[str, str]]


def overlaps(tables: dict[str, DataFrame], pairs: list[Pair]) -> DataFrame:
    """Of each pair of (table, column) how many different values, null tokens apart, the source and the target have, and how many they share: src_table, src_column, tgt_table, tgt_column, n_src, n_tgt, shared.

    One pass over all columns: each different value is met once with the columns that hold it, whatever the number of pairs.
    """
    number = {c: i for i, c in enumerate(sorted({c for p in pairs for c in p}))}
    spark = next(iter(tables.values())).sparkSession
    cells = [tables[t].select(F.inline(F.array(*(F.struct(F.lit(number[t, c]).alias("c"), F.col(c).cast("string").alias("v")) for c in tables[t].columns if (t, c) in number)))) for t in {t for t, _ in number}]
    held = reduce(DataFrame.unionByName, cells).where(is_not_null(F.col("v"))).groupBy("v").agg(F.collect_set("c").alias("in"))
    sizes = {r.c: r.n for r in held.select(F.explode("in").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row for each column
    both = F.array(*(F.struct(F.lit(number[a]).alias("a"), F.lit(number[b]).alias("b")) for a, b in pairs))
    met = held.select(F.inline(F.filter(both, lambda p: F.array_contains("in", p["a"]) & F.array_contains("in", p["b"])))).groupBy("a", "b").agg(F.count("*").alias("shared"))
    rows = [(number[a], number[b], *a, *b, sizes.get(number[a], 0), sizes.get(number[b], 0)) for a, b in pairs]
    all_pairs = spark.createDataFrame(rows, "a int, b int, src_table string, src_column string, tgt_table string, tgt_column string, n_src long, n_tgt long")
    return all_pairs.join(met, ["a", "b"], "left").drop("a", "b").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))


def discover_fks(tables: dict[str, DataFrame], name=lambda c: c) -> DataFrame:
    """Columns with the name of another table's candidate key that holds all their values. name: what of a column's name is compared."""
    pairs = [((s, c), (t, k)) for s in tables for c in tables[s].columns for t in tables if s != t for k in tables[t].columns if name(c) == name(k)]
    if not pairs:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "src_table string, src_column string, tgt_table string, tgt_column string")
    wanted = {t: sorted({k for _, (u, k) in pairs if u == t}) for t in tables}
    keys = reduce(DataFrame.unionByName, [candidate_keys(tables[t].select(*ks), t) for t, ks in wanted.items() if ks]).where("is_key")
    held = overlaps(tables, pairs).where("n_src > 0 and shared = n_src")
    return held.join(keys.select(F.col("table").alias("tgt_table"), F.col("column").alias("tgt_column")), ["tgt_table", "tgt_column"]).select("src_table", "src_column", "tgt_table", "tgt_column")


def type_votes(df: DataFrame, table: str) -> DataFrame:
    """Per column how many different values look like int, double, date or boolean, and the type that follows."""
    v = F.col("value")
    values = unpivot(df).distinct().where(is_not_null(v))
    is_int = v.rlike(r"^[+-]?\d+$") & v.try_cast("int").isNotNull()
    is_double = v.rlike(r"^[+-]?\d+([.,]\d+)?$") & F.replace(v, F.lit(","), F.lit(".")).try_cast("double").isNotNull()
    counts = values.groupBy("column").agg(F.count("*").alias("n"), F.count_if(is_int).alias("n_int"), F.count_if(is_double).alias("n_double"), F.count_if(F.coalesce(date_format_of(v).isNotNull(), F.lit(False))).alias("n_date"), F.count_if(F.lower(v).isin("0", "1", "true", "false")).alias("n_bool"))
    kind = F.when((F.col("n_bool") == F.col("n")) & (F.col("n") <= 2), "boolean").when(F.col("n_date") == F.col("n"), "timestamp").when(F.col("n_int") == F.col("n"), "int").when(F.col("n_double") == F.col("n"), "double").otherwise("varchar")
    return counts.select(F.lit(table).alias("table"), "column", "n", "n_int", "n_double", "n_date", "n_bool", kind.alias("type"))


def drop_empty_unknown(df: DataFrame) -> DataFrame:
    """Without the columns that header repair had to name and that hold nothing. One row of flags goes to the driver."""
    unknown = [c for c in df.columns if c.startswith("Unknown_Header_")]
    if not unknown:
        return df
    filled = df.agg(*(F.max(F.coalesce(~F.col(c).isin("", "-"), F.lit(False))).alias(c) for c in unknown)).first()
    return df.drop(*(c for c in unknown if not filled[c]))
