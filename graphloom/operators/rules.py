"""Rules from a relational catalog to classes and properties. catalog: table, column, is_pk (0/1), fk_table, fk_column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import connected

PK, FK = "is_pk = 1", "fk_table is not null"


def table_stats(catalog: DataFrame) -> DataFrame:
    """Per table the size of its key, of the foreign part of it, and whether key and foreign keys are equal sets, the key lies within the foreign keys, and there is a plain attribute."""
    counts = catalog.groupBy("table").agg(F.count("*").alias("n"), F.expr(f"count_if({PK}) as n_pk"), F.expr(f"count_if({PK} and {FK}) as n_both"), F.expr(f"count_if({FK}) as n_fk"), F.expr("count_if(is_pk = 0 and fk_table is null) as n_simple"))
    n = F.col
    return counts.select("table", "n", "n_pk", "n_both", ((n("n_pk") == n("n_both")) & (n("n_fk") == n("n_both")) & (n("n_fk") > 0)).alias("equal"), (n("n_pk") == n("n_both")).alias("within"), (n("n_simple") > 0).alias("simple"))


def stem_of(names: Column) -> Column:
    """The longest stretch of the first name that all names hold, of equal ones the foremost; all names joined if there is none."""
    first = F.get(names, 0)
    cut_at = lambda i: F.transform(F.sequence(F.lit(1), F.length(first) - i + 1), lambda k: F.struct((-k).alias("n"), i.alias("i"), F.substr(first, i, k).alias("s")))
    stems = F.flatten(F.transform(F.sequence(F.lit(1), F.length(first)), cut_at))
    held = F.filter(stems, lambda x: F.forall(names, lambda n: F.contains(n, x["s"])))
    return F.when(F.length(first) > 0, F.coalesce(F.array_min(held)["s"], F.array_join(names, "_"))).otherwise(F.array_join(names, "_"))


def classes(catalog: DataFrame) -> DataFrame:
    """table, class and rule of the tables that stand for a class.

    Rule 1: a table whose key is its foreign keys merges with the tables they point to; a whole merged group is one class, named by what its names share.
    Rule 2: of the others those with one key column, a partly foreign key, or attributes beside a key of foreign keys.
    """
    stats = table_stats(catalog)
    merged = catalog.where(FK).join(stats.where("equal"), "table").select(F.col("table").alias("a"), F.col("fk_table").alias("b"))
    groups = connected(merged)
    names = groups.groupBy("comp").agg(F.array_sort(F.collect_set("node")).alias("names")).select("comp", stem_of(F.col("names")).alias("class"))
    one = groups.join(names, "comp").select(F.col("node").alias("table"), "class", F.lit(1).alias("rule"))
    own = stats.where("n_pk = 1 or n_both >= 1 or (simple and within)").join(one, "table", "left_anti")
    return one.unionByName(own.select("table", F.col("table").alias("class"), F.lit(2).alias("rule")))


def object_property_rules(catalog: DataFrame) -> DataFrame:
    """rule, src, tgt: one row for each object property between classes that a rule gives."""
    known = classes(catalog).select("table", "class")
    keys = catalog.where(PK).select(F.col("table").alias("fk_table"), F.col("column").alias("fk_column"), F.lit(True).alias("to_key"))
    stats = table_stats(catalog)
    fks = catalog.where(FK).join(stats, "table").join(known.select("table", F.col("class").alias("here")), "table", "left")
    fks = fks.join(known.select(F.col("table").alias("fk_table"), F.col("class").alias("there")), "fk_table", "left").join(keys, ["fk_table", "fk_column"], "left").withColumn("to_key", F.coalesce("to_key", F.lit(False)))
    both = fks.where("here is not null and there is not null and here <> there")
    rows = lambda df, rule, src, tgt: df.select(F.lit(rule).alias("rule"), F.col(src).alias("src"), F.col(tgt).alias("tgt"))
    plain = both.where("is_pk = 0 and to_key")
    link = fks.where("within and there is not null")
    shared = fks.where("is_pk = 0 and here is not null").select("table", "here", "fk_table", "fk_column")
    round_ = fks.where(PK).where("within and n_pk % 2 = 0").groupBy("table").agg(F.collect_set(F.coalesce("there", F.lit(""))).alias("c")).where("size(c) = 1").select(F.get("c", 0).alias("there")).where("there <> ''")
    found = [
        rows(plain, "r1", "here", "there"),
        rows(plain, "r1inv", "there", "here"),
        rows(both.where(PK).where("n_pk > 1 and n > n_pk"), "r2", "here", "there"),
        rows(link.select("table", "there").join(link.select("table", F.col("there").alias("other")), "table").where("there <> other"), "r3", "there", "other"),
        rows(both.where("within"), "r4", "there", "here"),
        rows(round_, "r6", "there", "there"),
        rows(fks.where("here is not null and fk_table = table and to_key"), "r7", "here", "here"),
        rows(shared.join(shared.select(F.col("here").alias("other"), "fk_table", "fk_column"), ["fk_table", "fk_column"]).where("here <> other"), "r8", "here", "other"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def data_property_rules(catalog: DataFrame, attributes_to_classes: bool = True) -> DataFrame:
    """domain, prop, range of the columns that are no keys; a column named like a table gets a suffix."""
    tables = catalog.select(F.col("table").alias("t")).distinct()
    cols = catalog.where((F.col("is_pk") == 0) & F.col("fk_table").isNull()).join(tables, F.col("column") == F.col("t"), "left")
    cols = cols.select(F.col("table").alias("domain"), F.when(F.col("t").isNotNull(), F.concat("column", F.lit("_ATTR"))).otherwise(F.col("column")).alias("a"))
    has = F.concat(F.lit("has_"), "a")
    if not attributes_to_classes:
        return cols.select("domain", has.alias("prop"), F.lit("xsd:string").alias("range"))
    values = cols.select(F.col("a").alias("domain"), F.concat(has, F.lit("_VALUE")).alias("prop"), F.lit("xsd:string").alias("range"))
    return cols.select("domain", has.alias("prop"), F.col("a").alias("range")).unionByName(values)


def merged_properties(properties: DataFrame) -> DataFrame:
    """One row for each property: the sets of its domains, ranges, rules and fields. properties: prop, domain, range, rule, field."""
    whole = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return properties.groupBy("prop").agg(whole("domain"), whole("range"), whole("rule"), whole("field"))
