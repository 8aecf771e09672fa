"""Relational sources over JDBC: tables read in parallel by ranges of a numeric column, any query, and the catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def table(spark: SparkSession, url: str, name: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table; with a numeric key it is read in ranges between its least and greatest value, one task each."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        low, high = query(spark, url, f"SELECT MIN({key}) AS LO, MAX({key}) AS HI FROM {name}", **options).first()
        if low is not None and high > low:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))
    return reader.load()


def catalog(columns: DataFrame, keys: DataFrame, references: DataFrame) -> DataFrame:
    """table, column, is_pk, fk_table, fk_column (what the ontology rules take).

    columns: table, column; keys: table, column; references: table, column, fk_table, fk_column. A column that refers to several tables has several rows.
    """
    pk = keys.select("table", "column", F.lit(1).alias("is_pk")).distinct()
    out = columns.select("table", "column").join(pk, ["table", "column"], "left").join(references.distinct(), ["table", "column"], "left")
    return out.select("table", "column", F.coalesce("is_pk", F.lit(0)).alias("is_pk"), "fk_table", "fk_column")


#: The standard information schema's three queries.
INFORMATION_SCHEMA = {
    "columns": "SELECT table_name AS \"table\", column_name AS \"column\" FROM information_schema.columns WHERE table_schema = '{schema}'",
    "keys": "SELECT k.table_name AS \"table\", k.column_name AS \"column\" FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = '{schema}'",
    "references": "SELECT a.table_name AS \"table\", a.column_name AS \"column\", b.table_name AS fk_table, b.column_name AS fk_column FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage a ON a.constraint_name = r.constraint_name JOIN information_schema.key_column_usage b ON b.constraint_name = r.unique_constraint_name AND b.ordinal_position = a.position_in_unique_constraint WHERE a.table_schema = '{schema}'",
}


def read_catalog(spark: SparkSession, url: str, schema: str, queries: Mapping[str, str] = INFORMATION_SCHEMA, **options: str) -> DataFrame:
    """The catalog of a schema; other databases give their own three queries."""
    return catalog(*(query(spark, url, queries[k].format(schema=schema), **options) for k in ("columns", "keys", "references")))
