"""JSON trees as (path, type) sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

_TYPES = {"BIGINT": "xsd:integer", "DOUBLE": "xsd:decimal", "STRING": "xsd:string", "BOOLEAN": "xsd:boolean"}


def paths(rows: DataFrame, column: str, root: str) -> DataFrame:
    """Different paths of leaves and their types over all rows, at any depth; a path that is always null is a string."""
    level = rows.select(F.lit(f"/{root}").alias("path"), F.try_parse_json(column).alias("v"))
    found = []
    while True:
        level = level.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.concat("path", F.when(F.col("key").isNotNull(), F.concat(F.lit("/"), F.col("key"))).otherwise("")).alias("path"), F.col("value").alias("v"))
        level = cut(level.withColumn("kind", F.schema_of_variant("v")))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        found.append(level.where(~nested).select("path", "kind").distinct())
        level = level.where(nested).select("path", "v")
        if level.isEmpty():
            break
    kind = F.when(F.col("kind").startswith("DECIMAL"), "xsd:decimal")
    for k, v in _TYPES.items():
        kind = kind.when(F.col("kind") == k, v)
    leaves = reduce(DataFrame.unionByName, found).select("path", kind.alias("type"))
    known = leaves.where("type is not null").distinct()
    return known.unionByName(leaves.where("type is null").select("path").distinct().join(known, "path", "left_anti").withColumn("type", F.lit("xsd:string")))
