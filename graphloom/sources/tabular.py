"""Delimited files: delimiter, header repair, ragged rows, surrogate key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import cut, unused


def sniff(lines: DataFrame) -> DataFrame:
    """The most frequent character that no word has; of equal ones the first to get there. lines: line (one row)."""
    chars = lines.select(F.posexplode(F.regexp_extract_all("line", F.lit("[^_a-zA-Z0-9]"), F.lit(0))).alias("at", "delimiter"))
    return chars.groupBy("delimiter").agg(F.count("*").alias("n"), F.max("at").alias("at")).orderBy(F.desc("n"), "at").limit(1).drop("at")


def repaired(headers: list[str], cells: int) -> list[str]:
    """Blank headers are numbered, repeated ones get their position, missing ones are added."""
    out: list[str] = []
    blanks = 0
    for i, h in enumerate([*headers, *[""] * (cells - len(headers))], 1):
        if not h.strip():
            blanks += 1
            h = f"Unknown_Header_{blanks}"
        while h in out:
            h = f"{h}_{i}"
        out.append(h)
    return out


def read(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file with all columns as strings; short rows are filled with empty cells. The header and the widest row's length go to the driver."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "Unknown_Header_1 string")
    if delimiter is None:
        found = sniff(lines.limit(1).select(F.col("value").alias("line"))).first()
        delimiter = found.delimiter if found else ","
    cells = F.split("value", f"\\Q{delimiter}\\E", -1)
    names = repaired(first.value.split(delimiter), lines.agg(F.max(F.size(cells))).first()[0])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = spark.read.schema(schema).csv(path, sep=delimiter, header=True, enforceSchema=True, quote="", escape="")
    return body.fillna("")


def with_surrogate_key(df: DataFrame, order: str | list[str], name: str = "PKCol") -> DataFrame:
    """"1" to "n" in the given order.

    Rows are range-partitioned and sorted, and written once with their place in their partition; a row's number is that place and the counts of the
    partitions before it. All of it is derived from the written rows, so it doesn't matter how often the plan runs; no task sees all rows.
    """
    place, part, before = unused(df, "__place", "__part", "__before")
    keys = [order] if isinstance(order, str) else order
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(place, 33))  # the upper bits are the partition's number, the lower ones the place in it
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    sums = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    number = F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(sums), part).withColumn(name, number.cast("string")).drop(place, part, before)
