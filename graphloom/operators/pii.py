"""Personal data: what of a dataset's tables and columns a taxonomy of personal data knows, and the document that reports it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes whose descendants set a flag.
PERSONAL, IDENTIFYING, SPECIAL = "PersonalData", "Identifying", "SpecialCategoryPersonalData"


def cross_map(spark_rows: DataFrame, column: str = "text") -> DataFrame:
    """match, dpv of a JSON text {dpv: [match, ...]}: the map turned round, one row for each pair."""
    pairs = spark_rows.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("dpv", "matches"))
    return pairs.select(F.explode("matches").alias("match"), "dpv").distinct()


def inverted(pairs: DataFrame) -> DataFrame:
    """match and its sorted list of dpv classes."""
    return pairs.groupBy("match").agg(F.array_sort(F.collect_set("dpv")).alias("dpv"))


def cross_matches(mappings: DataFrame, closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """table, column, element, dpv: an element's matches, those of the first run included, lead over all their ancestors to the taxonomy. closed: reflexive."""
    own = mappings.select("table", "column", "element", F.explode(F.array_distinct(F.concat(F.coalesce("match", F.array().cast("array<string>")), F.coalesce("initial_match", F.array().cast("array<string>"))))).alias("node"))
    up = own.join(closed.select("node", "ancestor"), "node", "left").withColumn("match", F.coalesce("ancestor", "node"))
    return up.join(pairs, "match").select("table", "column", "element", "dpv").distinct()


def appended(mappings: DataFrame, found: DataFrame) -> DataFrame:
    """The mappings with the taxonomy matches that a second run selected for their elements, added to those they had. found: element, dpv."""
    new = found.groupBy("element").agg(F.collect_set("dpv").alias("__new"))
    none = F.array().cast("array<string>")
    return mappings.join(new, "element", "left").withColumn("dpv", F.array_sort(F.array_union(F.coalesce("dpv", none), F.coalesce("__new", none)))).drop("__new")


def detected(mappings: DataFrame, closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """table, column, element, dpv: direct matches with the taxonomy and those by the cross map."""
    direct = mappings.select("table", "column", "element", F.explode("dpv").alias("dpv"))
    return direct.unionByName(cross_matches(mappings, closed, pairs)).distinct()


def fields(found: DataFrame) -> DataFrame:
    """table, column and the sorted elements found there."""
    return found.groupBy("table", "column").agg(F.array_sort(F.collect_set("element")).alias("elements"))


def column_name(path: Column, names: Column | None = None) -> Column:
    """The last step of a JSON path; a tag's code gets its name behind a bar."""
    last = F.substring_index(path, "/", -1)
    return last if names is None else F.when(names.isNotNull(), F.concat_ws("|", last, names)).otherwise(last)


def document(found: DataFrame, taxonomy: DataFrame, texts: DataFrame, sources: DataFrame) -> DataFrame:
    """dataset_element, sources, three flags and dpv_matches, one row for each element, in its order.

    A match has label, description and its ancestors by depth, each with label and description; flags count the match itself as well. found: table, column, dpv; taxonomy: its reflexive
    closure; texts: entity, label, description; sources: table, filename, metadata_id.
    """
    said = texts.select(F.col("entity").alias("ancestor"), F.col("label").alias("a_label"), F.col("description").alias("a_description"))
    wanted = taxonomy.join(found.select(F.col("dpv").alias("node")).distinct(), "node", "left_semi")
    up = F.struct("depth", F.col("ancestor").alias("uri"), F.col("a_label").alias("label"), F.col("a_description").alias("description"))
    flag = lambda x: F.coalesce(F.bool_or(F.col("ancestor") == x), F.lit(False))
    above = wanted.join(said, "ancestor", "left").groupBy("node").agg(F.array_sort(F.collect_set(F.when(F.col("depth") > 0, up))).alias("is_subclass_of"), flag(PERSONAL).alias("p"), flag(IDENTIFYING).alias("i"), flag(SPECIAL).alias("s"))
    rows = found.select("table", "column", "dpv").distinct().join(above.withColumnRenamed("node", "dpv"), "dpv", "left").join(texts.withColumnRenamed("entity", "dpv"), "dpv", "left")
    match = F.struct(F.col("dpv").alias("match"), "label", "description", "is_subclass_of")
    from_ = sources.groupBy("table").agg(F.collect_set(F.struct("filename", "metadata_id")).alias("__sources"))
    out = rows.join(from_, "table", "left").groupBy(F.col("column").alias("dataset_element")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__sources")))).alias("sources"),
        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for c, n in (("p", "is_personal_data"), ("i", "is_identifying"), ("s", "is_special_category_personal_data"))),
        F.array_sort(F.collect_set(match)).alias("dpv_matches"),
    )
    return out.orderBy("dataset_element")


def messages(documents: DataFrame, domain: str, previous_id: str | None, metadata_id: str) -> DataFrame:
    """One JSON text for each element of the document, nulls written out, with the dataset's ids."""
    head = [F.lit(domain).alias("domain"), F.lit(previous_id).cast("string").alias("prev_metadata_id"), F.lit(metadata_id).alias("current_metadata_id")]
    return documents.select("dataset_element", F.to_json(F.struct(*head, F.struct(*documents.columns).alias("attribute")), {"ignoreNullFields": "false"}).alias("value"))
