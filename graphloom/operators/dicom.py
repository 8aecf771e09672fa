"""Decoded image tags: file, path (array of enclosing tags), code "(gggg,eeee)", name, vr, value. Dates, domains by definition, placement and item paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown Tag and Data"


def iso_da(v: Column) -> Column:
    """yyyyMMdd to yyyy-MM-dd; what is no date stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(v, F.lit("yyyyMMdd")), "yyyy-MM-dd"), v)


def iso_dt(v: Column) -> Column:
    """yyyyMMddHHmmss.SSSSSS to an ISO time; what is none stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(v, F.lit("yyyyMMddHHmmss.SSSSSS")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), v)


def clock_tm(v: Column) -> Column:
    """HHmmss... to HH:mm:ss; shorter values stay."""
    return F.when(F.length(v) >= 6, F.concat_ws(":", v.substr(1, 2), v.substr(3, 2), v.substr(5, 2))).otherwise(v)


def value_of(vr: Column, v: Column) -> Column:
    return F.when(vr == "DA", iso_da(v)).when(vr == "DT", iso_dt(v)).when(vr == "TM", clock_tm(v)).otherwise(v)


def named(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with their name out of a dictionary (code, name; the first, that is the least, name of a code counts)."""
    one = names.groupBy("code").agg(F.min("name").alias("dict_name"))
    return tags.join(one, "code", "left").withColumn("name", F.coalesce("dict_name", F.lit(UNKNOWN))).drop("dict_name")


def codes_to_names(text: Column, names: dict[str, str]) -> Column:
    """Every known code in a text replaced by its name. names is a dictionary of bounded size that the caller holds."""
    for code, name in sorted(names.items()):
        text = F.replace(text, F.lit(code), F.lit(name))
    return text


def definition(tags: DataFrame, definitions: DataFrame) -> DataFrame:
    """file, cls: the class that the file's definition tag (0008,0016) names. definitions: uid, cls."""
    uid = tags.where((F.col("code") == "(0008,0016)") & (F.size("path") == 0)).select("file", F.col("value").alias("uid"))
    return uid.join(definitions, "uid").groupBy("file").agg(F.min("cls").alias("cls"))


def with_domain(tags: DataFrame, by_code: DataFrame, by_name: DataFrame) -> DataFrame:
    """The tag's domain by its code, else by its name. by_code: code, domain; by_name: name, domain."""
    c = by_code.groupBy("code").agg(F.min("domain").alias("d1"))
    n = by_name.groupBy("name").agg(F.min("domain").alias("d2"))
    return tags.join(c, "code", "left").join(n, "name", "left").withColumn("domain", F.coalesce("d1", "d2")).drop("d1", "d2")


def placed(tags: DataFrame, root: str) -> DataFrame:
    """file, parent, code, name, value: a top tag with a domain goes to that entity, any other stays under its parent (the root at the top). The first, that is the least, value of a place counts."""
    parent = F.when((F.size("path") == 0) & F.col("domain").isNotNull(), F.col("domain")).when(F.size("path") == 0, F.lit(root)).otherwise(F.array_join("path", "/"))
    return tags.groupBy("file", parent.alias("parent"), "code").agg(F.min("name").alias("name"), F.min("value").alias("value"))


def item_edges(tags: DataFrame) -> DataFrame:
    """parent, prop, child of nested tags: each step of a path is hasItem to the tag's item class."""
    step = tags.where(F.size("path") > 0).select(F.posexplode("path").alias("k", "tag"), "path")
    parent = F.when(F.col("k") == 0, F.lit("Root")).otherwise(F.concat(F.get("path", F.col("k") - 1), F.lit("Item")))
    return step.select(parent.alias("parent"), F.lit("hasItem").alias("prop"), F.concat("tag", F.lit("Item")).alias("child")).distinct()


def first_names(names: DataFrame) -> DataFrame:
    """code and name of a dictionary: the first entry of a code counts. names: code, name, position."""
    return names.groupBy("code").agg(F.min(F.struct("position", "name")).alias("x")).select("code", "x.name")


def entities_of(tags: DataFrame, triples: DataFrame) -> DataFrame:
    """file, cls, entity: the class whose hasSOPClassUID is the file's, and its information entities: those that the operands of its equivalent intersection name (onClass), the class itself and #Unknown.

    triples: s, p, o.
    """
    part = lambda p, a, b: triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    uid = tags.where((F.col("code") == "(0008,0016)") & (F.size("path") == 0)).select("file", F.col("value").alias("uid"))
    known = uid.join(part("hasSOPClassUID", "cls", "uid"), "uid").groupBy("file").agg(F.min("cls").alias("cls"))
    own = known.select("cls").distinct()
    named = own.join(part("owl:equivalentClass", "cls", "whole"), "cls").join(part("owl:intersectionOf", "whole", "operand"), "whole").join(part("owl:onClass", "operand", "entity"), "operand").select("cls", "entity")
    every = named.unionByName(own.select("cls", F.col("cls").alias("entity"))).unionByName(own.select("cls", F.lit("#Unknown").alias("entity"))).distinct()
    return known.join(every, "cls")


def tag_entities(tags: DataFrame, entities: DataFrame, by_code: DataFrame, by_name: DataFrame) -> DataFrame:
    """file, code, entity: where a tag belongs in its file. Its domain, by its code or, if that has none, by its name, is a union of classes; the first of them that is an entity of the file's class takes it (null: none does).

    tags: file, code, name; entities: file, entity; by_code: code, domain; by_name: name, domain (a row for each class of the union).
    """
    here = tags.select("file", "code", "name").distinct()
    own = here.join(by_code.distinct(), "code")
    other = here.join(by_code.select("code").distinct(), "code", "left_anti").join(by_name.distinct(), "name")
    domains = own.select("file", "code", "domain").unionByName(other.select("file", "code", "domain"))
    met = domains.join(entities.select("file", F.col("entity").alias("domain")).distinct(), ["file", "domain"]).groupBy("file", "code").agg(F.min("domain").alias("entity"))
    return here.select("file", "code").distinct().join(met, ["file", "code"], "left")


def item_rules(columns: DataFrame, known: DataFrame, top: tuple[str, ...] = ("InformationEntity", "InformationObjectDefinition")) -> tuple[DataFrame, DataFrame]:
    """(column, path) and (table, element, match) of sequence tags: the path is hasItem and the tag's item class, made new where the ontology has none; new classes and the top classes become tables.

    columns: column, tag; known: cls.
    """
    item = F.concat(F.regexp_replace("tag", " ", ""), F.lit("Item"))
    rows = columns.withColumn("item", item).join(known.select(F.col("cls").alias("item"), F.lit(True).alias("there")).distinct(), "item", "left")
    rows = rows.withColumn("cls", F.when(F.col("there"), F.col("item")).otherwise(F.concat("column", F.lit("Item"))))
    new = rows.where("there is null").select(F.col("cls").alias("table"), F.col("cls").alias("element"), F.lit("SequenceItem").alias("match")).distinct()
    tops = columns.sparkSession.createDataFrame([(t, t, t) for t in top], "table string, element string, match string")
    return rows.select("column", F.array(F.lit("hasItem"), "cls").alias("path")), new.unionByName(tops)
