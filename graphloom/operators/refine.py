"""The extracted ontology as an extension of the domain ontology, and column paths. Ontologies are triples s, p, o."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import namespace

SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"


def imports(matches: DataFrame) -> DataFrame:
    """The modules of all matches and path members. matches: match array, path array."""
    uris = F.concat(F.coalesce("match", F.array().cast("array<string>")), F.coalesce("path", F.array().cast("array<string>")))
    return matches.select(F.explode(uris).alias("u")).select(namespace(F.col("u")).alias("module")).where("module <> ''").distinct()


def union_id(members: Column) -> Column:
    """One member stands for itself; several get the id of their union, the same in any order."""
    s = F.array_sort(F.array_distinct(members))
    return F.when(F.size(s) == 1, s[0]).when(F.size(s) > 1, F.concat(F.lit("_:"), F.sha2(F.array_join(s, "|"), 256)))


def hierarchy(matches: DataFrame) -> DataFrame:
    """s, p, o: each element below its match. matches: element, kind (class, object, data), match array."""
    p = F.when(F.col("kind") == "class", SUBCLASS).otherwise(SUBPROPERTY)
    return matches.select(F.col("element").alias("s"), p.alias("p"), union_id(F.col("match")).alias("o")).where("o is not null").distinct()


def without(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """All triples that mention an element are removed, and so are the restrictions on it. gone: element."""
    x = gone.select(F.col("element").alias("x")).distinct()
    held = triples.where(F.col("p").isin("owl:onProperty", "owl:someValuesFrom", "owl:allValuesFrom", "owl:onClass"))
    nodes = held.join(x, F.col("o") == F.col("x"), "left_semi").select(F.col("s").alias("x")).union(x).distinct()
    return reduce(lambda t, c: t.join(nodes, F.col(c) == F.col("x"), "left_anti"), ("s", "p", "o"), triples)


def superfluous(columns: DataFrame) -> DataFrame:
    """Elements no longer needed: the attribute class and the object property of a column for which only the data property is matched. columns: cls, obj, and their matches m_cls, m_obj, m_data (null: none)."""
    only_data = columns.where("m_cls is null and m_obj is null and m_data is not null")
    return only_data.select(F.explode(F.array("cls", "obj")).alias("element")).where("element is not null").distinct()


def replaced(triples: DataFrame, predicate: str, changes: DataFrame) -> DataFrame:
    """The object of a predicate replaced (domain by the path's last class, range by the domain ontology's). changes: s, old (null: any), new; one change of a subject and object."""
    c = changes.select(F.col("s").alias("cs"), "old", "new")
    hit = (F.col("p") == predicate) & (F.col("s") == F.col("cs")) & (F.col("old").isNull() | (F.col("o") == F.col("old")))
    return triples.join(c, hit, "left").select("s", "p", F.coalesce("new", "o").alias("o")).distinct()


def path_properties(paths: DataFrame) -> DataFrame:
    """s, p, o of a property from a table to the first class of each of its paths, and of its inverse. paths: table, path array."""
    first = paths.where(F.size("path") > 0).select("table", F.get("path", F.lit(0)).alias("c")).where("table <> c").distinct()
    name = lambda a, b: F.concat_ws("_", F.lit("p"), a, b)
    there, back = name(F.col("table"), F.col("c")), name(F.col("c"), F.col("table"))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    parts = [triple(there, DOMAIN, F.col("table")), triple(there, RANGE, F.col("c")), triple(back, DOMAIN, F.col("c")), triple(back, RANGE, F.col("table")), triple(there, "owl:inverseOf", back)]
    return first.select(F.inline(F.array(*parts))).distinct()


def specialised(paths: DataFrame, own: DataFrame) -> DataFrame:
    """Members of a path that have a table class below them are replaced by it (of several the least). paths: id, path array; own: cls, table_class."""
    one = own.groupBy("cls").agg(F.min("table_class").alias("t"))
    steps = paths.select("id", F.posexplode_outer("path").alias("i", "x")).join(one, F.col("x") == F.col("cls"), "left")
    back = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("i", F.coalesce("t", "x").alias("x"))))).alias("p"))
    return back.select("id", F.col("p.x").alias("path"))


def column_paths(columns: DataFrame) -> DataFrame:
    """table, column, step, element, create_new: all steps of a column's path in order; an element is made where it first occurs in its table.

    columns: table, position, column, and table_path, object_path, obj, cls, data_path, data.
    """
    empty = F.array().cast("array<string>")
    part = lambda c: F.coalesce(F.col(c), empty)
    whole = F.filter(F.concat(part("table_path"), part("object_path"), F.array("obj", "cls"), part("data_path"), F.array("data")), lambda x: x.isNotNull())
    steps = columns.select("table", "position", "column", F.posexplode(whole).alias("step", "element"))
    first = F.row_number().over(Window.partitionBy("table", "element").orderBy("position", "step")) == 1
    return steps.withColumn("create_new", first).drop("position")


def fk_paths(fks: DataFrame, found: DataFrame) -> DataFrame:
    """table, column, prop of foreign keys: those without a path of their own get the plain property. fks: table, column, ref; found: table, column, prop."""
    plain = fks.join(found, ["table", "column"], "left_anti").select("table", "column", F.concat_ws("_", F.lit("p"), "table", "ref").alias("prop"))
    return found.select("table", "column", "prop").unionByName(plain)


def moved_domains(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """The triples once properties hang on other classes: in a property's domain, or in its union, the table's class gives way to the last class of the path, and with it goes the restriction on the property.

    triples: s, p, o, a union being domain → node, node owl:unionOf each class, a restriction cls rdfs:subClassOf node, node owl:onProperty the property. changes: prop, old, new.
    """
    direct = triples.where(F.col("p") == DOMAIN).select(F.col("s").alias("prop"), F.col("o").alias("at"))
    member = triples.where("p = 'owl:unionOf'").select(F.col("s").alias("at"), F.col("o").alias("old"))
    hit = changes.join(direct, "prop")
    single = hit.where("at = old").select(F.col("prop").alias("s"), F.lit(DOMAIN).alias("p"), F.col("old").alias("o"), "new")
    inside = hit.join(member, ["at", "old"]).select(F.col("at").alias("s"), F.lit("owl:unionOf").alias("p"), F.col("old").alias("o"), "new")
    on = triples.where("p = 'owl:onProperty'").select(F.col("s").alias("o"), F.col("o").alias("prop"))
    bound = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("old"), F.col("o")).join(on, "o").join(changes, ["prop", "old"]).select(F.col("old").alias("s"), F.lit(SUBCLASS).alias("p"), "o", "new")
    swap_o = single.unionByName(inside).withColumnRenamed("new", "new_o")
    swap_s = bound.withColumnRenamed("new", "new_s")
    rows = triples.select("s", "p", "o").join(swap_o, ["s", "p", "o"], "left").join(swap_s, ["s", "p", "o"], "left")
    return rows.select(F.coalesce("new_s", "s").alias("s"), "p", F.coalesce("new_o", "o").alias("o")).distinct()


def changed_ranges(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """The triples with another range of properties, and the restrictions on them with it as their filler. changes: prop, range."""
    on = triples.where("p = 'owl:onProperty'").select(F.col("s").alias("node"), F.col("o").alias("prop")).join(changes, "prop").select("node", "range")
    direct = changes.select(F.col("prop").alias("s"), F.lit(RANGE).alias("p"), F.col("range").alias("new"))
    filler = on.select(F.col("node").alias("s"), F.lit("owl:someValuesFrom").alias("p"), F.col("range").alias("new"))
    return triples.select("s", "p", "o").join(direct.unionByName(filler).distinct(), ["s", "p"], "left").select("s", "p", F.coalesce("new", "o").alias("o")).distinct()
