"""JSON records to classes, properties and triples. One walk, level by level, serves both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import NULL_TOKENS
from graphloom.operators.kg import BASE
from graphloom.session import cut
from graphloom.sources.tabular import with_surrogate_key

ROOT = "Record"
#: The XSD type of a variant's kind; decimals come with their digits.
_XSD = (("BIGINT", "xsd:integer"), ("DECIMAL", "xsd:decimal"), ("DOUBLE", "xsd:decimal"), ("FLOAT", "xsd:decimal"), ("BOOLEAN", "xsd:boolean"), ("STRING", "xsd:string"))


def value_type(kind: Column) -> Column:
    """The XSD type of a primitive's kind (as schema_of_variant names it); null for a null."""
    out = F.lit(None).cast("string")
    for name, xsd in reversed(_XSD):
        out = F.when(kind.startswith(name), xsd).otherwise(out)
    return out


def is_nested(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def array_type(column: Column) -> Column:
    """Of a JSON array's text whether it holds primitive values and whether it holds others: struct(primitive, nested)."""
    parts = F.from_json(column, "array<string>")
    deep = lambda x: F.coalesce(x.rlike(r"^\s*[\[{]"), F.lit(False))
    return F.struct(F.coalesce(F.exists(parts, lambda x: ~deep(x)), F.lit(False)).alias("primitive"), F.coalesce(F.exists(parts, deep), F.lit(False)).alias("nested"))


def valid_property(domain: Column, name: Column, path: Column, root: str) -> Column:
    """Neither side is null or a null token, and the root isn't a property of itself."""
    known = lambda c: F.coalesce(~F.lower(c).isin(*NULL_TOKENS), F.lit(False))
    return known(domain) & known(name) & ~((domain == name) & (path == F.lit(f"/{root}")))


def _exploded(rows: DataFrame) -> DataFrame:
    """One row for each element of v, with i, k and e."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("i", "k", "e"))


def records(files: DataFrame, default: str = ROOT) -> DataFrame:
    """file, root, pos and v of each record. files: file, text (valid JSON).

    An array holds records of the default root; an object with a single key is that key's record, or array of records; any other object is a record of the default root.
    """
    parsed = files.select("file", F.try_parse_json("text").alias("v")).where("v is not null").withColumn("kind", F.schema_of_variant("v"))
    single = F.from_json(F.to_json("v"), "map<string,string>")
    parsed = parsed.withColumn("key", F.when(F.col("kind").startswith("OBJECT"), F.map_keys(single)))
    named = F.col("kind").startswith("OBJECT") & (F.size("key") == 1)
    inner = _exploded(parsed.where(named).select("file", "v")).select("file", F.col("k").alias("root"), F.col("e").alias("v")).withColumn("kind", F.schema_of_variant("v"))
    whole = parsed.where(~named | named.isNull()).select("file", F.lit(default).alias("root"), "v", "kind").unionByName(inner)
    lists = whole.where(F.col("kind").startswith("ARRAY"))
    each = _exploded(lists.select("file", "root", "v")).where("e is not null").select("file", "root", F.col("i").alias("pos"), F.col("e").alias("v"))
    return whole.where(~F.col("kind").startswith("ARRAY")).select("file", "root", F.lit(0).alias("pos"), "v").unionByName(each)


def walk(files: DataFrame, default: str = ROOT) -> DataFrame:
    """All nodes of all records: file, record, kind (object, value, null), path, cls (its name), parent, parent_cls, label, value and type.

    A label is the parent's with the class and a counter that runs over a record for each path, so the same name in two branches stays apart. Levels are walked until none is left; each is
    written once. Elements of an array with both primitive and nested values are texts.
    """
    found = records(files, default)
    numbered = with_surrogate_key(found, ["file", "pos"], "n")
    label = F.concat("root", (F.col("n").cast("long") - 1).cast("string"))
    roots = cut(numbered.select("file", (F.col("n").cast("long") - 1).alias("record"), F.concat(F.lit("/"), "root").alias("path"), F.col("root").alias("cls"), label.alias("label"), F.lit("").alias("ord"), "v").withColumn("kind", F.schema_of_variant("v")))
    out = [roots.select("file", "record", F.lit("object").alias("kind"), "path", "cls", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parent_cls"), "label", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("type"))]
    objects = roots.where(F.col("kind").startswith("OBJECT")).select("file", "record", "path", "cls", "label", "ord", "v")
    place = lambda c: F.concat("ord", F.lit("."), F.lpad(c.cast("string"), 10, "0"))
    while True:
        fields = _exploded(objects).where("k is not null")
        level = cut(fields.select("file", "record", F.concat_ws("/", "path", "k").alias("path"), F.col("k").alias("cls"), F.col("label").alias("parent"), F.col("cls").alias("parent_cls"), place(F.col("i")).alias("ord"), F.col("e").alias("v")).withColumn("kind", F.schema_of_variant("v")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        keep = ["file", "record", "path", "cls", "parent", "parent_cls", "ord", "v", "kind"]
        done = [level.where(~F.col("kind").startswith("ARRAY"))]
        lists = level.where(F.col("kind").startswith("ARRAY"))
        while not lists.isEmpty():
            one = _exploded(lists.drop("kind").withColumnRenamed("ord", "list")).where("i is not null").select("file", "record", "path", "cls", "parent", "parent_cls", F.col("list"), F.concat("list", F.lit("."), F.lpad(F.col("i").cast("string"), 10, "0")).alias("ord"), F.col("e").alias("v")).withColumn("kind", F.schema_of_variant("v"))
            in_list = Window.partitionBy("record", "parent", "path", "list")
            mixed = F.bool_or(is_nested(F.col("kind"))).over(in_list) & F.bool_or(~is_nested(F.col("kind"))).over(in_list)
            as_text = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
            one = one.withColumn("mixed", mixed).withColumn("v", F.when(F.col("mixed"), as_text.cast("variant")).otherwise(F.col("v"))).withColumn("kind", F.when(F.col("mixed"), F.lit("STRING")).otherwise(F.col("kind")))
            one = cut(one.select(*keep))
            done.append(one.where(~F.col("kind").startswith("ARRAY")))
            lists = one.where(F.col("kind").startswith("ARRAY"))
        nodes = reduce(DataFrame.unionByName, [x.select(*keep) for x in done])
        counted = Window.partitionBy("record", "path", F.col("kind") == "VOID").orderBy("ord")
        nodes = nodes.withColumn("label", F.concat("parent", F.lit("_"), "cls", (F.row_number().over(counted) - 1).cast("string")))
        text = F.try_variant_get("v", "$", "string")
        blank = F.col("kind").isin("VOID") | F.lower(text).isin(*NULL_TOKENS)
        what = F.when(F.col("kind").startswith("OBJECT"), "object").when(blank, "null").otherwise("value")
        kept = cut(nodes.withColumn("what", what))
        out.append(kept.select("file", "record", F.col("what").alias("kind"), "path", "cls", "parent", "parent_cls", "label", F.when(F.col("what") == "value", text).alias("value"), F.when(F.col("what") != "object", value_type(F.col("kind"))).alias("type")))
        objects = kept.where("what = 'object'").select("file", "record", "path", "cls", "label", "ord", "v")


def triples(nodes: DataFrame, base: str = BASE) -> DataFrame:
    """s, p, o, o_kind, datatype: types, edges, attribute nodes with their literals, and a record's source file."""
    iri = lambda c: F.concat(F.lit(base), c)
    t = lambda s, p, o, kind, datatype=F.lit(None): F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.cast("string").alias("datatype"))
    me, cls, top = iri(F.col("label")), iri(F.col("cls")), F.col("parent").isNull()
    edge = F.when(F.col("kind") == "object", F.concat(F.lit("p_"), "parent_cls", F.lit("_"), "cls")).otherwise(F.concat(F.lit("has_"), "cls"))
    always = F.array(t(me, F.lit("rdf:type"), cls, "iri"))
    joined = F.when(top, F.array(t(me, F.lit("SourceFile"), F.col("file"), "lit", F.lit("xsd:string")))).otherwise(F.array(t(iri(F.col("parent")), edge, me, "iri")))
    literal = F.when(F.col("kind") == "value", F.array(t(me, F.concat(F.lit("has_"), "cls", F.lit("_VALUE")), F.col("value"), "lit", F.col("type"))))
    return nodes.where("kind <> 'null'").select(F.inline(F.concat(always, joined, F.coalesce(literal, F.slice(always, 1, 0)))))


def ontology(nodes: DataFrame) -> DataFrame:
    """kind, name, domain, range, path of classes, object and data properties. A property whose values are always null has range xsd:string."""
    classes = nodes.where("kind = 'object'").select(F.lit("class").alias("kind"), F.col("cls").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("range"), "path")
    links = nodes.where("kind = 'object' and parent is not null").select(F.lit("objectProperty").alias("kind"), F.concat(F.lit("p_"), "parent_cls", F.lit("_"), "cls").alias("name"), F.col("parent_cls").alias("domain"), F.col("cls").alias("range"), "path")
    leaf = nodes.where("kind <> 'object'")
    own = leaf.select(F.lit("class").alias("kind"), F.col("cls").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("range"), "path")
    has = leaf.select(F.lit("objectProperty").alias("kind"), F.concat(F.lit("has_"), "cls").alias("name"), F.col("parent_cls").alias("domain"), F.col("cls").alias("range"), "path")
    ranges = leaf.groupBy("cls", "path").agg(F.collect_set("type").alias("t"))
    values = ranges.select(F.lit("dataProperty").alias("kind"), F.concat(F.lit("has_"), "cls", F.lit("_VALUE")).alias("name"), F.col("cls").alias("domain"), F.explode(F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit("xsd:string")))).alias("range"), "path")
    return reduce(DataFrame.unionByName, [classes, links, own, has, values]).distinct()


def table_paths(nodes: DataFrame) -> DataFrame:
    """file, path and class of the table classes that each file brought."""
    return nodes.where("kind = 'object'").select("file", "path", F.col("cls").alias("class")).distinct()


def numbered(t: DataFrame, nodes: DataFrame, base: str = BASE) -> tuple[DataFrame, DataFrame]:
    """The triples with whole numbers as names of individuals, with their former labels as alternative ones; and the map between both (label, id)."""
    ids = with_surrogate_key(nodes.where("kind <> 'null'").select("label", "record", "cls").distinct(), ["record", "label"], "id")
    known = cut(ids.select("label", "id", F.concat_ws("_", "record", "id", "cls").alias("short")))
    name = known.select(F.concat(F.lit(base), "label").alias("old"), F.concat(F.lit(base), "id").alias("new"))
    swap = lambda d, c: d.join(name, d[c] == name["old"], "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
    literal, iri = t.where("o_kind = 'lit'"), swap(t.where("o_kind = 'iri'"), "o")
    moved = swap(literal.unionByName(iri), "s")
    says = lambda p, c: F.struct(F.concat(F.lit(base), "id").alias("s"), F.lit(p).alias("p"), F.col(c).alias("o"), F.lit("lit").alias("o_kind"), F.lit("xsd:string").alias("datatype"))
    return moved.unionByName(known.select(F.inline(F.array(says("skos:altLabel", "label"), says("rdfs:label", "short"))))), known.select("label", "id")


def broader(properties: DataFrame, tops: DataFrame, known: DataFrame) -> DataFrame:
    """prop, domain, range with both ends replaced by their top classes where the domain ontology has a property between these. properties: prop, domain, range; tops: node, top; known: domain, range."""
    t = lambda c: tops.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))
    pairs = known.select(F.col("domain").alias("top_domain"), F.col("range").alias("top_range"), F.lit(True).alias("linked")).distinct()
    rows = properties.join(t("domain"), "domain", "left").join(t("range"), "range", "left").join(pairs, ["top_domain", "top_range"], "left")
    return rows.select("prop", *(F.when(F.col("linked"), F.col(f"top_{c}")).otherwise(F.col(c)).alias(c) for c in ("domain", "range")))
