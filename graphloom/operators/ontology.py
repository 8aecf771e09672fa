"""Ontologies as triples (s, p, o, o_kind, datatype, lang): what is read from them, and what is written for an extracted one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import local_name, normalise_label, remove_punctuation

#: Kinds of entities by their rdf:type.
KINDS = {"owl:Class": "class", "owl:ObjectProperty": "objectProperty", "owl:DatatypeProperty": "dataProperty", "owl:AnnotationProperty": "annotationProperty"}
#: Entities that stand for everything or nothing.
BOUNDS = ("owl:Thing", "owl:Nothing", "owl:topObjectProperty", "owl:bottomObjectProperty", "owl:topDataProperty", "owl:bottomDataProperty")
#: The elements that every extracted ontology starts from; they are no candidates for a match.
BASE_ELEMENTS = ("TableClass", "AttributeClass", "PureProperty", "AttributeProperty", "hasValueProperty")
SUB = {"class": "rdfs:subClassOf", "objectProperty": "rdfs:subPropertyOf", "dataProperty": "rdfs:subPropertyOf"}


def _both(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def entities(t: DataFrame) -> DataFrame:
    """entity and kind, without deprecated ones and those that stand for everything or nothing."""
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    named = t.where("p = 'rdf:type'").select(F.col("s").alias("entity"), F.get(F.array(kinds), 0)[F.col("o")].alias("kind")).where("kind is not null").distinct()
    old = t.where("p = 'owl:deprecated' and lower(o) = 'true'").select(F.col("s").alias("entity"))
    return named.where(~F.col("entity").isin(*BOUNDS) & ~F.col("entity").startswith("_:")).join(old, "entity", "left_anti")


def entity_counts(t: DataFrame) -> DataFrame:
    """kind and n."""
    return entities(t).groupBy("kind").agg(F.count("*").alias("n"))


def without_base(elements: DataFrame, column: str = "entity") -> DataFrame:
    """Without the base elements of extracted ontologies."""
    return elements.where(~F.coalesce(local_name(F.col(column)), F.col(column)).isin(*BASE_ELEMENTS))


def used_annotations(t: DataFrame, asked: tuple[str, ...] = ()) -> DataFrame:
    """p: rdfs:label, the ones asked for and the declared annotation properties, as far as any triple uses them."""
    declared = t.where("p = 'rdf:type' and o = 'owl:AnnotationProperty'").select(F.col("s").alias("p"))
    known = declared.unionByName(t.sparkSession.createDataFrame([(x,) for x in ("rdfs:label", *asked)], "p string")).distinct()
    return known.join(t.select("p").distinct(), "p", "left_semi")


def of_language(t: DataFrame, tag: str = "en") -> DataFrame:
    """Literals of a language; those without a tag count as English."""
    return t.where((F.col("o_kind") == "lit") & (F.lower(F.coalesce("lang", F.lit("en"))) == tag))


def labels(t: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """entity, property, label: different literals of the label properties that are used, in lower case, underscores as blanks."""
    known = used_annotations(t) if properties is None else properties
    told = t.where("o_kind = 'lit'").join(known, "p", "left_semi")
    return told.select(F.col("s").alias("entity"), F.col("p").alias("property"), F.lower(F.replace("o", F.lit("_"), F.lit(" "))).alias("label")).where("label <> ''").distinct()


def annotations(elements: DataFrame, t: DataFrame) -> DataFrame:
    """entity and texts: the sorted literals of each element without punctuation, its local name where it has none. elements: entity."""
    told = t.where("o_kind = 'lit'").join(used_annotations(t), "p", "left_semi").select(F.col("s").alias("entity"), remove_punctuation(F.col("o")).alias("text"))
    sets = told.groupBy("entity").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return elements.select("entity").distinct().join(sets, "entity", "left").withColumn("texts", F.coalesce("texts", F.array(F.coalesce(local_name(F.col("entity")), F.col("entity")))))


def display_labels(elements: DataFrame, t: DataFrame) -> DataFrame:
    """entity and label: the English one, else one without a language, else the local name; of several the least."""
    told = t.where("p = 'rdfs:label' and o_kind = 'lit'").groupBy(F.col("s").alias("entity")).agg(F.min(F.when(F.col("lang") == "en", F.col("o"))).alias("en"), F.min(F.when(F.col("lang").isNull(), F.col("o"))).alias("plain"))
    return elements.select("entity").distinct().join(told, "entity", "left").select("entity", F.coalesce("en", "plain", local_name(F.col("entity")), "entity").alias("label"))


def disjoint(pairs: DataFrame, t: DataFrame) -> DataFrame:
    """x, y, disjoint: whether the ontology says that the two differ, in either direction."""
    said = t.where("p in ('owl:disjointWith', 'owl:differentFrom')").select(F.col("s").alias("x"), F.col("o").alias("y"))
    both = said.unionByName(said.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    return pairs.join(both.withColumn("disjoint", F.lit(True)), ["x", "y"], "left").withColumn("disjoint", F.coalesce("disjoint", F.lit(False)))


def asserted(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, parents, children: the asserted ones of each start, sorted. edges: child, parent; starts: node."""
    up = edges.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    down = edges.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    none = F.array().cast("array<string>")
    return starts.select("node").distinct().join(up, "node", "left").join(down, "node", "left").select("node", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def inferred(closed: DataFrame, starts: DataFrame, direct: bool = False) -> DataFrame:
    """node, other, side (super, sub): all named ancestors and descendants of the starts, or direct ones only, without those that stand for everything or nothing."""
    near = closed.where("depth = 1" if direct else "depth > 0").where(~F.col("ancestor").isin(*BOUNDS) & ~F.col("node").isin(*BOUNDS))
    up = near.join(starts.select("node").distinct(), "node", "left_semi").select("node", F.col("ancestor").alias("other"), F.lit("super").alias("side"))
    down = near.join(starts.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("ancestor").alias("node"), F.col("node").alias("other"), F.lit("sub").alias("side"))
    return up.unionByName(down)


def entailed(pairs: DataFrame, closed: DataFrame, instances: DataFrame) -> DataFrame:
    """x, y, subsumed (x below y), instance_of (x an instance of y or of a class below it). closed: reflexive; instances: instance, node."""
    sub = closed.select(F.col("node").alias("x"), F.col("ancestor").alias("y")).distinct().withColumn("subsumed", F.lit(True))
    held = instances.join(closed, "node").select(F.col("instance").alias("x"), F.col("ancestor").alias("y")).distinct().withColumn("instance_of", F.lit(True))
    no = F.lit(False)
    return pairs.join(sub, ["x", "y"], "left").join(held, ["x", "y"], "left").select("x", "y", F.coalesce("subsumed", no).alias("subsumed"), F.coalesce("instance_of", no).alias("instance_of"))


def common_descendants(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """x, y, node: what lies below both, each pair of classes joined through its own descendants. closed: reflexive."""
    below = closed.select(F.col("ancestor").alias("x"), "node")
    return pairs.distinct().join(below, "x").join(below.withColumnRenamed("x", "y"), ["y", "node"], "left_semi").select("x", "y", "node")


def restrictions(t: DataFrame) -> DataFrame:
    """cls, how (subClassOf, equivalentClass), prop, filler: existential restrictions of named classes."""
    part = lambda p, c: t.where(F.col("p") == p).select(F.col("s").alias("r"), F.col("o").alias(c))
    whole = part("owl:onProperty", "prop").join(part("owl:someValuesFrom", "filler"), "r")
    said = t.where("p in ('rdfs:subClassOf', 'owl:equivalentClass')").select(F.col("s").alias("cls"), F.regexp_replace("p", "^[a-z]+:", "").alias("how"), F.col("o").alias("r"))
    return said.where("cls not like '\\\\_:%'").join(whole, "r").select("cls", "how", "prop", "filler").distinct()


def subsumptions(t: DataFrame) -> DataFrame:
    """sub, sup: named classes below named ones or below a basic existential restriction, as "prop some filler"."""
    named = t.where("p = 'rdfs:subClassOf' and s not like '\\\\_:%' and o not like '\\\\_:%'").select(F.col("s").alias("sub"), F.col("o").alias("sup"))
    some = restrictions(t).where("how = 'subClassOf' and filler not like '\\\\_:%'").select(F.col("cls").alias("sub"), F.concat_ws(" ", "prop", F.lit("some"), "filler").alias("sup"))
    return named.unionByName(some).where(~F.col("sup").isin(*BOUNDS)).distinct()


def replaced(t: DataFrame, changes: DataFrame) -> DataFrame:
    """The triples with entities replaced, as subject, predicate or object. changes: old, new."""
    for c in ("s", "p", "o"):
        names = changes.select(F.col("old").alias(c), F.col("new").alias("__new"))
        t = t.join(names, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return t


def select(t: DataFrame, patterns: list[tuple[str, str, str]], closed: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table of a basic graph pattern: a column for each ?variable. A predicate with + at its end is any number of its steps, from the closure given for it (node, ancestor)."""
    out = None
    for s, p, o in patterns:
        if p.endswith("+"):
            rows = (closed or {})[p[:-1]].where("depth > 0").select(F.col("node").alias("s"), F.lit(p).alias("p"), F.col("ancestor").alias("o"))
        else:
            rows = t.select("s", "p", "o")
        names: dict[str, Column] = {}
        for c, x in (("s", s), ("p", p), ("o", o)):
            if not x.startswith("?"):
                rows = rows.where(F.col(c) == x)
            elif x[1:] in names:
                rows = rows.where(F.col(c) == names[x[1:]])
            else:
                names[x[1:]] = F.col(c)
        rows = rows.select(*(c.alias(n) for n, c in names.items())).distinct()
        if out is None:
            out = rows
        else:
            shared = [c for c in rows.columns if c in out.columns]
            if rows.columns and not shared:
                raise ValueError("each pattern must share a variable with those before it")
            out = out.join(rows, shared) if shared else out.where(F.lit(not rows.isEmpty()))
    return out


def without_individuals(t: DataFrame) -> DataFrame:
    """Without all triples whose subject or object is a named individual."""
    who = t.where("p = 'rdf:type' and o = 'owl:NamedIndividual'").select(F.col("s").alias("__i")).distinct()
    return t.join(who, t["s"] == who["__i"], "left_anti").join(who, t["o"] == who["__i"], "left_anti")


def individuals(t: DataFrame, who: DataFrame) -> DataFrame:
    """All statements of the given individuals. who: s."""
    return t.join(who.select("s").distinct(), "s", "left_semi")


# --- extracted ontologies --------------------------------------------------------------------------


def axioms(properties: DataFrame, inverses: DataFrame) -> DataFrame:
    """s, p, o of every property: its kind, its domain (a union if there are several), its range, "domain below some range", its inverse and super-property.

    properties: prop, kind, domains, ranges (arrays), parent; inverses: prop, inverse.
    """
    union = lambda xs: F.when(F.size(xs) == 1, F.get(xs, 0)).otherwise(F.concat(F.lit("_:"), F.sha2(F.array_join(F.array_sort(xs), "|"), 256)))
    rows = properties.join(inverses, "prop", "left")
    domain, first = union(F.col("domains")), F.array_min("ranges")
    bound = lambda x: F.concat(F.lit("_:some"), F.sha2(F.concat_ws("|", "prop", first, x), 256))
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    kind = F.when(F.col("kind") == "dataProperty", "owl:DatatypeProperty").otherwise("owl:ObjectProperty")
    own = F.array(t(F.col("prop"), "rdf:type", kind), t(F.col("prop"), "rdfs:domain", domain), t(F.col("prop"), "rdfs:range", first), t(F.col("prop"), "owl:inverseOf", F.col("inverse")), t(F.col("prop"), "rdfs:subPropertyOf", F.col("parent")))
    each = F.flatten(F.transform("domains", lambda x: F.array(t(x, "rdfs:subClassOf", bound(x)), t(bound(x), "rdf:type", F.lit("owl:Restriction")), t(bound(x), "owl:onProperty", F.col("prop")), t(bound(x), "owl:someValuesFrom", first))))
    parts = F.when(F.size("domains") > 1, F.transform("domains", lambda x: t(domain, "owl:unionOf", x))).otherwise(F.slice(own, 1, 0))
    return rows.select(F.inline(F.concat(own, each, parts))).where("o is not null").distinct()


def annotated(elements: DataFrame, expansions: DataFrame) -> DataFrame:
    """s, p, o: the normalised name as rdfs:label, the tokenised header as skos:prefLabel, its expansions as skos:altLabel (with "has" before those of a property), the comment.

    elements: entity, kind, name, header, comment; expansions: header, tokens, expansion.
    """
    t = lambda p, o: F.struct(F.col("entity").alias("s"), F.lit(p).alias("p"), o.alias("o"))
    own = elements.select(F.inline(F.array(t("rdfs:label", normalise_label(F.col("name"))), t("rdfs:comment", F.col("comment"))))).where("o is not null")
    known = elements.join(expansions, "header")
    has = F.when(F.col("kind") == "class", F.col("expansion")).otherwise(F.concat(F.lit("has "), "expansion"))
    more = known.select(F.inline(F.array(t("skos:prefLabel", F.col("tokens")), t("skos:altLabel", has)))).where("o is not null")
    return own.unionByName(more).distinct()


def mapping_skeleton(fields: DataFrame, sources: DataFrame, before: DataFrame) -> DataFrame:
    """table, column, mappings (type and element, classes first), sources and is_pii; sources and flags of the run before are kept.

    fields: table, column, type, element; sources: table, source; before: table, column, sources, is_pii.
    """
    order = F.when(F.col("type") == "objectProperty", 0).when(F.col("type") == "class", 1).otherwise(2)
    maps = fields.groupBy("table", "column").agg(F.array_sort(F.collect_set(F.struct(order.alias("n"), "type", "element"))).alias("m"))
    maps = maps.select("table", "column", F.transform("m", lambda x: F.struct(x["type"].alias("type"), x["element"].alias("element"))).alias("mappings"))
    now = sources.groupBy("table").agg(F.collect_set("source").alias("now"))
    none = F.array().cast("array<string>")
    rows = maps.join(now, "table", "left").join(before.select("table", "column", F.col("sources").alias("old"), "is_pii"), ["table", "column"], "left")
    return rows.select("table", "column", "mappings", F.array_sort(F.array_union(F.coalesce("old", none), F.coalesce("now", none))).alias("sources"), F.coalesce("is_pii", F.lit(False)).alias("is_pii"))


def enriched_labels(elements: DataFrame, t: DataFrame, named: DataFrame) -> DataFrame:
    """entity, label: "<table's label> <element's label>" for each table class that restricts the element by any part of a restriction. elements: entity; named: entity, label."""
    r = restrictions(t)
    of = lambda c: r.select(F.col("cls").alias("table"), F.col(c).alias("entity"))
    met = of("prop").unionByName(of("filler")).distinct().join(elements.select("entity"), "entity", "left_semi")
    return met.join(named.select(F.col("entity").alias("table"), F.col("label").alias("above")), "table").join(named, "entity").select("entity", F.concat_ws(" ", "above", "label").alias("label")).distinct()
