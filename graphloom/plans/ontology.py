"""Queries of ontologies. The ontology is made of nations and regions, customers' segments and parts: classes, properties, restrictions, labels in languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H, ontology as O
from graphloom.registry import query, table, union

_T = "s string, p string, o string, o_kind string, lang string"
#: Triples: every nation is a class below its region; nations with an odd key are restricted by "in some region"; every third is deprecated.
_ONTO = """n AS (SELECT n_nationkey AS k, 'ex/n' || n_nationkey AS n, 'ex/r' || n_regionkey AS r, n_name, n_regionkey FROM nation),
t AS (SELECT n AS s, 'rdf:type' AS p, 'owl:Class' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS lang FROM n UNION ALL SELECT DISTINCT r, 'rdf:type', 'owl:Class', 'iri', NULL FROM n
UNION ALL SELECT 'ex/in', 'rdf:type', 'owl:ObjectProperty', 'iri', NULL UNION ALL SELECT 'ex/note', 'rdf:type', 'owl:AnnotationProperty', 'iri', NULL UNION ALL SELECT 'ex/unused', 'rdf:type', 'owl:AnnotationProperty', 'iri', NULL
UNION ALL SELECT 'owl:Thing', 'rdf:type', 'owl:Class', 'iri', NULL
UNION ALL SELECT n, 'rdfs:subClassOf', r, 'iri', NULL FROM n UNION ALL SELECT n, 'owl:deprecated', 'true', 'lit', NULL FROM n WHERE k % 3 = 0
UNION ALL SELECT n, 'rdfs:label', n_name, 'lit', CASE k % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END FROM n UNION ALL SELECT n, 'ex/note', 'Note, ' || n_name, 'lit', NULL FROM n WHERE k % 5 = 0
UNION ALL SELECT n, 'owl:disjointWith', 'ex/n' || ((k + 1) % 25), 'iri', NULL FROM n
UNION ALL SELECT n, 'rdfs:subClassOf', '_:' || k, 'iri', NULL FROM n WHERE k % 2 = 1 UNION ALL SELECT '_:' || k, 'owl:onProperty', 'ex/in', 'iri', NULL FROM n WHERE k % 2 = 1 UNION ALL SELECT '_:' || k, 'owl:someValuesFrom', r, 'iri', NULL FROM n WHERE k % 2 = 1
UNION ALL SELECT 'ex/i' || k, 'rdf:type', 'owl:NamedIndividual', 'iri', NULL FROM n UNION ALL SELECT 'ex/i' || k, 'rdf:type', n, 'iri', NULL FROM n UNION ALL SELECT 'ex/note', 'rdfs:seeAlso', 'ex/i1', 'iri', NULL)"""


def _onto(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("ex/n"), F.col("n_nationkey").cast("string")).alias("n"), F.concat(F.lit("ex/r"), F.col("n_regionkey").cast("string")).alias("r"), "n_name")
    k, blank = F.col("k"), F.concat(F.lit("_:"), F.col("k").cast("string"))
    iri = lambda rows, x, p, o: rows.select(x.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("lang"))
    lit = lambda rows, p, o, lang=F.lit(None): rows.select(F.col("n").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("lit").alias("o_kind"), lang.cast("string").alias("lang"))
    odd, one = n.where("k % 2 = 1"), F.concat(F.lit("ex/i"), k.cast("string"))
    fixed = [("ex/in", "rdf:type", "owl:ObjectProperty", "iri", None), ("ex/note", "rdf:type", "owl:AnnotationProperty", "iri", None), ("ex/unused", "rdf:type", "owl:AnnotationProperty", "iri", None), ("owl:Thing", "rdf:type", "owl:Class", "iri", None), ("ex/note", "rdfs:seeAlso", "ex/i1", "iri", None)]
    return union([
        iri(n, F.col("n"), "rdf:type", F.lit("owl:Class")), iri(n.select("r").distinct(), F.col("r"), "rdf:type", F.lit("owl:Class")), s.createDataFrame(fixed, _T),
        iri(n, F.col("n"), "rdfs:subClassOf", F.col("r")), lit(n.where("k % 3 = 0"), "owl:deprecated", F.lit("true")),
        lit(n, "rdfs:label", F.col("n_name"), F.when(k % 3 == 0, "en").when(k % 3 == 1, "fr")), lit(n.where("k % 5 = 0"), "ex/note", F.concat(F.lit("Note, "), "n_name")),
        iri(n, F.col("n"), "owl:disjointWith", F.concat(F.lit("ex/n"), ((k + 1) % 25).cast("string"))),
        iri(odd, F.col("n"), "rdfs:subClassOf", blank), iri(odd, blank, "owl:onProperty", F.lit("ex/in")), iri(odd, blank, "owl:someValuesFrom", F.col("r")),
        iri(n, one, "rdf:type", F.lit("owl:NamedIndividual")), iri(n, one, "rdf:type", F.col("n")),
    ])


def _edges(t):
    return t.where("p = 'rdfs:subClassOf' and o like 'ex%'").select(F.col("s").alias("child"), F.col("o").alias("parent"))


_ENTITIES = """e AS (SELECT DISTINCT s AS entity, CASE o WHEN 'owl:Class' THEN 'class' WHEN 'owl:ObjectProperty' THEN 'objectProperty' ELSE 'annotationProperty' END AS kind FROM t
WHERE p = 'rdf:type' AND o IN ('owl:Class', 'owl:ObjectProperty', 'owl:AnnotationProperty') AND s <> 'owl:Thing' AND s NOT IN (SELECT s FROM t WHERE p = 'owl:deprecated'))"""


@query("ontology_entities", f"WITH {_ONTO}, {_ENTITIES} SELECT entity, kind FROM e")
def _(s, d):
    return O.entities(_onto(s, d))


@query("ontology_entity_counts", f"WITH {_ONTO}, {_ENTITIES} SELECT kind, count(*) AS n FROM e GROUP BY 1")
def _(s, d):
    return O.entity_counts(_onto(s, d))


@query("base_element_exclusion", f"WITH {_ONTO}, {_ENTITIES} SELECT entity, kind FROM e")
def _(s, d):
    more = s.createDataFrame([(f"ex/{x}", "class") for x in O.BASE_ELEMENTS], "entity string, kind string")
    return O.without_base(O.entities(_onto(s, d)).unionByName(more))


@query(
    "used_annotations",
    f"""WITH {_ONTO} SELECT DISTINCT p FROM t WHERE p = 'rdfs:label' OR p = 'rdfs:seeAlso' OR p IN (SELECT s
FROM t WHERE o = 'owl:AnnotationProperty')""",
)
def _(s, d):
    return O.used_annotations(_onto(s, d), ("rdfs:seeAlso", "skos:altLabel"))


@query("language_filter", f"WITH {_ONTO} SELECT s, p, o FROM t WHERE o_kind = 'lit' AND coalesce(lang, 'en') = 'en'")
def _(s, d):
    return O.of_language(_onto(s, d)).select("s", "p", "o")


@query("ontology_labels", f"WITH {_ONTO} SELECT DISTINCT s AS entity, p AS property, lower(replace(o, '_', ' ')) AS label FROM t WHERE p IN ('rdfs:label', 'ex/note')")
def _(s, d):
    return O.labels(_onto(s, d))


@query(
    "resource_annotations",
    f"""WITH {_ONTO}, a AS (SELECT s, string_agg(DISTINCT replace(replace(o, ',', ' '), '_', ' '), '|' ORDER BY replace(replace(o, ',', ' '), '_', ' ')) AS x FROM t WHERE p IN ('rdfs:label', 'ex/note') GROUP BY 1)
SELECT DISTINCT t.s AS entity, coalesce(x, regexp_extract(t.s, '[/#]([^/#]+)$', 1)) AS texts FROM t LEFT JOIN a ON a.s = t.s WHERE t.o = 'owl:Class' AND t.s <> 'owl:Thing'""",
)
def _(s, d):
    t = _onto(s, d)
    return O.annotations(t.where("o = 'owl:Class' and s <> 'owl:Thing'").select(F.col("s").alias("entity")), t).select("entity", F.array_join("texts", "|").alias("texts"))


@query(
    "display_labels",
    f"""WITH {_ONTO} SELECT DISTINCT t.s AS entity, coalesce((SELECT min(o) FROM t x WHERE x.s = t.s AND p = 'rdfs:label' AND lang = 'en'), (SELECT min(o) FROM t x WHERE x.s = t.s AND p = 'rdfs:label' AND lang IS NULL),
regexp_extract(t.s, '[/#]([^/#]+)$', 1)) AS label FROM t WHERE t.o = 'owl:Class' AND t.s <> 'owl:Thing'""",
)
def _(s, d):
    t = _onto(s, d)
    return O.display_labels(t.where("o = 'owl:Class' and s <> 'owl:Thing'").select(F.col("s").alias("entity")), t)


@query(
    "disjointness",
    """SELECT 'ex/n' || a.n_nationkey AS x, 'ex/n' || b.n_nationkey AS y, (a.n_nationkey + 1) % 25 = b.n_nationkey OR (b.n_nationkey + 1) % 25 =
a.n_nationkey AS disjoint FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey
UNION ALL SELECT 'ex/n' || n_nationkey, 'ex/n' || ((n_nationkey + 1) % 25), true FROM nation""",
)
def _(s, d):
    n = table(s, d, "nation")
    name = lambda c: F.concat(F.lit("ex/n"), c.cast("string"))
    pairs = n.alias("a").join(n.alias("b"), "n_regionkey").where("a.n_nationkey < b.n_nationkey").select(name(F.col("a.n_nationkey")).alias("x"), name(F.col("b.n_nationkey")).alias("y"))
    return O.disjoint(pairs.union(n.select(name(F.col("n_nationkey")), name((F.col("n_nationkey") + 1) % 25))), _onto(s, d))


@query(
    "asserted_neighbours",
    f"""WITH {_ONTO} SELECT n AS node, r AS parents, '' AS children FROM n UNION ALL SELECT r, '', string_agg(n, ',' ORDER BY n) FROM n GROUP BY r""",
)
def _(s, d):
    e = _edges(_onto(s, d))
    found = O.asserted(e, e.select(F.col("child").alias("node")).union(e.select("parent")))
    return found.select("node", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query(
    "inferred_neighbours",
    f"""WITH {_ONTO} SELECT n AS node, r AS other, 'super' AS side FROM n UNION ALL SELECT r, n, 'sub' FROM n
UNION ALL SELECT n, 'ex/top', 'super' FROM n UNION ALL SELECT DISTINCT r, 'ex/top', 'super' FROM n""",
)
def _(s, d):
    e = _edges(_onto(s, d))
    tops = e.select(F.col("parent").alias("child"), F.lit("ex/top").alias("parent")).distinct()
    more = s.createDataFrame([("ex/top", "owl:Thing")], "child string, parent string")
    return O.inferred(H.closure(e.unionByName(tops).unionByName(more), False), e.select(F.col("child").alias("node")).union(e.select("parent")))


@query(
    "entailment_checks",
    f"""WITH {_ONTO}, c AS (SELECT DISTINCT 'ex/n' || c_nationkey AS x, 'ex/r' || (c_custkey % 5) AS y FROM customer UNION SELECT DISTINCT 'ex/i' || c_nationkey, 'ex/r' || (c_custkey % 5) FROM customer)
SELECT x, y, EXISTS (SELECT 1 FROM n WHERE n = x AND r = y) AS subsumed, EXISTS (SELECT 1 FROM n WHERE 'ex/i' || k = x AND r = y) AS instance_of FROM c""",
)
def _(s, d):
    t = _onto(s, d)
    c = table(s, d, "customer")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    top = name("ex/r", F.col("c_custkey") % 5)
    pairs = c.select(name("ex/n", F.col("c_nationkey")).alias("x"), top.alias("y")).union(c.select(name("ex/i", F.col("c_nationkey")), top)).distinct()
    held = t.where("p = 'rdf:type' and s like 'ex/i%' and o like 'ex/n%' and s <> 'ex/in'").select(F.col("s").alias("instance"), F.col("o").alias("node"))
    return O.entailed(pairs, H.closure(_edges(t)), held)


@query(
    "common_descendants",
    """SELECT DISTINCT 'r' || a.n_regionkey AS x, 's' || (c_custkey % 3) AS y, 'n' || a.n_nationkey AS node
FROM nation a JOIN customer ON c_nationkey = n_nationkey""",
)
def _(s, d):
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    n, c = table(s, d, "nation"), table(s, d, "customer")
    up = n.select(name("n", F.col("n_nationkey")).alias("child"), name("r", F.col("n_regionkey")).alias("parent"))
    more = c.select(name("n", F.col("c_nationkey")).alias("child"), name("s", F.col("c_custkey") % 3).alias("parent"))
    pairs = up.select(F.col("parent").alias("x")).distinct().join(more.select(F.col("parent").alias("y")).distinct())
    return O.common_descendants(pairs, H.closure(up.unionByName(more)))


@query("restriction_scan", f"WITH {_ONTO} SELECT n AS cls, 'subClassOf' AS how, 'ex/in' AS prop, r AS filler FROM n WHERE k % 2 = 1")
def _(s, d):
    return O.restrictions(_onto(s, d))


@query("subsumption_extraction", f"WITH {_ONTO} SELECT n AS sub, r AS sup FROM n UNION ALL SELECT n, 'ex/in some ' || r FROM n WHERE k % 2 = 1")
def _(s, d):
    return O.subsumptions(_onto(s, d))


@query(
    "entity_replacement",
    f"""WITH {_ONTO} SELECT CASE s WHEN 'ex/r1' THEN 'ex/own' ELSE s END AS s, CASE p WHEN 'rdfs:label' THEN 'ex/name' ELSE p END AS p,
CASE o WHEN 'ex/r1' THEN 'ex/own' ELSE o END AS o FROM t""",
)
def _(s, d):
    return O.replaced(_onto(s, d).select("s", "p", "o"), s.createDataFrame([("ex/r1", "ex/own"), ("rdfs:label", "ex/name")], "old string, new string"))


@query("graph_pattern", f"WITH {_ONTO} SELECT 'ex/i' || k AS who, n AS cls, r AS above, n_name AS name FROM n")
def _(s, d):
    t = _onto(s, d)
    closed = H.closure(_edges(t), False)
    return O.select(t, [("?who", "rdf:type", "?cls"), ("?cls", "rdfs:subClassOf+", "?above"), ("?cls", "rdfs:label", "?name")], {"rdfs:subClassOf": closed}).where("who <> name")


@query(
    "individuals_removed",
    f"""WITH {_ONTO} SELECT s, p, o FROM t WHERE s NOT LIKE 'ex/i_' AND s NOT LIKE 'ex/i__' AND o NOT LIKE 'ex/i_'
AND o NOT LIKE 'ex/i__' OR s = 'ex/in' OR (o = 'ex/in' AND s LIKE '#_:%' ESCAPE '#')""",
)
def _(s, d):
    return O.without_individuals(_onto(s, d)).select("s", "p", "o")


@query("individuals_only", f"WITH {_ONTO} SELECT s, p, o FROM t WHERE s IN (SELECT 'ex/i' || k FROM n)")
def _(s, d):
    t = _onto(s, d)
    return O.individuals(t, t.where("o = 'owl:NamedIndividual'").select("s")).select("s", "p", "o")


_P = "g AS (SELECT p_type AS prop, list_sort(list(DISTINCT p_brand)) AS ds, min('size' || p_size) AS r FROM part GROUP BY 1)"
_BOUND = "'_:some' || sha256(prop || '|' || r || '|' || x)"


@query(
    "property_axioms",
    f"""WITH {_P}, u AS (SELECT *, CASE WHEN len(ds) = 1 THEN ds[1] ELSE '_:' || sha256(array_to_string(ds, '|')) END AS dom FROM g), e AS (SELECT *, unnest(ds) AS x FROM u)
SELECT prop AS s, 'rdf:type' AS p, 'owl:ObjectProperty' AS o FROM u UNION SELECT prop, 'rdfs:domain', dom FROM u UNION SELECT prop, 'rdfs:range', r FROM u UNION SELECT prop, 'owl:inverseOf', 'inverse ' || prop FROM u WHERE prop < 'M'
UNION SELECT prop, 'rdfs:subPropertyOf', 'PureProperty' FROM u UNION SELECT x, 'rdfs:subClassOf', {_BOUND} FROM e UNION SELECT {_BOUND}, 'rdf:type', 'owl:Restriction' FROM e UNION SELECT {_BOUND}, 'owl:onProperty', prop FROM e
UNION SELECT {_BOUND}, 'owl:someValuesFrom', r FROM e UNION SELECT dom, 'owl:unionOf', x FROM e WHERE len(ds) > 1""",
)
def _(s, d):
    p = table(s, d, "part")
    props = p.groupBy(F.col("p_type").alias("prop")).agg(F.array_sort(F.collect_set("p_brand")).alias("domains"), F.collect_set(F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("ranges"))
    inverses = p.where("p_type < 'M'").select(F.col("p_type").alias("prop"), F.concat(F.lit("inverse "), "p_type").alias("inverse")).distinct()
    return O.axioms(props.withColumn("kind", F.lit("objectProperty")).withColumn("parent", F.lit("PureProperty")), inverses)


@query(
    "element_annotations",
    """WITH e AS (SELECT DISTINCT p_brand AS entity, CASE WHEN p_brand < 'Brand#2' THEN 'class' ELSE 'dataProperty' END AS kind FROM part), x AS (SELECT DISTINCT p_brand, p_name, p_type FROM part)
SELECT entity AS s, 'rdfs:label' AS p, 'has ' || entity AS o FROM e UNION SELECT entity, 'rdfs:comment', 'Column ' || entity FROM e UNION SELECT p_brand, 'skos:prefLabel', lower(p_type) FROM x
UNION SELECT entity, 'skos:altLabel', CASE WHEN kind = 'class' THEN p_name ELSE 'has ' || p_name END FROM e JOIN x ON p_brand = entity""",
)
def _(s, d):
    p = table(s, d, "part")
    e = p.select(F.col("p_brand").alias("entity")).distinct()
    e = e.select("entity", F.when(F.col("entity") < "Brand#2", "class").otherwise("dataProperty").alias("kind"), F.concat(F.lit("has_"), "entity", F.lit("_VALUE")).alias("name"), F.col("entity").alias("header"), F.concat(F.lit("Column "), "entity").alias("comment"))
    return O.annotated(e, p.select(F.col("p_brand").alias("header"), F.lower("p_type").alias("tokens"), F.col("p_name").alias("expansion")).distinct())


@query(
    "mapping_skeleton",
    """WITH f AS (SELECT DISTINCT p_brand AS t, p_type AS c FROM part)
SELECT t AS "table", c AS "column", 'objectProperty:has_' || c || '|class:' || c || '|dataProperty:has_' || c || '_VALUE' AS mappings, CASE WHEN c < 'M' THEN 'new,old' ELSE 'new' END AS sources, c < 'M' AND t < 'Brand#2' AS is_pii FROM f""",
)
def _(s, d):
    f = table(s, d, "part").select(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).distinct()
    each = F.array(*(F.struct(F.lit(k).alias("type"), F.concat(F.lit(a), "column", F.lit(b)).alias("element")) for k, a, b in (("class", "", ""), ("dataProperty", "has_", "_VALUE"), ("objectProperty", "has_", ""))))
    before = f.where("column < 'M'").select("table", "column", F.array(F.lit("old")).alias("sources"), (F.col("table") < "Brand#2").alias("is_pii"))
    got = O.mapping_skeleton(f.select("table", "column", F.inline(each)), f.select("table", F.lit("new").alias("source")).distinct(), before)
    return got.select("table", "column", F.array_join(F.transform("mappings", lambda m: F.concat_ws(":", m["type"], m["element"])), "|").alias("mappings"), F.array_join("sources", ",").alias("sources"), "is_pii")


@query(
    "enriched_labels",
    f"""WITH {_ONTO} SELECT DISTINCT r AS entity, n_name || ' ' || 'R' || n_regionkey AS label FROM n WHERE k % 2 = 1
UNION SELECT 'ex/in', n_name || ' in' FROM n WHERE k % 2 = 1""",
)
def _(s, d):
    n = table(s, d, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    named = n.select(name("ex/n", "n_nationkey").alias("entity"), F.col("n_name").alias("label")).union(n.select(name("ex/r", "n_regionkey"), name("R", "n_regionkey")).distinct()).union(s.createDataFrame([("ex/in", "in")], "entity string, label string"))
    return O.enriched_labels(named.where("entity not like 'ex/n%'"), _onto(s, d), named)
