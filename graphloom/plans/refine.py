"""Queries of the refined ontology, column paths and class expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.expressions import entities, verbalised
from graphloom.operators import refine as R
from graphloom.registry import query, table


@query("import_modules", "SELECT DISTINCT regexp_extract(url, '^(.*/)', 1) AS module FROM pages WHERE contains(url, '/')")
def _(s, d):
    return R.imports(table(s, d, "pages").select(F.array("url").alias("match"), F.lit(None).cast("array<string>").alias("path")))


@query(
    "extension_hierarchy",
    """WITH m AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM part GROUP BY 1) SELECT p_brand AS s, 'rdfs:subClassOf' AS p,
CASE WHEN len(t) = 1 THEN t[1] ELSE '_:' || sha256(array_to_string(t, '|')) END AS o FROM m""",
)
def _(s, d):
    m = table(s, d, "part").groupBy(F.col("p_brand").alias("element")).agg(F.collect_list("p_type").alias("match"))
    return R.hierarchy(m.withColumn("kind", F.lit("class")))


def _ontology(s, d):
    """Nations below regions, each region with a restriction."""
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("n"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"))
    below = n.select(F.col("n").alias("s"), F.lit(R.SUBCLASS).alias("p"), F.col("r").alias("o"))
    bound = n.select(F.concat(F.lit("_:"), "r").alias("s"), F.lit("owl:someValuesFrom").alias("p"), F.col("r").alias("o")).distinct()
    return below.unionByName(bound).unionByName(n.select(F.col("n").alias("s"), F.lit(R.SUBCLASS).alias("p"), F.concat(F.lit("_:"), "r").alias("o")))


_ONTO = """n AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM nation), t AS (SELECT n AS s, 'rdfs:subClassOf' AS p, r AS o
FROM n UNION ALL SELECT DISTINCT '_:' || r, 'owl:someValuesFrom', r FROM n UNION ALL SELECT n, 'rdfs:subClassOf', '_:' || r
FROM n)"""


@query("delete_class", f"WITH {_ONTO} SELECT * FROM t WHERE s NOT IN ('r1', 'n3', '_:r1') AND o NOT IN ('r1', 'n3', '_:r1')")
def _(s, d):
    return R.without(_ontology(s, d), s.createDataFrame([("r1",), ("n3",)], "element string"))


@query(
    "correct_domain",
    f"""WITH {_ONTO} SELECT DISTINCT s, p, CASE WHEN p = 'rdfs:subClassOf' AND s = 'n0' AND o = 'r0' THEN 'r9'
WHEN p = 'rdfs:subClassOf' AND s = 'n1' THEN 'any' ELSE o END AS o FROM t""",
)
def _(s, d):
    return R.replaced(_ontology(s, d), R.SUBCLASS, s.createDataFrame([("n0", "r0", "r9"), ("n1", None, "any")], "s string, old string, new string"))


@query(
    "path_properties",
    """WITH f AS (SELECT DISTINCT p_brand AS t, p_type AS c FROM part), x AS (SELECT *, 'p_' || t || '_' || c AS a, 'p_' || c || '_' || t AS b
FROM f) SELECT a AS s, 'rdfs:domain' AS p, t AS o FROM x UNION SELECT a, 'rdfs:range', c FROM x UNION
SELECT b, 'rdfs:domain', c FROM x UNION SELECT b, 'rdfs:range', t FROM x UNION SELECT a, 'owl:inverseOf', b
FROM x""",
)
def _(s, d):
    return R.path_properties(table(s, d, "part").select(F.col("p_brand").alias("table"), F.array("p_type", "p_name").alias("path")))


@query("path_specialise", "SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#11' THEN 'Own' ELSE p_brand END || '/' || p_type AS path FROM part")
def _(s, d):
    own = s.createDataFrame([("Brand#11", "Own"), ("Brand#11", "Zwei")], "cls string, table_class string")
    return R.specialised(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("path")), own).select("id", F.array_join("path", "/").alias("path"))


@query(
    "column_paths",
    """SELECT * FROM (VALUES
('person','name',0,'Person',true),('person','name',1,'hasName',true),('person','name',2,'text',true),('person','mail',0,'Person',false),('person','mail',1,'hasContact',true),('person','mail',2,'Contact',true),('person','mail',3,'text',false),('firm','title',0,'text',true))
v("table", "column", step, element, create_new)""",
)
def _(s, d):
    rows = [("person", 1, "name", ["Person"], None, "hasName", None, None, "text"), ("person", 2, "mail", ["Person"], None, "hasContact", "Contact", None, "text"), ("firm", 1, "title", None, None, None, None, None, "text")]
    return R.column_paths(s.createDataFrame(rows, "table string, position int, column string, table_path array<string>, object_path array<string>, obj string, cls string, data_path array<string>, data string"))


@query("fk_paths", "SELECT * FROM (VALUES ('orders','o_custkey','placedBy'), ('customer','c_nationkey','p_customer_nation')) v(\"table\", \"column\", prop)")
def _(s, d):
    fks = s.createDataFrame([("orders", "o_custkey", "customer"), ("customer", "c_nationkey", "nation")], "table string, column string, ref string")
    return R.fk_paths(fks, s.createDataFrame([("orders", "o_custkey", "placedBy")], "table string, column string, prop string"))


@query("superfluous_elements", "SELECT * FROM (VALUES ('Name'), ('hasName')) v(element)")
def _(s, d):
    return R.superfluous(s.createDataFrame([("Name", "hasName", None, None, "label"), ("City", "inCity", "Place", None, "label"), ("Age", "hasAge", None, None, None)], "cls string, obj string, m_cls string, m_obj string, m_data string"))


_NAMES = {"C": "cell", "D": "dog", "E": "ear", "p": "located in", "q": "has part"}
_EXPRESSIONS = (
    ("<C>", "cell"),
    ("ObjectComplementOf(<C>)", "not cell"),
    ("ObjectSomeValuesFrom(<p> <C>)", "something that is located in some cell"),
    ("ObjectAllValuesFrom(<q> ObjectComplementOf(<D>))", "something that has part only not dog"),
    ("ObjectIntersectionOf(<C> <D> ObjectSomeValuesFrom(<q> <E>))", "cell and dog that has part some ear"),
    ("ObjectIntersectionOf(ObjectSomeValuesFrom(<q> <C>) ObjectSomeValuesFrom(<q> <D>) ObjectAllValuesFrom(<p> <E>))", "something that has part some cell and dog and is located in only ear"),
    ("ObjectUnionOf(<C> ObjectSomeValuesFrom(<q> <D>))", "cell or something that has part some dog"),
    ("ObjectUnionOf(<C> <D>)", "cell or dog"),
    ("SubClassOf(<C> ObjectSomeValuesFrom(<q> <D>))", "cell is a kind of something that has part some dog"),
    ("ObjectUnionOf(<C>", None),
)


@query(
    "verbalise_expressions",
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in e) + ")" for e in _EXPRESSIONS) + """) v(expression, verbal)""",
)
def _(s, d):
    rows = s.createDataFrame([(e,) for e, _ in _EXPRESSIONS], "expression string").withColumn("iri", F.explode(entities(F.col("expression"))))
    names = s.createDataFrame(list(_NAMES.items()), "iri string, name string")
    known = rows.join(names, "iri").groupBy("expression").agg(F.map_from_entries(F.collect_list(F.struct("iri", "name"))).alias("names"))
    return known.select("expression", verbalised(F.col("expression"), F.col("names")).alias("verbal"))
