"""Queries of rows along column paths, of table rules, and of headers in their contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import contexts as H, rows as R
from graphloom.operators.kg import BASE
from graphloom.registry import query, table

_PATHS = {
    "o_totalprice": ["hasCost", "Cost", "amount"],
    "o_orderstatus": ["hasCost", "Cost", "inState", "State", "code"],
    "o_orderpriority": ["priority"],
    "o_orderdate": ["placedBy", "Customer", "activeOn"],
}
_TYPES = {"amount": "xsd:decimal", "code": "xsd:string", "priority": "xsd:string", "activeOn": "xsd:dateTime"}
_O = f"""o AS (SELECT *, '{BASE}orders_2_' || o_orderkey AS me, '{BASE}Cost_orders_2_' || o_orderkey AS cost, '{BASE}State_orders_2_' || o_orderkey AS st, '{BASE}customer_0_' || o_custkey AS cu FROM orders),
x AS (SELECT me AS s, 'rdf:type' AS p, '{BASE}Order' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM o UNION SELECT me, 'rdfs:comment', 'orders', 'lit', 'xsd:string' FROM o
UNION SELECT me, 'hasCost', cost, 'iri', NULL FROM o UNION SELECT cost, 'costOf', me, 'iri', NULL FROM o UNION SELECT cost, 'rdf:type', '{BASE}Cost', 'iri', NULL FROM o UNION SELECT cost, 'amount', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'lit', 'xsd:decimal' FROM o
UNION SELECT cost, 'inState', st, 'iri', NULL FROM o UNION SELECT st, 'rdf:type', '{BASE}State', 'iri', NULL FROM o UNION SELECT st, 'code', o_orderstatus, 'lit', 'xsd:string' FROM o
UNION SELECT me, 'priority', o_orderpriority, 'lit', 'xsd:string' FROM o UNION SELECT me, 'placedBy', cu, 'iri', NULL FROM o UNION SELECT cu, 'rdf:type', '{BASE}Customer', 'iri', NULL FROM o UNION SELECT cu, 'activeOn', CAST(o_orderdate AS VARCHAR), 'lit', 'xsd:dateTime' FROM o)"""


@query("path_triples", f"WITH {_O} SELECT * FROM x")
def _(s, d):
    o = table(s, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return R.path_triples("orders", "Order", o, 2, ["o_orderkey"], _PATHS, _TYPES, {"o_custkey": ("Customer", "customer", 0)}, {"hasCost": "costOf"}).distinct()


@query(
    "path_report",
    """SELECT t AS "table", string_agg(c || ': ' || p, chr(10) ORDER BY c) AS report FROM (SELECT p_brand AS t, p_type AS c, string_agg(DISTINCT p_name,
' > ' ORDER BY p_name) AS p FROM part GROUP BY ALL) GROUP BY 1""",
)
def _(s, d):
    from pyspark.sql import Window

    rows = table(s, d, "part").select(F.col("p_brand").alias("table"), F.col("p_type").alias("column"), F.col("p_name").alias("element")).distinct()
    return R.path_report(rows.withColumn("step", F.row_number().over(Window.partitionBy("table", "column").orderBy("element"))))


@query(
    "table_rules",
    """WITH m("table", table_match, "column", cls) AS (VALUES ('customer', 'Customer', 'custkey', 'Customer'), ('customer', 'Customer', 'nationkey', 'Place'), ('orders', 'Order', 'custkey', 'Person'), ('orders', 'Order', 'orderkey', 'Order'), ('nation', NULL, 'nationkey', 'Place')),
key AS (SELECT 'customer' AS "table", 'custkey' AS "column" WHERE (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) UNION ALL SELECT 'orders', 'orderkey' WHERE (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders)),
held AS (SELECT 'orders' AS "table", 'custkey' AS "column", 'customer' AS tgt WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)))
SELECT m."table", m."column", CASE WHEN m.cls = m.table_match OR held.tgt IS NOT NULL THEN NULL ELSE 'has_' || m."column" END AS obj, CASE WHEN m.cls = m.table_match OR held.tgt IS NOT NULL THEN NULL ELSE m.cls END AS cls, 'value' AS data,
CASE WHEN held.tgt IS NOT NULL THEN 'Customer' END AS path, held.tgt AS fk_table FROM m LEFT JOIN held ON held."table" = m."table" AND held."column" = m."column" AND EXISTS (SELECT 1 FROM key WHERE key."table" = held.tgt AND key."column" = held."column")""",
)
def _(s, d):
    from graphloom.operators import profile as P

    rows = [("customer", "Customer", "custkey", "Customer"), ("customer", "Customer", "nationkey", "Place"), ("orders", "Order", "custkey", "Person"), ("orders", "Order", "orderkey", "Order"), ("nation", None, "nationkey", "Place")]
    m = s.createDataFrame(rows, "table string, table_match string, column string, cls string").select("table", "table_match", "column", F.concat(F.lit("has_"), "column").alias("obj"), "cls", F.lit("value").alias("data"))
    tables = {"customer": table(s, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")), "orders": table(s, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")), "nation": table(s, d, "nation").select(F.col("n_nationkey").alias("nationkey"))}
    keys = tables["customer"].sparkSession.createDataFrame([], "table string, column string")
    for t, df in tables.items():
        keys = keys.unionByName(P.candidate_keys(df, t).where("is_key").select("table", "column"))
    return R.table_rules(m, keys, P.discover_fks(tables))


@query(
    "declarative_mapping",
    """SELECT 'http://x/' || c_nationkey || '/' || c_custkey AS s, 'rdf:type' AS p, 'Customer' AS o, 'iri' AS o_kind
FROM customer UNION ALL SELECT 'http://x/' || c_nationkey || '/' || c_custkey, 'name', c_name, 'lit'
FROM customer UNION ALL SELECT 'http://x/' || c_nationkey || '/' || c_custkey, 'in', 'http://n/' || c_nationkey, 'iri'
FROM customer""",
)
def _(s, d):
    return R.templated(table(s, d, "customer"), "http://x/{c_nationkey}/{c_custkey}", "Customer", {"name": "c_name", "in": "http://n/{c_nationkey}"})


_CATALOG = (("region", None), ("nation", "region"), ("customer", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("part", "part"), ("events", "absent"), ("archive", "zoo"), ("zoo", "archive"))


def _catalog(s):
    return s.createDataFrame([(t, f"to_{f}", f) for t, f in _CATALOG], "table string, column string, fk_table string")


@query(
    "deferred_keys",
    """SELECT * FROM (VALUES ('part', 'to_part', 'self'), ('events', 'to_absent', 'missing'), ('archive', 'to_zoo', 'later')) v("table", "column", why)""",
)
def _(s, d):
    c = _catalog(s)
    return R.deferred_keys(c, R.load_order(c))


@query("declared_tables", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, 't_' || n_nationkey AS \"table\" FROM nation")
def _(s, d):
    one = F.concat(F.lit("CREATE TABLE IF NOT EXISTS `t_"), F.col("n_nationkey").cast("string"), F.lit("` (id INT,\n name TEXT)"))
    ddl = table(s, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("x")))), lambda x: x["x"]), ";\n").alias("text"))
    return R.declared_order(ddl).select(F.col("pos").cast("long").alias("pos"), "table")


@query("header_contexts")
def _(s, d):
    """Types are datasets, their brands' names the headers; a test compares the contexts with a plain search."""
    p = table(s, d, "part").groupBy(F.col("p_type").alias("dataset"), F.col("p_name").alias("header")).agg(F.min("p_partkey").alias("position"))
    word = F.get(F.split("header", " "), 0)
    return H.contexts(p.select("dataset", "position", "header", F.col("header").alias("tokenised"), F.when(F.length(word) <= 3, F.array(word)).otherwise(F.array().cast("array<string>")).alias("abbrevs"), (F.length(word) > 3).alias("clear")))


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "context_scores",
    f"""WITH {_E} SELECT a.label::VARCHAR AS header, a.vec_id::VARCHAR AS form, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS context
FROM e a JOIN e b ON b.vec_id IN (a.label, a.label + 1, a.label + 2) GROUP BY ALL""",
)
def _(s, d):
    e = table(s, d, "embeddings")
    cands = e.select(F.col("label").cast("string").alias("header"), F.col("vec_id").cast("string").alias("form"))
    near = e.select("label").distinct().select(F.col("label").cast("string").alias("header"), F.explode(F.array(*((F.col("label") + i).cast("string") for i in range(3)))).alias("context"))
    got = H.context_scores(cands, near, e.select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("v")))
    return got.select("header", "form", F.round("context", 6).alias("context"))


@query(
    "candidate_groups",
    """WITH c AS (SELECT p_brand AS header, p_type AS grp, p_size % 2 = 0 AS whole, p_name AS form, max(p_size) AS score, max(p_partkey % 10) AS context, max(p_partkey % 7) AS a, max(p_partkey % 5) AS b FROM part GROUP BY ALL)
SELECT header, grp, whole, max(score)::DOUBLE AS score, max(context)::DOUBLE AS context, string_agg(form, ',' ORDER BY score DESC, form) AS forms, max(a) || ',' || max(b) AS global_scores FROM c GROUP BY ALL""",
)
def _(s, d):
    p = table(s, d, "part").groupBy(F.col("p_brand").alias("header"), F.col("p_type").alias("grp"), (F.col("p_size") % 2 == 0).alias("whole"), F.col("p_name").alias("form"))
    c = p.agg(F.max("p_size").cast("double").alias("score"), F.max(F.col("p_partkey") % 10).cast("double").alias("context"), F.array(F.max(F.col("p_partkey") % 7), F.max(F.col("p_partkey") % 5)).alias("global_scores"))
    return H.grouped(c).select("header", "grp", "whole", "score", "context", F.array_join("forms", ",").alias("forms"), F.array_join(F.transform("global_scores", lambda x: x.cast("string")), ",").alias("global_scores"))


@query(
    "expansions_document",
    """SELECT p_brand AS header, count(DISTINCT p_name) AS n, arg_min(p_name, (-m, p_name)) AS first FROM (SELECT p_brand, p_name, max(p_size) AS m
FROM part GROUP BY ALL) GROUP BY 1 UNION ALL SELECT 'lonely', 0, NULL""",
)
def _(s, d):
    p = table(s, d, "part")
    cands = p.groupBy(F.col("p_brand").alias("header"), F.col("p_name").alias("form")).agg(F.max("p_size").cast("double").alias("score")).select("*", F.array(F.lit(0.5), F.lit(1.0)).alias("global_scores"), F.lit(0.1).alias("context"), F.lit(None).cast("double").alias("seed_score"))
    headers = p.select(F.col("p_brand").alias("header")).distinct().union(s.createDataFrame([("lonely",)], "header string"))
    rows = H.expansions_document(headers.select("header", F.lower("header").alias("tokenised"), F.array("header").alias("abbrevs")), cands)
    parsed = F.from_json("value", "headerCands array<struct<rank:int,headerFF:string,meanGlobalScores:double>>")["headerCands"]
    return rows.select("header", F.size(parsed).cast("long").alias("n"), F.get(parsed, 0)["headerFF"].alias("first"))


@query(
    "form_groups",
    """WITH f AS (SELECT DISTINCT p_type AS abbrev, p_name AS lf FROM part WHERE contains(p_name, ' ')),
x AS (SELECT abbrev, lf FROM f UNION SELECT abbrev, upper(split_part(lf, ' ', 2)) || '-' || split_part(lf, ' ', 1) FROM f UNION SELECT abbrev, split_part(lf, ' ', 2) || ' ' || split_part(lf, ' ', 1) FROM f),
g AS (SELECT abbrev, lf, array_to_string(list_sort(string_split(lower(replace(lf, '-', ' ')), ' ')), ' ') AS w FROM x)
SELECT abbrev, lf, arg_min(lf, (length(lf), 1 - len(string_split(lf, ' ')), lf)) OVER (PARTITION BY abbrev, w) AS grp FROM g""",
)
def _(s, d):
    """Forms with their words the other way round, or with a hyphen, are one."""
    f = table(s, d, "part").where("contains(p_name, ' ')").select(F.col("p_type").alias("abbrev"), F.col("p_name").alias("lf")).distinct()
    w, v = (F.get(F.split("lf", " "), i) for i in (0, 1))
    rows = f.unionByName(f.select("abbrev", F.concat(F.upper(v), F.lit("-"), w).alias("lf"))).unionByName(f.select("abbrev", F.concat_ws(" ", v, w).alias("lf")))
    return H.form_groups(rows)
