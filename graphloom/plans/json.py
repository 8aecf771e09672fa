"""Queries of JSON records as classes and triples. The records are made of relational tables, and the SQL computes the answer from these, without JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H, json_graph as J
from graphloom.operators.kg import BASE
from graphloom.registry import query, table
from graphloom.sources.mappings import repair_json


def _files(s, d):
    """A file for each conversation: one object with a single key, nested turns, tags, and a value that is always null."""
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.array(F.lit("a"), F.col("role")).alias("tags")))).alias("turns"))
    body = F.struct(F.col("conv_id").alias("id"), F.struct(F.size("turns").alias("size"), F.lit(None).cast("string").alias("note")).alias("meta"), F.col("turns").alias("turn"))
    return turns.select(F.format_string("f%09d", "conv_id").alias("file"), F.to_json(F.struct(body.alias("talk")), {"ignoreNullFields": "false"}).alias("text"))


#: c: a row for each conversation with its label; t: one for each turn with its own.
_LABELS = f"""WITH c AS (SELECT conv_id, '{BASE}talk' || (row_number() OVER (ORDER BY conv_id) - 1) AS me, count(*) AS n, printf('f%09d', conv_id) AS file FROM conversations GROUP BY conv_id),
t AS (SELECT c.me AS up, c.me || '_turn' || (row_number() OVER w - 1) AS me, row_number() OVER w - 1 AS k, turn, role FROM conversations JOIN c USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _leaf(source: str, parent: str, name: str, number: str, value: str, kind: str) -> str:
    node = f"{parent} || '_{name}' || {number}"
    return f"""SELECT {parent} AS s, 'has_{name}' AS p, {node} AS o, 'iri' AS o_kind, NULL AS datatype FROM {source}
UNION ALL SELECT {node}, 'rdf:type', '{BASE}{name}', 'iri', NULL FROM {source}
UNION ALL SELECT {node}, 'has_{name}_VALUE', CAST({value} AS VARCHAR), 'lit', 'xsd:{kind}' FROM {source}"""


def _node(source: str, parent: str, parent_class: str, name: str, node: str) -> str:
    return f"""SELECT {parent} AS s, 'p_{parent_class}_{name}' AS p, {node} AS o, 'iri' AS o_kind, NULL AS datatype FROM {source}
UNION ALL SELECT {node}, 'rdf:type', '{BASE}{name}', 'iri', NULL FROM {source}"""


_TRIPLES = " UNION ALL ".join((
    f"SELECT me AS s, 'rdf:type' AS p, '{BASE}talk' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM c",
    "SELECT me, 'SourceFile', file, 'lit', 'xsd:string' FROM c",
    _leaf("c", "me", "id", "0", "conv_id", "integer"),
    _node("c", "me", "talk", "meta", "me || '_meta0'"),
    _leaf("c", "me || '_meta0'", "size", "0", "n", "integer"),
    _node("t", "up", "talk", "turn", "me"),
    _leaf("t", "me", "turn", "k", "turn", "integer"),
    _leaf("t", "me", "role", "k", "role", "string"),
    _leaf("t", "me", "tags", "(2 * k)", "'a'", "string"),
    _leaf("t", "me", "tags", "(2 * k + 1)", "role", "string"),
))


@query("json_triples", f"{_LABELS} {_TRIPLES}")
def _(s, d):
    return J.triples(J.walk(_files(s, d)))


_SCHEMA = """WITH k(path, parent, name, kind) AS (VALUES ('/talk/id','talk','id','xsd:integer'), ('/talk/meta/size','meta','size','xsd:integer'), ('/talk/meta/note','meta','note','xsd:string'),
('/talk/turn/turn','turn','turn','xsd:integer'), ('/talk/turn/role','turn','role','xsd:string'), ('/talk/turn/tags','turn','tags','xsd:string')),
o(path, parent, name) AS (VALUES ('/talk', NULL, 'talk'), ('/talk/meta', 'talk', 'meta'), ('/talk/turn', 'talk', 'turn'))
SELECT 'class' AS kind, name, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS range, path FROM o UNION ALL SELECT 'class', name, NULL, NULL, path FROM k
UNION ALL SELECT 'objectProperty', 'p_' || parent || '_' || name, parent, name, path FROM o WHERE parent IS NOT NULL UNION ALL SELECT 'objectProperty', 'has_' || name, parent, name, path FROM k
UNION ALL SELECT 'dataProperty', 'has_' || name || '_VALUE', name, kind, path FROM k"""


@query("json_ontology", _SCHEMA)
def _(s, d):
    return J.ontology(J.walk(_files(s, d)))


@query(
    "json_tables",
    """SELECT printf('f%09d', conv_id) AS file, path, class FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('/talk', 'talk'), ('/talk/meta',
'meta'), ('/talk/turn', 'turn')) v(path, class)""",
)
def _(s, d):
    return J.table_paths(J.walk(_files(s, d)))


@query(
    "json_roots",
    """SELECT 'a' || o_custkey AS file, 'Record' AS root, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'o' || o_orderkey, 'Record', 1 FROM orders
UNION ALL SELECT 's' || o_orderkey, 'order', 1 FROM orders UNION ALL SELECT 'l' || o_custkey, 'orders', count(*) FROM orders GROUP BY 1""",
)
def _(s, d):
    """The root of arrays, of objects with many keys, of objects with a single one that holds an object or an array."""
    o = table(s, d, "orders")
    one = F.struct("o_orderkey", "o_orderstatus")
    lists = o.groupBy("o_custkey").agg(F.collect_list(one).alias("all"))
    files = lists.select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("file"), F.to_json("all").alias("text"))
    files = files.union(lists.select(F.concat(F.lit("l"), F.col("o_custkey").cast("string")), F.to_json(F.struct(F.col("all").alias("orders")))))
    files = files.union(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.to_json(one))).union(o.select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")), F.to_json(F.struct(one.alias("order")))))
    return J.records(files).groupBy("file", "root").agg(F.count("*").alias("n"))


@query(
    "json_individual_ids",
    f"""{_LABELS}, a AS ({_TRIPLES}), i AS (SELECT DISTINCT s AS old, length('{BASE}') AS b FROM a), l AS (SELECT substr(old, b + 1) AS label FROM i),
r AS (SELECT label, regexp_extract(label, '^talk([0-9]+)', 1)::BIGINT AS record, regexp_extract(label, '([a-z]+)[0-9]+$', 1) AS cls FROM l),
n AS (SELECT *, row_number() OVER (ORDER BY record, label) AS id FROM r)
SELECT label, CAST(id AS VARCHAR) AS id, record || '_' || id || '_' || cls AS short FROM n""",
)
def _(s, d):
    nodes = J.walk(_files(s, d))
    moved, known = J.numbered(J.triples(nodes), nodes)
    short = moved.where("p = 'rdfs:label'").select(F.replace("s", F.lit(BASE), F.lit("")).alias("id"), F.col("o").alias("short"))
    return known.join(short, "id").select("label", "id", "short")


@query(
    "json_value_types",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'xsd:integer' WHEN 1 THEN 'xsd:decimal' WHEN 2 THEN 'xsd:boolean' WHEN 3 THEN 'xsd:string' END AS type FROM events""",
)
def _(s, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(F.col("user_id").cast("string"), F.lit(".25"))).when(k == 2, "true").when(k == 3, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise("null")
    return table(s, d, "events").select("event_id", J.value_type(F.schema_of_variant(F.try_parse_json(text))).alias("type"))


@query("json_array_types", "SELECT o_orderkey, o_orderkey % 3 <> 1 AS primitive, o_orderkey % 3 <> 0 AS nested FROM orders")
def _(s, d):
    k = F.col("o_orderkey") % 3
    one, deep = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')), F.to_json(F.struct("o_custkey"))
    text = F.concat(F.lit("["), F.when(k == 0, F.concat_ws(",", one, F.lit("1"))).when(k == 1, F.concat_ws(",", deep, deep)).otherwise(F.concat_ws(",", one, deep)), F.lit("]"))
    return table(s, d, "orders").select("o_orderkey", J.array_type(text).alias("t")).select("o_orderkey", "t.*")


@query("json_invalid_properties", "SELECT o_orderkey, o_orderkey % 4 = 3 AS valid FROM orders")
def _(s, d):
    k = F.col("o_orderkey") % 4
    domain, name = F.when(k == 0, F.lit(None)).otherwise("Record"), F.when(k == 1, "NULL").when(k == 2, "Record").otherwise(F.col("o_orderstatus"))
    return table(s, d, "orders").select("o_orderkey", J.valid_property(domain, name, F.when(k == 2, "/Record").otherwise("/Record/x"), "Record").alias("valid"))


@query("json_repaired_walk", "SELECT o_custkey, count(*) AS records, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def _(s, d):
    """Objects that follow one another in lines, repaired to an array and walked."""
    o = table(s, d, "orders")
    text = F.concat(F.array_join(F.collect_list(F.to_json(F.struct("o_orderkey", "o_custkey"))), "\n"), F.lit("\n"))
    files = o.groupBy("o_custkey").agg(text.alias("text")).select(F.col("o_custkey").cast("string").alias("file"), repair_json(F.col("text")).alias("text"))
    nodes = J.walk(files).where("cls = 'o_orderkey'")
    return nodes.groupBy(F.col("file").cast("long").alias("o_custkey")).agg(F.count("*").alias("records"), F.sum(F.col("value").cast("long")).alias("keys"))


@query(
    "broader_resources",
    """WITH p AS (SELECT DISTINCT p_brand AS domain, 'x' || n_nationkey AS range FROM part JOIN nation ON p_size = n_nationkey), top AS (SELECT DISTINCT p_brand AS node, max(p_type) OVER (PARTITION BY p_brand) AS t FROM part),
k AS (SELECT DISTINCT p_type AS d, 'r' || (p_size % 5) AS r FROM part WHERE p_size % 2 = 0)
SELECT domain || range AS prop, CASE WHEN k.d IS NULL THEN domain ELSE top.t END AS domain, CASE WHEN k.d IS NULL THEN range ELSE 'r' || n_regionkey END AS range
FROM p JOIN top ON node = domain JOIN nation ON range = 'x' || n_nationkey LEFT JOIN k ON k.d = top.t AND k.r = 'r' || n_regionkey""",
)
def _(s, d):
    p, n = table(s, d, "part"), table(s, d, "nation")
    name = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    props = p.join(n, F.col("p_size") == F.col("n_nationkey")).select(F.col("p_brand").alias("domain"), name("x", F.col("n_nationkey")).alias("range")).distinct().withColumn("prop", F.concat("domain", "range"))
    edges = p.groupBy(F.col("p_brand").alias("child")).agg(F.max("p_type").alias("parent")).unionByName(n.select(name("x", F.col("n_nationkey")).alias("child"), name("r", F.col("n_regionkey")).alias("parent")))
    known = p.where("p_size % 2 = 0").select(F.col("p_type").alias("domain"), name("r", F.col("p_size") % 5).alias("range"))
    return J.broader(props, H.top_superclass(H.closure(edges)), known)
