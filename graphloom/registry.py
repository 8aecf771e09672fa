"""All registered queries of the reference operators, with their SQL side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import hierarchy as H
from graphloom.operators import kg, matching as M, profile as P

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}
STAR = ("region", "nation", "customer", "supplier", "part", "orders")
FKS = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"))


def query(name: str, sql: str | None = None):
    def put(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- cleaning and typing ---------------------------------------------------------------------------


@query(
    "null_token_filter",
    """SELECT event_id, t FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NULL' WHEN 1 THEN '-' WHEN 2 THEN NULL ELSE event_type END AS t
FROM events) WHERE t IS NOT NULL AND lower(t) NOT IN ('none', 'null', '', ' ', '-')""",
)
def _(s, d):
    k = F.col("event_id") % 5
    t = F.when(k == 0, "NULL").when(k == 1, "-").when(k == 2, F.lit(None)).otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", t.alias("t")).where(X.is_not_null(F.col("t")))


@query(
    "delimiter_sniff",
    """WITH l AS (SELECT concat_ws(';', c_custkey, c_name, c_nationkey, c_mktsegment) AS line FROM customer
WHERE c_custkey = 1), c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[^_a-zA-Z0-9]')) AS ch
FROM l) GROUP BY ch) SELECT ch AS delimiter, n::BIGINT AS n FROM c ORDER BY n DESC, ch LIMIT 1""",
)
def _(s, d):
    from graphloom.sources.tabular import sniff

    return sniff(table(s, d, "customer").where("c_custkey = 1").select(F.concat_ws(";", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("line")))


_HEADERS = ["a", "", "b", "a", " ", "b", "c"]


@query(
    "header_repair",
    """WITH h AS (SELECT * FROM (VALUES (1,'a'),(2,''),(3,'b'),(4,'a'),(5,' '),(6,'b'),(7,'c')) v(pos, h)), n AS (SELECT pos, h, trim(h) = '' AS blank,
row_number() OVER (PARTITION BY trim(h) = '' ORDER BY pos) AS k, row_number() OVER (PARTITION BY h
ORDER BY pos) AS seen FROM h) SELECT pos::BIGINT AS pos, CASE WHEN blank THEN 'Unknown_Header_' || k
WHEN seen > 1 THEN h || '_' || pos ELSE h END AS header FROM n UNION ALL SELECT 8, 'Unknown_Header_3'""",
)
def _(s, d):
    from graphloom.sources.tabular import repaired

    return s.createDataFrame([(i, h) for i, h in enumerate(repaired(_HEADERS, 8), 1)], "pos long, header string")


@query("drop_empty_unknown", "SELECT n_nationkey, n_name, 'x' AS Unknown_Header_2 FROM nation")
def _(s, d):
    return P.drop_empty_unknown(table(s, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") > 3, "").otherwise("-").alias("Unknown_Header_1"), F.lit("x").alias("Unknown_Header_2")))


@query("surrogate_key", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS PKCol FROM nation")
def _(s, d):
    from graphloom.sources.tabular import with_surrogate_key

    return with_surrogate_key(table(s, d, "nation"), "n_nationkey").select("n_name", "PKCol")


_VOTED = {"orders": ("o_orderstatus", "o_custkey", "o_day"), "part": ("p_size", "p_name", "p_price"), "labels": ("quality", "toxic")}


def _vote_sql() -> str:
    cols = {"o_day": "strftime(o_orderdate, '%Y-%m-%d')", "p_price": "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)"}
    cells = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS \"table\", '{c}' AS \"column\", CAST({cols.get(c, c)} AS VARCHAR) AS v FROM {t}" for t, cs in _VOTED.items() for c in cs)
    return rf"""WITH c AS (SELECT * FROM ({cells}) WHERE v IS NOT NULL AND lower(v) NOT IN ('none','null','',' ','-')),
v AS (SELECT "table", "column", count(*) AS n, count(*) FILTER (regexp_full_match(v, '[+-]?\d+') AND TRY_CAST(v AS INTEGER) IS NOT NULL) AS n_int, count(*) FILTER (regexp_full_match(v, '[+-]?\d+([.,]\d+)?')) AS n_double,
count(*) FILTER ((regexp_full_match(v, '(19|20|21)\d\d') ) OR (regexp_full_match(v, '(19|20|21)\d\d-\d\d-\d\d'))) AS n_date, count(*) FILTER (lower(v) IN ('0','1','true','false')) AS n_bool FROM c GROUP BY ALL)
SELECT *, CASE WHEN n_bool = n AND n <= 2 THEN 'boolean' WHEN n_date = n THEN 'timestamp' WHEN n_int = n THEN 'int' WHEN n_double = n THEN 'double' ELSE 'varchar' END AS type FROM v"""


@query("type_inference_votes", _vote_sql())
def _(s, d):
    derived = {"o_day": F.date_format("o_orderdate", "yyyy-MM-dd"), "p_price": F.col("p_retailprice").cast("decimal(18,2)")}
    return union([P.type_votes(table(s, d, t).select(*(derived.get(c, F.col(c)).alias(c) for c in cs)), t) for t, cs in _VOTED.items()])


@query(
    "date_format_classify",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'y-M-d' WHEN 1 THEN CASE WHEN day(o_orderdate) > 12 THEN 'd-M-y' ELSE 'M-d-y' END
WHEN 2 THEN 'y-M' WHEN 3 THEN 'y' END AS fmt, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
WHEN 1 THEN CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%d-%m') END
WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 3 THEN strftime(o_orderdate, '%Y-01-01') END AS iso
FROM orders""",
)
def _(s, d):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    v = F.when(k == 0, F.date_format(day, "yyyy/MM/dd")).when(k == 1, F.date_format(day, "dd.MM.yyyy")).when(k == 2, F.date_format(day, "yyyy-MM")).when(k == 3, F.date_format(day, "yyyy")).otherwise("n/a")
    return table(s, d, "orders").select("o_orderkey", X.date_format_of(v).alias("fmt"), X.iso_date(v).alias("iso"))


@query(
    "boolean_detect",
    """SELECT 'labels' AS "table", 'toxic' AS "column", count(DISTINCT toxic) <= 2 AND bool_and(CAST(toxic AS VARCHAR) IN ('0','1')) AS is_boolean
FROM labels UNION ALL SELECT 'orders', 'o_orderstatus', false FROM (SELECT 1)""",
)
def _(s, d):
    votes = P.type_votes(table(s, d, "labels").select("toxic"), "labels").unionByName(P.type_votes(table(s, d, "orders").select("o_orderstatus"), "orders"))
    return votes.select("table", "column", (F.col("type") == "boolean").alias("is_boolean"))


@query("json_paths", "SELECT DISTINCT '/Record/' || key AS path, 'xsd:integer' AS type FROM (SELECT unnest(json_keys(props)) AS key FROM events)")
def _(s, d):
    from graphloom.sources.json_tree import paths

    return paths(table(s, d, "events"), "props", "Record")


# --- knowledge graph -------------------------------------------------------------------------------

_BASE = kg.BASE
_XSD = {"int": "xsd:integer", "long": "xsd:integer", "double": "xsd:decimal", "string": "xsd:string", "time": "xsd:dateTime"}
GRAPH = {
    "customer": (0, ["c_custkey"], {"c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"}, {"c_nationkey": ("nation", 1, "n_nationkey")}),
    "nation": (1, ["n_nationkey"], {"n_name": "string"}, {}),
    "orders": (2, ["o_orderkey"], {"o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "string"}, {"o_custkey": ("customer", 0, "c_custkey")}),
}


def _graph_sql(names: tuple[str, ...]) -> str:
    out = []
    for t in names:
        rank, keys, attrs, fks = GRAPH[t]
        uri = f"'{_BASE}{t}_{rank}_' || {keys[0]}"
        out.append(f"SELECT {uri} AS s, 'rdf:type' AS p, '{_BASE}{t}' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM {t}")
        for c, kind in attrs.items():
            v = f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if kind == "double" else f"CAST({c} AS VARCHAR)"
            out.append(f"SELECT {uri}, 'has_{c}', {v}, 'lit', '{_XSD[kind]}' FROM {t} WHERE {c} IS NOT NULL AND lower(CAST({c} AS VARCHAR)) NOT IN ('none','null','',' ','-')")
        for c, (other, r, key) in fks.items():
            them = f"'{_BASE}{other}_{r}_' || {key}"
            out += [f"SELECT {uri}, 'p_{t}_{other}', {them}, 'iri', NULL FROM {t} JOIN {other} ON {c} = {key}", f"SELECT {them}, 'p_{other}_{t}', {uri}, 'iri', NULL FROM {t} JOIN {other} ON {c} = {key}"]
    return " UNION ".join(out)


def _graph(s: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    return union([kg.triples(t, table(s, d, t), *GRAPH[t], {o: table(s, d, o) for o, *_ in GRAPH[t][3].values()}) for t in names])


@query("kg_triples_customer_orders", _graph_sql(tuple(GRAPH)))
def _(s, d):
    return _graph(s, d, tuple(GRAPH))


for _t in GRAPH:
    query(f"kg_triples_{_t}", _graph_sql((_t,)))(lambda s, d, t=_t: _graph(s, d, (t,)))


@query("fk_edges", f"SELECT s, p, o FROM ({_graph_sql(('orders',))}) WHERE p IN ('p_orders_customer', 'p_customer_orders')")
def _(s, d):
    return _graph(s, d, ("orders",)).where("p in ('p_orders_customer', 'p_customer_orders')").select("s", "p", "o")


@query("kg_degree", f"SELECT p, count(*) AS n, count(DISTINCT s) AS n_subjects FROM ({_graph_sql(tuple(GRAPH))}) GROUP BY p")
def _(s, d):
    return _graph(s, d, tuple(GRAPH)).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_subjects"))


@query(
    "ntriples_sink",
    f"""SELECT '<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '"' || o || '"^^<' || datatype || '>' END || ' .' AS line
FROM ({_graph_sql(('nation',))})""",
)
def _(s, d):
    return kg.ntriples(_graph(s, d, ("nation",)))


# --- labels ----------------------------------------------------------------------------------------


@query("local_name", "SELECT page_id, nullif(regexp_extract(url, '[/#]([^/#]+)$', 1), '') AS name, regexp_extract(url, '^(.*/)', 1) AS ns FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.local_name(F.col("url")).alias("name"), X.namespace(F.col("url")).alias("ns"))


@query("label_normalise", "SELECT p_partkey, 'has ' || p_name || ' ' || p_type AS label, replace(replace(p_name, ',', ''), '#', ' ') AS plain FROM part")
def _(s, d):
    n = F.concat(F.lit("has_[p_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("]_"), "p_type", F.lit("_VALUE"))
    return table(s, d, "part").select("p_partkey", X.normalise_label(n).alias("label"), X.remove_punctuation(F.col("p_name")).alias("plain"))


@query("camel_split", "SELECT * FROM (VALUES ('PatientName', 'Patient Name'), ('SOPClassUID', 'SOP Class UID'), ('studyDate', 'study Date')) v(name, words)")
def _(s, d):
    return s.createDataFrame([(x,) for x in ("PatientName", "SOPClassUID", "studyDate")], "name string").select("name", X.split_camel(F.col("name")).alias("words"))


@query("label_index", "SELECT DISTINCT p_brand AS entity, lower(replace(p_name, '_', ' ')) AS label FROM part")
def _(s, d):
    return M.label_index(table(s, d, "part"), "p_brand", "p_name")


_POST = """post AS (SELECT token, doc_id AS entity, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token
FROM documents) WHERE token <> 'has' GROUP BY ALL)"""


@query("inverted_index", f"WITH {_POST} SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY token")
def _(s, d):
    return M.inverted_index(M.postings(table(s, d, "documents"), "doc_id", "text"))


_IDF = f"""WITH {_POST},
f AS (SELECT token, log10((SELECT count(*) FROM documents) / count(*)) AS idf FROM post GROUP BY token),
q AS (SELECT item_id AS src, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
r AS (SELECT src, entity, round(sum(idf), 6) AS score FROM q JOIN f USING (token) JOIN post USING (token) GROUP BY ALL)
SELECT src, entity, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, entity) AS k FROM r) WHERE k <= 10"""


@query("idf_pool", _IDF)
def _(s, d):
    docs = table(s, d, "documents")
    q = table(s, d, "benchmark").select(F.col("item_id").alias("src"), F.explode(X.tokens(F.col("text"))).alias("token"))
    return M.idf_pool(q, M.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("d")), 10).withColumn("rank", F.col("rank").cast("long"))


_NAMES_SQL = """n AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT DISTINCT a.p_name AS src, b.p_name AS tgt
FROM n a JOIN n b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) OR split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)
WHERE a.p_name <> b.p_name)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Names that share a token, by a join on tokens."""
    t = table(s, d, "part").select("p_name").distinct().select("p_name", F.posexplode(F.slice(F.split("p_name", " "), 1, 2)).alias("i", "t"))
    return t.alias("a").join(t.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.p_name") != F.col("b.p_name"))).select(F.col("a.p_name").alias("src"), F.col("b.p_name").alias("tgt"), F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b")).distinct()


@query(
    "exact_label_match",
    """SELECT p_brand AS src, min(p_type) AS tgt, 1.0::DOUBLE AS score FROM (SELECT DISTINCT p_brand, p_name
FROM part) a JOIN (SELECT DISTINCT p_type, p_name FROM part) b USING (p_name) GROUP BY 1""",
)
def _(s, d):
    p = table(s, d, "part")
    return M.exact_match(M.label_index(p, "p_brand", "p_name"), M.label_index(p, "p_type", "p_name"))


@query("levenshtein_match", f"WITH {_NAMES_SQL} SELECT src, tgt, round(1 - levenshtein(src, tgt) / greatest(length(src), length(tgt)), 6) AS score FROM pairs")
def _(s, d):
    return M.best_similarity(_pairs(s, d))


_PJ = f"""WITH {_NAMES_SQL}, pj AS (SELECT src, tgt, round(len(list_filter(string_split(tgt, ' '), lambda x: length(x) > 1
AND contains(src, x))) / len(string_split(tgt, ' ')), 6) AS pj, length(tgt) AS clen, round(1 - levenshtein(src, tgt) / greatest(length(src),
length(tgt)), 6) AS score FROM pairs), rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS bes_rank, dense_rank() OVER
(PARTITION BY src ORDER BY pj DESC, clen DESC) AS pj_rank FROM pj)"""


def _ranked(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    return M.ranked(M.best_similarity(p).join(M.partial_jaccard(p), ["src", "tgt"])).select("src", "tgt", "score", "pj", F.col("clen").cast("long").alias("clen"), F.col("bes_rank").cast("long").alias("bes_rank"), F.col("pj_rank").cast("long").alias("pj_rank"))


@query("partial_jaccard", _PJ + " SELECT src, tgt, score, pj, clen::BIGINT AS clen, bes_rank, pj_rank FROM rk")
def _(s, d):
    return _ranked(s, d)


@query("topn_candidates", _PJ + " SELECT src, tgt, score, bes_rank FROM rk WHERE bes_rank <= 3")
def _(s, d):
    return _ranked(s, d).where("bes_rank <= 3").select("src", "tgt", "score", "bes_rank")


@query("low_score_scan")
def _(s, d):
    return M.suitable(_ranked(s, d).select("src", F.col("bes_rank").alias("pos"), F.col("pj_rank").cast("int").alias("rank"), "score"), 0.1)


@query(
    "table_match_select",
    _PJ + """, g AS (SELECT * FROM rk WHERE score >= 0.8 OR (score >= 0.4 AND pj >= 0.5)) SELECT src, tgt FROM (SELECT src, tgt, row_number() OVER (PARTITION BY
src ORDER BY pj_rank, pj DESC, tgt) AS k FROM g) WHERE k = 1""",
)
def _(s, d):
    return M.table_match(_ranked(s, d).withColumnRenamed("score", "bes"), 0.8, 0.4, 0.5)


# --- hierarchy -------------------------------------------------------------------------------------

_EDGES_SQL = """e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey
FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n1', 'world')"""
_CLOSED = f"""WITH RECURSIVE {_EDGES_SQL}, w AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION
SELECT node, parent, depth + 1 FROM w JOIN e ON ancestor = child), cl AS (SELECT node, ancestor, min(depth)::INTEGER AS depth
FROM w GROUP BY ALL UNION ALL SELECT DISTINCT x, x, 0 FROM (SELECT child AS x FROM e UNION SELECT parent
FROM e))"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [table(s, d, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")), table(s, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")), table(s, d, "region").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))]
    return union(parts).union(s.createDataFrame([("n1", "world")], "child string, parent string"))


@query("ancestors_min_depth", _CLOSED + " SELECT * FROM cl")
def _(s, d):
    return H.closure(_edges(s, d))


@query(
    "top_superclass",
    _CLOSED + """ SELECT node, top, depth FROM (SELECT node, ancestor AS top, depth, row_number() OVER (PARTITION BY node
ORDER BY depth DESC, ancestor) AS k FROM cl) WHERE k = 1""",
)
def _(s, d):
    return H.top_superclass(H.closure(_edges(s, d)))


@query(
    "inherited_domain",
    _CLOSED + """ SELECT node, value, depth FROM (SELECT node, r_name AS value, depth, row_number() OVER (PARTITION BY node
ORDER BY depth, r_name) AS k FROM cl JOIN region ON ancestor = 'r' || r_regionkey) WHERE k = 1""",
)
def _(s, d):
    return H.inherited(H.closure(_edges(s, d)), table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("value")))


@query(
    "common_ancestor_groups",
    _CLOSED + """, m AS (SELECT ancestor, count(*) AS n, max(depth) AS d FROM cl WHERE node LIKE 'n%' AND depth <= 1
GROUP BY 1 HAVING count(*) > 1), b AS (SELECT node, m.ancestor, row_number() OVER (PARTITION BY node
ORDER BY n DESC, depth, m.ancestor) AS k FROM cl JOIN m ON m.ancestor = cl.ancestor WHERE node LIKE 'n%'
AND depth <= 1) SELECT DISTINCT node, coalesce(b.ancestor, node) AS grp FROM (SELECT DISTINCT node
FROM cl WHERE node LIKE 'n%') LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (node)""",
)
def _(s, d):
    closed = H.closure(_edges(s, d))
    return H.largest_groups(closed, closed.where("node like 'n%'").select("node").distinct(), 1)


@query(
    "siblings",
    """SELECT parent, string_agg(DISTINCT child, ',' ORDER BY child) AS children, count(DISTINCT child) AS n
FROM (SELECT 'r' || n_regionkey AS parent, n_name AS child FROM nation) GROUP BY parent HAVING count(DISTINCT child) > 1""",
)
def _(s, d):
    return H.siblings(table(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("child")))


@query(
    "prune_hierarchy",
    f"""WITH {_EDGES_SQL} SELECT DISTINCT e.child, coalesce(u.parent, e.parent) AS parent FROM e LEFT JOIN e u ON e.parent = u.child
AND e.parent LIKE 'n%' WHERE e.child NOT LIKE 'n%'""",
)
def _(s, d):
    e = _edges(s, d)
    return H.prune(e, e.where("child like 'n%'").select(F.col("child").alias("node")).distinct())


@query(
    "connected_components",
    """WITH RECURSIVE t AS (SELECT md5(text) AS h, doc_id FROM documents), e AS (SELECT a.doc_id AS a, b.doc_id AS b
FROM t a JOIN t b ON a.h = b.h), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS node, min(b) AS comp FROM r GROUP BY a HAVING count(*) > 1""",
)
def _(s, d):
    t = table(s, d, "documents").select(F.md5("text").alias("h"), "doc_id")
    heads = t.groupBy("h").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return H.connected(t.join(heads, "h").select(F.col("doc_id").alias("a"), "b"))


@query("vote_components", "SELECT * FROM (VALUES (1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 2), (8, 7, 2)) v(node, comp, votes)")
def _(s, d):
    c = H.connected(s.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int"))
    return c.join(c.groupBy("comp").agg(F.count("*").cast("int").alias("votes")), "comp").select("node", "comp", "votes")


@query(
    "one_hop_extension",
    """WITH s AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation), m AS (SELECT child AS src, child AS tgt
FROM s) SELECT DISTINCT a.parent AS src, b.parent AS tgt FROM m JOIN s a ON src = a.child JOIN s b ON tgt = b.child""",
)
def _(s, d):
    e = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return M.extend_one_hop(e.select(F.col("child").alias("src"), F.col("child").alias("tgt")), e, e)


# --- similarity, abbreviations, evaluation ---------------------------------------------------------


@query(
    "near_duplicate_names",
    """WITH n AS (SELECT DISTINCT p_name FROM part), k AS (SELECT p_name, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS w
FROM n) SELECT a.p_name AS a, b.p_name AS b FROM k a JOIN k b USING (w) WHERE a.p_name < b.p_name""",
)
def _(s, d):
    k = table(s, d, "part").select("p_name").distinct().withColumn("w", F.array_join(X.word_set(F.col("p_name")), " "))
    return k.alias("a").join(k.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.p_name") < F.col("b.p_name"))).select(F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"))


@query(
    "abbrev_lookup",
    """WITH inv AS (SELECT DISTINCT string_agg(left(w, 1), '' ORDER BY i) AS sf, p_name AS lf FROM (SELECT DISTINCT p_name, i, string_split(p_name, ' ')[i]
AS w FROM part, range(1, 3) r(i)) GROUP BY p_name) SELECT sf, count(*) AS n_full, min(lf) AS first_full
FROM inv GROUP BY sf""",
)
def _(s, d):
    inv = table(s, d, "part").select(F.array_join(F.transform(F.slice(F.split("p_name", " "), 1, 2), lambda w: F.left(w, F.lit(1))), "").alias("sf"), F.col("p_name").alias("lf")).distinct()
    return inv.groupBy("sf").agg(F.count("*").alias("n_full"), F.min("lf").alias("first_full"))


@query(
    "header_expansions",
    """SELECT 'micro alb' AS header, a || ' ' || b AS expansion FROM (VALUES ('micro'), ('microscopic')) x(a), (VALUES ('albumin'), ('albino')) y(b)""",
)
def _(s, d):
    h = s.createDataFrame([("micro alb", [["micro", "microscopic"], ["albumin", "albino"]])], "header string, options array<array<string>>")
    product = F.aggregate("options", F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda x: F.btrim(F.concat_ws(" ", a, x))))))
    return h.select("header", F.explode(product).alias("expansion"))


@query(
    "cosine_topk",
    """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS tgt, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT src, tgt, sim, k FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, tgt) AS k FROM p) WHERE k <= 5""",
)
def _(s, d):
    """Queries are the ids divisible by 50, against all vectors, in blocks: each batch of vectors meets all queries at once and keeps its best."""
    e = table(s, d, "embeddings")
    return M.nearest(e.where("vec_id % 50 = 0"), e, 5)


@query(
    "tfidf_similarity",
    """WITH t AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token
FROM benchmark) GROUP BY ALL), f AS (SELECT token, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf
FROM t GROUP BY token), w AS (SELECT item_id, token, tf * idf AS x FROM t JOIN f USING (token)), n AS (SELECT item_id, sqrt(sum(x * x)) AS z
FROM w GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, round(sum(a.x * b.x) / any_value(na.z) / any_value(nb.z), 5) AS sim
FROM w a JOIN w b ON a.token = b.token AND a.item_id < b.item_id JOIN n na ON na.item_id = a.item_id
JOIN n nb ON nb.item_id = b.item_id GROUP BY 1, 2""",
)
def _(s, d):
    items = table(s, d, "benchmark")
    t = M.postings(items, "item_id", "text", ())
    f = t.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(items.agg(F.count("*").alias("n")))).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = t.join(f, "token").select("entity", "token", (F.col("tf") * F.col("idf")).alias("x"))
    w = w.join(w.groupBy("entity").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("z")), "entity").select("entity", "token", (F.col("x") / F.col("z")).alias("x"))
    return w.alias("a").join(w.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.entity") < F.col("b.entity"))).groupBy(F.col("a.entity").alias("a"), F.col("b.entity").alias("b")).agg(F.round(F.sum(F.col("a.x") * F.col("b.x")), 5).alias("sim"))


@query(
    "alignment_prf",
    """WITH p AS (SELECT doc_id FROM documents WHERE contains(text, '|') OR contains(text, '&&')), r AS (SELECT doc_id
FROM labels WHERE quality = 0), x AS (SELECT (SELECT count(*) FROM p WHERE doc_id IN (SELECT doc_id
FROM r)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM r) AS nr) SELECT tp, round(tp / np, 3) AS precision, round(tp / nr, 3) AS
recall, round(2 * (tp / np) * (tp / nr) / (tp / np + tp / nr), 3) AS f1 FROM x""",
)
def _(s, d):
    p = table(s, d, "documents").where("contains(text, '|') or contains(text, '&&')").select("doc_id")
    return M.precision_recall(p, table(s, d, "labels").where("quality = 0").select("doc_id"), ["doc_id"])


@query(
    "hits_mrr",
    _PJ + """ SELECT round(avg((bes_rank <= 1)::INT), 3) AS hits1, round(avg((bes_rank <= 5)::INT), 3) AS hits5, round(avg(1 / bes_rank), 3) AS mrr
FROM rk WHERE pj_rank = 1""",
)
def _(s, d):
    r = F.col("bes_rank")
    return _ranked(s, d).where("pj_rank = 1").agg(F.round(F.avg((r <= 1).cast("int")), 3).alias("hits1"), F.round(F.avg((r <= 5).cast("int")), 3).alias("hits5"), F.round(F.avg(1 / r), 3).alias("mrr"))


@query(
    "synonym_pairs",
    """SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_brand, p_type, p_size, p_name
FROM part) a JOIN (SELECT DISTINCT p_brand, p_type, p_size, p_name FROM part) b USING (p_brand, p_type, p_size)""",
)
def _(s, d):
    g = table(s, d, "part").select("p_brand", "p_type", "p_size", "p_name").distinct()
    return g.alias("x").join(g.alias("y"), ["p_brand", "p_type", "p_size"]).select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b")).distinct()


@query("nonsynonym_minus", "SELECT DISTINCT p_name AS a FROM part WHERE p_size > 25 EXCEPT SELECT p_name FROM part WHERE p_size <= 3")
def _(s, d):
    p = table(s, d, "part")
    return p.where("p_size > 25").select(F.col("p_name").alias("a")).distinct().join(p.where("p_size <= 3").select(F.col("p_name").alias("a")), "a", "left_anti")


@query("split_90_10", "SELECT CASE WHEN (p_partkey * 2654435761) % 1000 < 900 THEN 'train' ELSE 'val' END AS part, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return table(s, d, "part").groupBy(F.when((F.col("p_partkey") * 2654435761) % 1000 < 900, "train").otherwise("val").alias("part")).agg(F.count("*").alias("n"))


# --- personal data ---------------------------------------------------------------------------------

_TAXONOMY = (("Email", "Contact"), ("Contact", "PersonalData"), ("Health", "SpecialCategoryPersonalData"), ("SpecialCategoryPersonalData", "PersonalData"), ("Name", "Identifying"), ("Identifying", "PersonalData"), ("Colour", "Thing"))
_MATCHES = (("customer", "c_name", "Name"), ("customer", "c_mail", "Email"), ("customer", "c_mail", "Contact"), ("patient", "diagnosis", "Health"), ("part", "p_colour", "Colour"))
_PII_SQL = "WITH RECURSIVE e AS (SELECT * FROM (VALUES " + ", ".join(map(str, _TAXONOMY)) + ") t(child, parent)), m AS (SELECT * FROM (VALUES " + ", ".join(map(str, _MATCHES)) + ') t("table", "column", match)), cl AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT node, parent FROM cl JOIN e ON ancestor = child), rc AS (SELECT * FROM cl UNION SELECT child, child FROM e UNION SELECT parent, parent FROM e)'


def _pii(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return H.closure(s.createDataFrame(_TAXONOMY, "child string, parent string")), s.createDataFrame(_MATCHES, "table string, column string, match string")


@query(
    "pii_flags",
    _PII_SQL + """ SELECT "table", "column", bool_or(ancestor = 'PersonalData') AS is_personal, bool_or(ancestor = 'Identifying') AS is_identifying, bool_or(ancestor =
'SpecialCategoryPersonalData') AS is_special FROM m JOIN rc ON match = node GROUP BY ALL""",
)
def _(s, d):
    return kg.pii_flags(*_pii(s))


@query("pii_cleanup", _PII_SQL + ' SELECT DISTINCT a."table", a."column", a.match FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b JOIN cl ON cl.node = b.match AND cl.ancestor = a.match WHERE a."table" = b."table" AND a."column" = b."column")')
def _(s, d):
    return kg.most_specific(*_pii(s))


@query(
    "pii_append_notified",
    _PII_SQL + """ SELECT DISTINCT "table", "column", true AS is_personal FROM m WHERE match <> 'Colour' UNION SELECT 'orders', c, true
FROM (VALUES ('o_custkey'), ('o_clerk'), ('o_status')) v(c) WHERE c LIKE '%key' OR c LIKE '%clerk'""",
)
def _(s, d):
    flags = kg.pii_flags(*_pii(s)).where("is_personal").select("table", "column", "is_personal")
    columns = s.createDataFrame([("orders", "o_custkey"), ("orders", "o_clerk"), ("orders", "o_status"), ("customer", "c_name")], "table string, column string")
    return kg.append_notified(flags, columns, s.createDataFrame([("key",), ("clerk",), ("name",)], "suffix string"))


@query("pii_group_sources", _PII_SQL + ' SELECT "column" AS dataset_element, string_agg(DISTINCT "table", \',\' ORDER BY "table") AS sources, string_agg(DISTINCT match, \',\' ORDER BY match) AS matches FROM m GROUP BY 1')
def _(s, d):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return _pii(s)[1].groupBy(F.col("column").alias("dataset_element")).agg(joined("table").alias("sources"), joined("match").alias("matches"))


@query(
    "notification_stream",
    """WITH n AS (SELECT 'file' || conv_id % 7 AS filename, conv_id || '-' || turn AS metadata_id, role, conv_id * 1000 + turn AS seq, 't' || turn % 3 AS t FROM conversations)
SELECT filename, arg_max(metadata_id, seq) AS metadata_id, arg_max(role, seq) AS domain, max(seq) AS seq, count(*) AS n_seen, string_agg(DISTINCT t, ',' ORDER BY t) AS tables, coalesce(string_agg(DISTINCT role, ',') FILTER (role = 'user'), '') AS piis FROM n GROUP BY 1""",
)
def _(s, d):
    """The state after the last micro-batch; the id before it depends on how notifications fall into batches, so it isn't compared."""
    from graphloom.streaming.notifications import demo

    got = demo(s, table(s, d, "conversations"))
    return got.select("filename", "metadata_id", "domain", "seq", "n_seen", F.array_join("tables", ",").alias("tables"), F.array_join("piis", ",").alias("piis"))


# Further queries register themselves.
from graphloom.plans import abbreviations, alignment, corpora, dicom, documents, json, more, ontology, pii, refine, rows, schema, selection, values  # noqa: E402, F401
