"""Queries of sources and sinks: each writes to a folder of its own or builds its documents from tables, and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import config as G
from graphloom.operators import contexts as H, corpora as C
from graphloom.operators.kg import BASE
from graphloom.registry import _graph, _graph_sql, query, table
from graphloom.session import fresh_dir
from graphloom.sinks import files as S, messages as M
from graphloom.sources import documents as D, mappings, rdf


@query(
    "table_round_trip",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || chr(10) || '"x", ' || p_brand AS text,
CASE WHEN p_size % 2 = 0 THEN '' END AS blank FROM part""",
)
def _(s, d):
    folder = fresh_dir(s, "table")
    S.write_table(table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit('\n"x", '), "p_brand").alias("text"), F.when(F.col("p_size") % 2 == 0, "").alias("blank")), folder)
    return S.read_table(s, folder)


@query("graph_round_trip", f"SELECT s, p, o, o_kind, datatype FROM ({_graph_sql(('nation', 'customer'))})")
def _(s, d):
    folder = fresh_dir(s, "graph")
    S.write_graph(_graph(s, d, ("nation", "customer")), folder)
    return mappings.read_triples(s, folder).select("s", "p", "o", "o_kind", "datatype")


@query("graph_by_table", "SELECT 'nation' AS src_table, 2 * count(*) AS n FROM nation UNION ALL SELECT 'region', 2 * count(*) FROM region")
def _(s, d):
    folder = fresh_dir(s, "graph")
    t = lambda name, k: table(s, d, name).select(F.concat(F.lit(BASE), F.lit(name), F.col(k).cast("string")).alias("s"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("p"), F.lit("x").alias("o"), F.lit("lit").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(name).alias("src_table"))
    S.write_graph(t("nation", "n_nationkey").unionByName(t("region", "r_regionkey")), folder, "src_table")
    return s.read.text(folder).groupBy("src_table").agg(F.count("*").alias("n"))


@query("turtle_round_trip", f"SELECT s, p, o, o_kind FROM ({_graph_sql(('nation',))})")
def _(s, d):
    folder = fresh_dir(s, "turtle")
    S.write_turtle(_graph(s, d, ("nation",)).select("s", F.concat(F.lit("urn:p:"), "p").alias("p"), "o", "o_kind", F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")), folder, {"g": BASE, "p": "urn:p:"})
    got = rdf.read_graph(s, folder)
    return got.where("s is not null").select("s", F.replace("p", F.lit("urn:p:"), F.lit("")).alias("p"), "o", "o_kind")


@query(
    "rdf_xml_scan",
    """SELECT 'http://x/#n' || n_nationkey AS s, 'subClassOf' AS p, 'http://x/r' || n_regionkey AS o FROM nation
UNION ALL SELECT 'http://x/#n' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'http://x/#n' || n_nationkey, 'type',
'http://www.w3.org/2002/07/owl#Class' FROM nation""",
)
def _(s, d):
    one = F.concat(F.lit('<owl:Class rdf:about="#n'), F.col("n_nationkey").cast("string"), F.lit('"><rdfs:subClassOf rdf:resource="http://x/r'), F.col("n_regionkey").cast("string"), F.lit('"/><rdfs:label xml:lang="en">'), "n_name", F.lit("</rdfs:label></owl:Class>"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://x/">'
    files = table(s, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit(head), F.array_join(F.collect_list(one), ""), F.lit("</rdf:RDF>")).alias("text"))
    got = rdf.parsed(files.select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string"), F.lit(".owl")).alias("path"), "text"))
    return got.select("s", F.regexp_extract("p", "#(.*)$", 1).alias("p"), "o")


@query("graph_union", f"SELECT s, p, o, o_kind, datatype FROM ({_graph_sql(('nation', 'customer'))})")
def _(s, d):
    return S.merged(_graph(s, d, ("nation",)), _graph(s, d, ("nation", "customer")))


@query("json_documents", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS name FROM part")
def _(s, d):
    rows = S.as_json(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name")))
    told = F.contains("value", F.lit('"name"'))
    return rows.where(told).select(F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey"), F.get_json_object("value", "$.name").alias("name"))


@query("json_file_scan", "SELECT 'n' || n_regionkey AS file, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def _(s, d):
    """Files of objects on lines, which is no valid JSON as a whole, written, read and repaired."""
    folder = fresh_dir(s, "json")
    n = table(s, d, "nation")
    names = sorted(r.n_regionkey for r in n.select("n_regionkey").distinct().collect())
    for k in names:
        n.where(F.col("n_regionkey") == k).select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).coalesce(1).write.text(f"{folder}/n{k}")
    each = D.read_json_files(s, folder).select(F.regexp_extract("path", r"/(n\d+)/[^/]*$", 1).alias("file"), F.explode(F.from_json("text", "array<struct<n_name:string>>")).alias("x"))
    return each.groupBy("file").agg(F.count("*").alias("n"), F.min("x.n_name").alias("first"))


@query("files_listed", "SELECT 3 AS files, true AS some")
def _(s, d):
    folder = fresh_dir(s, "files")
    for k in range(3):
        table(s, d, "nation").coalesce(1).write.csv(f"{folder}/{k}/deep")
    found = D.list_files(s, folder, ".csv")
    return found.agg(F.count("*").alias("files"), (F.min("length") > 0).alias("some"))


@query("mappings_resumed", "SELECT DISTINCT p_name AS src FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 5)")
def _(s, d):
    folder = fresh_dir(s, "mappings")
    p = table(s, d, "part")
    S.write_mappings(p.where("p_size < 5").select(F.col("p_name").alias("src"), F.col("p_type").alias("tgt"), F.lit(1.0).alias("score")), folder)
    return S.unfinished(p.select(F.col("p_name").alias("src")).distinct(), folder)


@query(
    "corpus_written",
    """SELECT 'synonyms' AS kind, (SELECT count(*) FROM (SELECT DISTINCT a.p_name, b.p_name FROM (SELECT DISTINCT p_brand, p_name
FROM part) a JOIN (SELECT DISTINCT p_brand, p_name FROM part) b USING (p_brand))) AS n""",
)
def _(s, d):
    folder = fresh_dir(s, "corpus")
    labels = table(s, d, "part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("label")).distinct()
    S.write_corpus(C.corpus([C.synonyms(labels)], [C.synonyms(labels)]), folder)
    return s.read.json(f"{folder}/summary").select("kind", "n")


@query(
    "score_lines",
    """SELECT l_orderkey || ',' || string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS line
FROM lineitem GROUP BY l_orderkey""",
)
def _(s, d):
    position = F.struct("l_linenumber", "l_partkey", "l_quantity")
    return S.score_lines(table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("src"), position.alias("position"), F.col("l_quantity").cast("long").alias("score")))


@query("mapping_report", "SELECT p_brand AS \"Table\", p_type AS \"Column\", CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS \"Match\" FROM part")
def _(s, d):
    m = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("http://x/y#"), "p_name")))
    return S.mapping_report(table(s, d, "part").select(F.col("p_brand").alias("table"), F.col("p_type").alias("column"), m.alias("match")))


@query("cached_rows", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    folder = fresh_dir(s, "cache")
    make = lambda: table(s, d, "nation").select("n_nationkey", "n_name")
    S.cached(s, folder, make)
    return S.cached(s, folder, lambda: table(s, d, "part"))


@query("cached_vectors", "SELECT vec_id::VARCHAR AS text, len(embedding) AS n FROM embeddings")
def _(s, d):
    """Half of the vectors are there already; only the others are made."""
    folder = fresh_dir(s, "vectors")
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("v"), "vec_id")
    embed = lambda new: new.join(e, "text")
    H.cached_vectors(s, folder, e.where("vec_id % 2 = 0"), embed)
    return H.cached_vectors(s, folder, e, embed).select("text", F.size("v").cast("long").alias("n"))


@query("results_reused", "SELECT true AS whole, false AS more")
def _(s, d):
    h = table(s, d, "part").select(F.col("p_name").alias("header"))
    more = h.unionByName(s.createDataFrame([("another",)], "header string"))
    return s.createDataFrame([(H.all_known(h, h), H.all_known(more, h))], "whole boolean, more boolean")


@query("inventory_by_letter", "SELECT DISTINCT left(p_name, 2) AS sf, p_name AS lf FROM part WHERE lower(left(p_name, 1)) IN (SELECT lower(left(p_type, 1)) FROM part)")
def _(s, d):
    folder = fresh_dir(s, "inventory")
    p = table(s, d, "part")
    H.write_inventory(p.select(F.left("p_name", F.lit(2)).alias("sf"), F.col("p_name").alias("lf")).distinct(), folder)
    return H.read_inventory(s, folder, p.select(F.array("p_type").alias("entries")))


@query("inventory_scan", "SELECT DISTINCT left(p_name, 2) AS sf, p_name AS lf FROM part UNION SELECT DISTINCT left(p_name, 2), left(p_name, 2) FROM part")
def _(s, d):
    folder = fresh_dir(s, "inventory")
    table(s, d, "part").select(F.left("p_name", F.lit(2)).alias("SF"), F.col("p_name").alias("LF")).distinct().write.option("header", True).option("sep", "|").csv(folder)
    return D.read_inventory(s, folder, True)


@query(
    "expansions_scan",
    """SELECT DISTINCT p_brand AS header, lower(p_brand) AS tokenised, k - 1 AS rank, p_brand || ' ' || k AS expansion
FROM part, range(1, 3) r(k) UNION ALL SELECT 'none', 'none', NULL, NULL""",
)
def _(s, d):
    cand = lambda k: F.struct(F.concat("p_brand", F.lit(f" {k}")).alias("headerFF"), F.lit(k - 1).alias("rank"), F.lit(0.5).alias("localScore"))
    one = F.struct(F.lower("p_brand").alias("tokenised"), F.array("p_brand").alias("abbrevs"), F.array(cand(1), cand(2)).alias("headerCands"))
    doc = table(s, d, "part").select("p_brand").distinct().select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array(one))).alias("text"))
    rows = D.expansions(doc.union(s.createDataFrame([('{"none": {"tokenised": "none", "abbrevs": [], "headerCands": []}}',)], "text string")))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(
    "mapping_document_scan",
    """SELECT p_brand AS "table", p_type AS "column", 'class' AS type, 'ex/' || p_type AS element, string_agg(DISTINCT p_name, ','
ORDER BY p_name) AS match, false AS is_pii FROM part GROUP BY ALL UNION ALL SELECT DISTINCT p_brand, NULL, 'class', 'ex/' || p_brand, '', false
FROM part""",
)
def _(s, d):
    none = F.array().cast("array<string>")
    m = lambda el, match: F.struct(F.lit("class").alias("type"), F.concat(F.lit("ex/"), el).alias("ontoEl"), match.alias("match"), none.alias("path"))
    columns = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    tables = columns.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_type").alias("column"), F.lit(None).cast("boolean").alias("isPii"), F.array(m(F.col("p_type"), F.col("names"))).alias("mappings"))).alias("columns"))
    doc = tables.select(F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("table"), m(F.col("p_brand"), none).alias("mapping"), "columns")).alias("tables"))).alias("text"))
    return D.mapping_rows(doc).select("table", "column", "type", "element", F.array_join("match", ",").alias("match"), "is_pii")


@query(
    "page_tables",
    """SELECT n_nationkey AS page_id, 'N' || c_custkey AS sf, c_name || ' ' || k AS lf FROM nation JOIN customer ON c_nationkey = n_nationkey, range(1, 3)
r(k)""",
)
def _(s, d):
    """Pages with a table of customers; each second cell has two lines. Tables of other classes and nested ones are passed over."""
    row = F.concat(F.lit("<tr><td> N"), F.col("c_custkey").cast("string"), F.lit("</td><td>"), "c_name", F.lit(" 1<br>"), "c_name", F.lit(" 2</td></tr>"))
    page = table(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("page_id")).agg(F.array_join(F.collect_list(row), "").alias("r"))
    html = F.concat(F.lit("<p>x</p><table class='other'><tr><td>a</td><td>b</td></tr></table><table class='wikitable sortable'><tr><th>Short</th><th>Long</th></tr><tr><td>lone</td></tr>"), "r", F.lit("</table><table class='wikitable'><tr><td>h</td></tr><tr><td>c</td><td>d</td></tr></table>"))
    return D.page_tables(page.select("page_id", html.alias("html")))


@query(
    "image_tag_files",
    """SELECT 'f' || o_orderkey AS file, '' AS path, '00100010' AS tag, 'PN' AS vr, o_orderstatus AS value
FROM orders UNION ALL SELECT 'f' || o_orderkey, '00400275/' || k, '00400007', 'LO', o_orderpriority || k
FROM orders, range(2) r(k)""",
)
def _(s, d):
    o = table(s, d, "orders")
    leaf = lambda vr, v: F.struct(F.lit(vr).alias("vr"), F.array(v).alias("Value"))
    item = lambda k: F.to_json(F.map_from_arrays(F.array(F.lit("00400007")), F.array(leaf("LO", F.concat("o_orderpriority", F.lit(str(k)))))))
    text = F.concat(F.lit('{"00100010":'), F.to_json(leaf("PN", F.col("o_orderstatus"))), F.lit(',"00400275":{"vr":"SQ","Value":['), item(0), F.lit(","), item(1), F.lit("]}}"))
    return D.image_tags(o.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), text.alias("text")))


@query("best_checkpoint", "SELECT 'run/checkpoint-' || c_custkey AS folder, c_acctbal AS metric FROM customer ORDER BY c_acctbal DESC, folder LIMIT 1")
def _(s, d):
    c = table(s, d, "customer")
    return D.best_checkpoint(c.select(F.concat(F.lit("run/checkpoint-"), F.col("c_custkey").cast("string"), F.lit("/trainer_state.json")).alias("path"), F.to_json(F.struct(F.col("c_acctbal").alias("best_metric"))).alias("text")))


@query("messages_published", "SELECT n_name AS value FROM nation")
def _(s, d):
    folder = fresh_dir(s, "messages")
    M.publish(table(s, d, "nation"), M.file_sender(folder.removeprefix("file:")), "n_name", 4)
    return s.read.text(folder)


@query("graph_uploaded", f"SELECT s, p, o FROM ({_graph_sql(('nation',))})")
def _(s, d):
    folder = fresh_dir(s, "upload")
    M.upload(_graph(s, d, ("nation",)), M.file_sender(folder.removeprefix("file:")), 7)
    return mappings.read_triples(s, folder).select("s", "p", "o")


@query(
    "deferred_updates",
    """SELECT 'UPDATE t SET c_nationkey = ''' || c_nationkey || ''' WHERE c_custkey = ''' || c_custkey || '''' AS statement
FROM customer WHERE c_nationkey > 0""",
)
def _(s, d):
    c = table(s, d, "customer").withColumn("c_nationkey", F.expr("nullif(c_nationkey, 0)"))
    return M.updates(c, "t", ["c_custkey"], ["c_nationkey"])


@query("landed_files", "SELECT 2 AS files")
def _(s, d):
    folder = fresh_dir(s, "landing")
    for k in "ab":
        table(s, d, "region").coalesce(1).write.json(f"{folder}/{k}")
    return M.landing(s, folder, ".json").agg(F.count("*").alias("files"))


@query("config_presets", "SELECT 200 AS pool, 20 AS best, 0.85::DOUBLE AS extend, 0.9::DOUBLE AS keep, 'orders' AS dataset, 4 AS properties")
def _(s, d):
    c = G.Config.of('{"dataset": "orders", "domain": "health"}')
    c = G.Config.of(c.with_(depth=3).text())
    a = c.alignment
    return s.createDataFrame([(a.pool, a.best, a.extend, a.keep, c.dataset, len(a.properties))], "pool int, best int, extend double, keep double, dataset string, properties int")


@query(
    "mapper_switch",
    """SELECT p_brand AS src, min(p_type) AS tgt, 1.0::DOUBLE AS score FROM (SELECT DISTINCT p_brand, p_name
FROM part) a JOIN (SELECT DISTINCT p_type, p_name FROM part) b USING (p_name) GROUP BY 1""",
)
def _(s, d):
    label = lambda c: table(s, d, "part").select(F.col(c).alias("entity"), F.col("p_name").alias("label")).distinct()
    return G.mapped("exact", label("p_brand"), label("p_type"), G.preset("default"))


@query(
    "named_aggregates",
    """SELECT p_brand, max(p_size) AS p_size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS p_type, round(avg(p_retailprice), 4) AS p_retailprice
FROM part GROUP BY 1""",
)
def _(s, d):
    rows = G.aggregated(table(s, d, "part"), ["p_brand"], {"p_size": "max", "p_type": "set", "p_retailprice": "mean"})
    return rows.select("p_brand", "p_size", F.array_join("p_type", ",").alias("p_type"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query("dictionary_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    names = G.Dictionary(s.createDataFrame([("O", "Open", "being open"), ("F", "Filled", None), ("O", "Open", "not done")], "code string, name string, label string"))
    return names.named(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(
    "folder_connector",
    """SELECT 'nation' AS "table", unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS "column" UNION ALL
SELECT 'region', unnest(['r_regionkey', 'r_name'])""",
)
def _(s, d):
    return G.FolderConnector(s, d, ["nation", "region"]).catalog()
