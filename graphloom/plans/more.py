"""Queries of what refines the operators of other modules: entities of images, moved domains and ranges, the exact mapper, groups of synonyms, compatible classes, hashed splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import alignment as A, corpora as C, dicom as D, hierarchy as H, matching as M, refine as R, selection as S
from graphloom.registry import query, table, union


def _name(p, c):
    return F.concat(F.lit(p), c.cast("string"))


def _image_tags(s, d):
    k = F.col("o_custkey") % 50
    o = table(s, d, "orders").select(_name("f", k).alias("file"), k.alias("k"), "o_orderpriority").distinct()
    top = F.array().cast("array<string>")
    uid = o.select("file", top.alias("path"), F.lit("(0008,0016)").alias("code"), F.lit("SOP Class").alias("name"), _name("uid", F.col("k") % 3).alias("value")).distinct()
    return uid.unionByName(o.select("file", top.alias("path"), F.concat(F.lit("(0010,"), F.left("o_orderpriority", F.lit(1)), F.lit(")")).alias("code"), F.concat(F.lit("N"), F.left("o_orderpriority", F.lit(1))).alias("name"), F.col("o_orderpriority").alias("value")))


def _image_ontology(s):
    """Three image classes; class k has the entities e<k> and shared by the operands of an intersection; class 2 has no equivalence."""
    rows = []
    for k in range(3):
        rows.append((f"img{k}", "hasSOPClassUID", f"uid{k}"))
        if k < 2:
            rows.append((f"img{k}", "owl:equivalentClass", f"_:w{k}"))
            for e in (f"e{k}", "shared"):
                rows += [(f"_:w{k}", "owl:intersectionOf", f"_:{k}{e}"), (f"_:{k}{e}", "owl:onClass", e)]
    return s.createDataFrame(rows, "s string, p string, o string")


_K = "k AS (SELECT DISTINCT o_custkey % 50 AS k FROM orders)"


@query(
    "image_entities",
    f"""WITH {_K} SELECT 'f' || k AS file, 'img' || k % 3 AS cls, unnest(CASE WHEN k % 3 < 2 THEN ['e' || k % 3, 'shared', 'img' || k % 3, '#Unknown'] ELSE
['img2', '#Unknown'] END) AS entity FROM k""",
)
def _(s, d):
    return D.entities_of(_image_tags(s, d), _image_ontology(s)).select("file", "cls", "entity")


@query(
    "image_tag_entities",
    """WITH t AS (SELECT DISTINCT o_custkey % 50 AS k, left(o_orderpriority, 1) AS p FROM orders)
SELECT 'f' || k AS file, '(0010,' || p || ')' AS code, CASE WHEN p IN ('1', '2') THEN CASE WHEN k % 3 = 0 THEN 'e0' WHEN k % 3 = 1 THEN 'shared' END WHEN p = '3' AND k % 3 = 2 THEN 'img2' END AS entity FROM t
UNION ALL SELECT DISTINCT 'f' || k, '(0008,0016)', NULL FROM t""",
)
def _(s, d):
    """Domains of two priorities by their codes, of a third by its name."""
    tags = _image_tags(s, d)
    code = s.createDataFrame([(f"(0010,{p})", x) for p in "12" for x in ("e0", "shared")], "code string, domain string")
    name = s.createDataFrame([("N3", "img2"), ("N1", "#Unknown")], "name string, domain string")
    return D.tag_entities(tags, D.entities_of(tags, _image_ontology(s)), code, name)


@query(
    "image_item_rules",
    """SELECT p_type AS "column", 'hasItem>' || CASE WHEN p_type < 'M' THEN replace(any_value(p_type || ' Tag'), ' ', '') || 'Item' ELSE p_type || 'Item' END
AS path FROM part GROUP BY p_type""",
)
def _(s, d):
    c = table(s, d, "part").select(F.col("p_type").alias("column"), F.concat("p_type", F.lit(" Tag")).alias("tag")).distinct()
    known = c.where("column < 'M'").select(F.concat("column", F.lit("TagItem")).alias("cls"))
    return D.item_rules(c, known)[0].select("column", F.array_join("path", ">").alias("path"))


@query(
    "image_item_tables",
    """SELECT DISTINCT p_type || 'Item' AS "table", p_type || 'Item' AS element, 'SequenceItem' AS match
FROM part WHERE p_type >= 'M' UNION ALL SELECT x, x, x FROM (VALUES ('InformationEntity'), ('InformationObjectDefinition')) v(x)""",
)
def _(s, d):
    c = table(s, d, "part").select(F.col("p_type").alias("column"), F.concat("p_type", F.lit(" Tag")).alias("tag")).distinct()
    return D.item_rules(c, c.where("column < 'M'").select(F.concat("column", F.lit("TagItem")).alias("cls")))[1]


@query("first_dictionary_names", "SELECT o_custkey AS code, arg_min(o_orderstatus, o_orderkey) AS name FROM orders GROUP BY 1")
def _(s, d):
    return D.first_names(table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("position")))


_P = """p AS (SELECT DISTINCT p_type AS prop, p_brand AS cls FROM part), u AS (SELECT prop, '_:u' || prop AS node, cls FROM p),
t AS (SELECT prop AS s, 'rdfs:domain' AS p, node AS o FROM u UNION SELECT node, 'owl:unionOf', cls FROM u UNION SELECT cls, 'rdfs:subClassOf', '_:r' || cls || prop FROM u UNION SELECT '_:r' || cls || prop, 'owl:onProperty', prop FROM u
UNION SELECT '_:r' || cls || prop, 'owl:someValuesFrom', 'xsd:string' FROM u UNION SELECT prop, 'rdfs:range', 'xsd:string' FROM u UNION SELECT 'single', 'rdfs:domain', 'Brand#1')"""


def _properties(s, d):
    u = table(s, d, "part").select(F.col("p_type").alias("prop"), F.col("p_brand").alias("cls")).distinct().select("prop", "cls", F.concat(F.lit("_:u"), "prop").alias("node"), F.concat(F.lit("_:r"), "cls", "prop").alias("r"))
    t = lambda a, p, b: u.select(a.alias("s"), F.lit(p).alias("p"), b.alias("o"))
    c = F.col
    rows = [t(c("prop"), "rdfs:domain", c("node")), t(c("node"), "owl:unionOf", c("cls")), t(c("cls"), "rdfs:subClassOf", c("r")), t(c("r"), "owl:onProperty", c("prop")), t(c("r"), "owl:someValuesFrom", F.lit("xsd:string")), t(c("prop"), "rdfs:range", F.lit("xsd:string"))]
    return union([*rows, s.createDataFrame([("single", "rdfs:domain", "Brand#1")], "s string, p string, o string")]).distinct()


@query(
    "moved_domains",
    f"""WITH {_P}, c AS (SELECT DISTINCT prop, 'Brand#1' AS old FROM p WHERE cls = 'Brand#1' AND prop < 'M' UNION ALL SELECT 'single', 'Brand#1')
SELECT DISTINCT CASE WHEN p = 'rdfs:subClassOf' AND s = 'Brand#1' AND EXISTS (SELECT 1 FROM c WHERE t.o = '_:rBrand#1' || c.prop) THEN 'Place' ELSE s END AS s, p,
CASE WHEN p = 'owl:unionOf' AND o = 'Brand#1' AND EXISTS (SELECT 1 FROM c WHERE t.s = '_:u' || c.prop) THEN 'Place' WHEN s = 'single' THEN 'Place' ELSE o END AS o FROM t""",
)
def _(s, d):
    t = _properties(s, d)
    changes = t.where("p = 'rdfs:domain' and (s < 'M' or s = 'single')").select(F.col("s").alias("prop"), F.lit("Brand#1").alias("old"), F.lit("Place").alias("new")).distinct()
    return R.moved_domains(t, changes)


@query(
    "changed_ranges",
    f"""WITH {_P} SELECT s, p, CASE WHEN o = 'xsd:string' AND (s < 'M' OR EXISTS (SELECT 1 FROM p WHERE t.s = '_:r' || cls || prop
AND prop < 'M')) THEN 'xsd:integer' ELSE o END AS o FROM t""",
)
def _(s, d):
    t = _properties(s, d)
    return R.changed_ranges(t, t.where("p = 'rdfs:range' and s < 'M'").select(F.col("s").alias("prop"), F.lit("xsd:integer").alias("range")))


@query(
    "exact_mapper",
    """WITH b AS (SELECT 'class' AS kind, p_type AS tgt, p_name AS label, 1.0 AS score FROM part UNION SELECT 'dataProperty', p_type, p_name, CASE WHEN p_type < 'M' THEN 0.5 ELSE 1.0 END FROM part),
a AS (SELECT 'class' AS kind, 'c' || p_brand AS src, p_name AS label FROM part UNION SELECT 'dataProperty', 'd' || p_brand, p_name FROM part)
SELECT src, arg_min(tgt, (-score, tgt)) AS tgt, max(score)::DOUBLE AS score FROM a JOIN b USING (kind, label) GROUP BY src""",
)
def _(s, d):
    p = table(s, d, "part")
    both = lambda e: union([p.select(F.lit(k).alias("kind"), e(k).alias("entity"), F.col("p_name").alias("label")) for k in ("class", "dataProperty")]).distinct()
    return M.exact_mapper(both(lambda k: F.concat(F.lit(k[0]), "p_brand")), both(lambda k: F.col("p_type")), p.where("p_type >= 'M'").select(F.col("p_type").alias("entity")))


@query(
    "synonym_groups",
    """WITH RECURSIVE l AS (SELECT DISTINCT p_partkey // 3 AS e, p_name AS x FROM part WHERE p_partkey % 7 < 2), r AS (SELECT x AS a, x AS b
FROM l UNION SELECT r.a, y.x FROM r JOIN l ON l.x = r.b JOIN l y USING (e)) SELECT a AS label, min(b) AS grp
FROM r GROUP BY 1""",
)
def _(s, d):
    return M.synonym_groups(table(s, d, "part").where("p_partkey % 7 < 2").select(F.expr("p_partkey div 3").alias("entity"), F.col("p_name").alias("label")).distinct())


@query("inventory_groups", "SELECT left(p_name, 3) AS sf, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS lfs FROM part GROUP BY 1")
def _(s, d):
    return M.inventory_groups(table(s, d, "part").select(F.left("p_name", F.lit(3)).alias("sf"), F.col("p_name").alias("lf"))).select("sf", F.array_join("lfs", ",").alias("lfs"))


@query(
    "digest_split",
    """SELECT CASE WHEN ('0x' || substr(md5(p_partkey || '|0'), 1, 8))::BIGINT % 10000 < 9000 THEN 'train' ELSE 'val' END AS part, count(*) AS n
FROM part GROUP BY 1""",
)
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("k"))
    return M.split_by_hash(rows, ["k"]).groupBy("part").agg(F.count("*").alias("n"))


@query(
    "compatible_classes",
    """WITH n AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation), rel AS (SELECT c AS x, p AS y FROM n UNION SELECT p, c FROM n UNION SELECT c, c FROM n UNION SELECT p, p FROM n),
u AS (SELECT 'u' || n_regionkey AS node, 'n' || n_nationkey AS m FROM nation WHERE n_nationkey % 2 = 0), l AS (SELECT node AS x, y FROM rel JOIN u ON x = m),
o AS (SELECT DISTINCT 'n' || c_nationkey AS x, 'n' || (c_custkey % 25) AS y FROM customer), a AS (SELECT 'n' || n_nationkey AS x, 'n' || ((n_nationkey + 1) % 25) AS y FROM nation)
SELECT x, y FROM rel UNION SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT x, y FROM o WHERE NOT EXISTS (SELECT 1 FROM a WHERE (a.x = o.x AND a.y = o.y) OR (a.x = o.y AND a.y = o.x))""",
)
def _(s, d):
    n = table(s, d, "nation")
    child, parent = _name("n", F.col("n_nationkey")), _name("r", F.col("n_regionkey"))
    closed = H.closure(n.select(child.alias("child"), parent.alias("parent")))
    unions = n.where("n_nationkey % 2 = 0").select(_name("u", F.col("n_regionkey")).alias("node"), child.alias("member"))
    others = table(s, d, "customer").select(_name("n", F.col("c_nationkey")).alias("x"), _name("n", F.col("c_custkey") % 25).alias("y")).distinct()
    return S.compatible(closed, unions, n.select(child.alias("x"), _name("n", (F.col("n_nationkey") + 1) % 25).alias("y")), others)


@query(
    "used_properties",
    """WITH n AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p, n_nationkey AS k FROM nation), cl AS (SELECT c AS node, p AS up FROM n UNION SELECT c, c FROM n UNION SELECT p, p FROM n),
r AS (SELECT DISTINCT p AS cls, 'above' || p AS prop FROM n), pc AS (SELECT DISTINCT 'own' || p AS prop, 'above' || p AS up FROM n UNION SELECT DISTINCT 'above' || p, 'above' || p FROM n UNION SELECT DISTINCT 'own' || p, 'own' || p FROM n)
SELECT cl.node AS cls, pc.prop FROM cl JOIN r ON r.cls = cl.up JOIN pc ON pc.up = r.prop UNION SELECT c, 'd' || k FROM n WHERE k % 3 = 0 UNION SELECT p, 'd' || k FROM n WHERE k % 3 = 0""",
)
def _(s, d):
    n = table(s, d, "nation")
    child, parent = _name("n", F.col("n_nationkey")), _name("r", F.col("n_regionkey"))
    closed = H.closure(n.select(child.alias("child"), parent.alias("parent")))
    up = n.select(parent.alias("p")).distinct()
    restrictions = up.select(F.col("p").alias("cls"), F.concat(F.lit("above"), "p").alias("prop"))
    properties = H.closure(up.select(F.concat(F.lit("own"), "p").alias("child"), F.concat(F.lit("above"), "p").alias("parent")))
    domains = n.where("n_nationkey % 3 = 0").select(_name("d", F.col("n_nationkey")).alias("prop"), child.alias("domain"))
    return S.used_properties(restrictions, domains, closed, properties, S.related(closed))


@query("mixed_pools", "SELECT DISTINCT 'c' || c_custkey AS src, true AS enough FROM customer")
def _(s, d):
    """Negatives from several pools together, without the references."""
    c, n = table(s, d, "customer"), table(s, d, "nation")
    refs = c.select(_name("c", F.col("c_custkey")).alias("src"), _name("n", F.col("c_nationkey")).alias("tgt"))
    edges = n.select(_name("n", F.col("n_nationkey")).alias("child"), _name("r", F.col("n_regionkey")).alias("parent"))
    pool = C.POOLS["random"](refs, n.select(_name("n", F.col("n_nationkey")).alias("node")), 6).unionByName(C.POOLS["neighbour"](refs, edges, 2)).distinct()
    got = C.negatives_of(refs, pool, H.closure(edges), 4)
    bad = got.join(refs.select("src", F.col("tgt").alias("cand")), ["src", "cand"], "left_semi")
    return got.join(bad.select("src"), "src", "left_anti").groupBy("src").agg((F.count("*") == 4).alias("enough"))


@query(
    "tokenizer_switch",
    """SELECT p_partkey, len(string_split(lower(p_name), ' ')) AS words, length(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) AS characters
FROM part""",
)
def _(s, d):
    n = lambda t: F.size(A.TOKENIZERS[t](F.col("p_name"))).cast("long").alias(t)
    return table(s, d, "part").select("p_partkey", n("words"), n("characters"))
