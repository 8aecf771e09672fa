"""Queries of training pairs. Labels are the parts' names by brand and type; classes are brands below manufacturers' types."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import corpora as C, hierarchy as H
from graphloom.registry import query, table

#: Labels of an entity: a brand of a type and size. With so many entities each has few labels, and negatives are left without any filter.
_ENTITY = "p_brand || '/' || p_type || '/' || p_size"
_L = f"l AS (SELECT DISTINCT {_ENTITY} AS entity, p_name AS label FROM part), syn AS (SELECT DISTINCT x.label AS a, y.label AS b FROM l x JOIN l y USING (entity))"
_B = "l AS (SELECT DISTINCT p_brand AS entity, p_name AS label FROM part), syn AS (SELECT DISTINCT x.label AS a, y.label AS b FROM l x JOIN l y USING (entity))"
_E = "e AS (SELECT DISTINCT p_type AS parent, p_brand AS child FROM part)"
_BELOW = f"e AS (SELECT DISTINCT p_type AS parent, {_ENTITY} AS child FROM part)"


def _entity():
    return F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))


def _labels(s, d, entity=None):
    return table(s, d, "part").select((F.col("p_brand") if entity is None else entity).alias("entity"), F.col("p_name").alias("label")).distinct()


def _edges(s, d, child=None):
    return table(s, d, "part").select((F.col("p_brand") if child is None else child).alias("child"), F.col("p_type").alias("parent")).distinct()


@query(
    "soft_negatives",
    f"""WITH {_L}, o AS (SELECT *, row_number() OVER (ORDER BY md5(entity || '|' || label || '|0')) - 1 AS i, count(*) OVER () AS n FROM l)
SELECT DISTINCT x.label AS a, y.label AS b FROM (SELECT *, unnest([1, 2]) AS k FROM o) x JOIN o y ON y.i = (x.i + k) % x.n
WHERE x.entity <> y.entity AND NOT EXISTS (SELECT 1 FROM syn WHERE syn.a = x.label AND syn.b = y.label)""",
)
def _(s, d):
    return C.soft_negatives(_labels(s, d, _entity()), 2)


@query(
    "hard_negatives",
    f"""WITH {_L}, {_BELOW}, o AS (SELECT parent, entity, label, row_number() OVER (PARTITION BY parent ORDER BY md5(entity || '|' || label || '|0')) AS i FROM e JOIN l ON child = entity)
SELECT DISTINCT x.label AS a, y.label AS b FROM (SELECT *, unnest([1, 2]) AS k FROM o) x JOIN o y ON x.parent = y.parent AND y.i = x.i + x.k
WHERE x.entity <> y.entity AND NOT EXISTS (SELECT 1 FROM syn WHERE syn.a = x.label AND syn.b = y.label)""",
)
def _(s, d):
    return C.hard_negatives(_labels(s, d, _entity()), _edges(s, d, _entity()), 2)


@query(
    "cross_synonyms",
    f"""WITH m AS (SELECT DISTINCT {_ENTITY} AS src, s_suppkey AS tgt FROM part JOIN supplier ON p_size = s_suppkey), a AS (SELECT DISTINCT {_ENTITY} AS e, p_name FROM part),
x AS (SELECT a.p_name AS a, s_name AS b FROM m JOIN a ON src = e JOIN supplier ON tgt = s_suppkey WHERE a.p_name <> s_name) SELECT a, b FROM x UNION SELECT b, a FROM x""",
)
def _(s, d):
    supplier = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_name").alias("label"), "s_suppkey")
    maps = table(s, d, "part").join(supplier, F.col("p_size") == F.col("s_suppkey")).select(_entity().alias("src"), F.col("entity").alias("tgt")).distinct()
    return C.cross_synonyms(maps, _labels(s, d, _entity()), supplier.select("entity", "label"))


@query(
    "pair_corpus",
    f"""WITH {_B}, neg AS (SELECT DISTINCT x.label AS a, y.label AS b FROM l x JOIN l y ON x.entity < y.entity
AND x.label < y.label AND left(x.entity, 7) = left(y.entity, 7)) SELECT a, b, true AS is_synonym
FROM syn UNION ALL SELECT a, b, false FROM (SELECT * FROM neg EXCEPT SELECT * FROM syn)""",
)
def _(s, d):
    t = _labels(s, d).withColumn("g", F.left("entity", F.lit(7)))
    neg = t.alias("x").join(t.alias("y"), F.col("x.g") == F.col("y.g")).where("x.entity < y.entity and x.label < y.label").select(F.col("x.label").alias("a"), F.col("y.label").alias("b"))
    return C.corpus([C.synonyms(_labels(s, d))], [neg])


@query("subsumption_mappings", f"WITH {_E} SELECT DISTINCT 'own ' || child AS src, parent AS tgt FROM e")
def _(s, d):
    e = _edges(s, d)
    return C.subsumptions(e.select(F.concat(F.lit("own "), "child").alias("src"), F.col("child").alias("tgt")).distinct(), e)


@query(
    "assumed_disjoint",
    """WITH n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up FROM nation), below AS (SELECT node AS n, up AS c FROM n UNION SELECT node, node FROM n UNION SELECT up, up FROM n),
p AS (SELECT 'n' || c_nationkey AS x, 'r' || (c_custkey % 5) AS y, c_custkey FROM customer UNION ALL SELECT 'n' || c_nationkey, 'n' || (c_custkey % 25), c_custkey FROM customer),
i AS (SELECT DISTINCT 'n' || c_nationkey AS node, 'i:' || CASE WHEN c_nationkey < 5 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS instance FROM customer),
held AS (SELECT n, c FROM below UNION SELECT instance, c FROM i JOIN below ON node = n)
SELECT DISTINCT x, y FROM p WHERE NOT EXISTS (SELECT 1 FROM held a JOIN held b ON a.n = b.n WHERE a.c = p.x AND b.c = p.y)""",
)
def _(s, d):
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    closed = H.closure(table(s, d, "nation").select(name("n", F.col("n_nationkey")).alias("child"), name("r", F.col("n_regionkey")).alias("parent")))
    c = table(s, d, "customer")
    pairs = c.select(name("n", F.col("c_nationkey")).alias("x"), name("r", F.col("c_custkey") % 5).alias("y")).union(c.select(name("n", F.col("c_nationkey")), name("n", F.col("c_custkey") % 25)))
    held = c.select(name("n", F.col("c_nationkey")).alias("node"), F.when(F.col("c_nationkey") < 5, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string")).alias("instance")).distinct()
    return C.assumed_disjoint(pairs, closed, held)


@query(
    "negative_candidates",
    """WITH r AS (SELECT DISTINCT p_brand AS src, min(p_name) OVER (PARTITION BY p_brand) AS tgt FROM part), pool AS (SELECT DISTINCT p_brand AS src, p_name
AS cand FROM part), k AS (SELECT pool.*, row_number() OVER (PARTITION BY src ORDER BY md5(src || '|' || cand || '|0'), cand) AS k
FROM pool WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = pool.src AND r.tgt = pool.cand) AND cand <> 'none')
SELECT src, cand FROM k WHERE k <= 5""",
)
def _(s, d):
    p = table(s, d, "part")
    closed = H.closure(s.createDataFrame([("none", "top")], "child string, parent string"))
    return C.negatives_of(p.groupBy(F.col("p_brand").alias("src")).agg(F.min("p_name").alias("tgt")), p.select(F.col("p_brand").alias("src"), F.col("p_name").alias("cand")), closed, 5)


@query(
    "k_hop",
    """WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation), one AS (SELECT a AS node, b AS other
FROM e WHERE a <> 'n0') SELECT node, other, 1 AS hop FROM one UNION ALL SELECT x.a, y.a, 2 FROM e x
JOIN e y USING (b) WHERE x.a <> y.a AND x.a <> 'n0'""",
)
def _(s, d):
    e = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return C.hops(e, e.where("child <> 'n0'").select(F.col("child").alias("node")), 2)


@query(
    "upward_paths",
    """SELECT 'n' || n_nationkey AS node, n_name || ' <SEP> ' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'r' || r_regionkey, r_name FROM region""",
)
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    labels = n.select(name("n", "n_nationkey").alias("entity"), F.col("n_name").alias("label")).union(r.select(name("r", "r_regionkey"), "r_name"))
    return C.upward_path(n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")), labels)


@query(
    "subsumption_prompts",
    """SELECT DISTINCT 'It is ' || CASE WHEN lower(p_brand[1]) IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || p_brand || '? <MASK>, it is ' ||
CASE WHEN lower(p_type[1]) IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || p_type || '.' AS prompt
FROM part""",
)
def _(s, d):
    return _edges(s, d).select(C.prompt(F.col("child"), F.col("parent")).alias("prompt")).distinct()


@query("intra_corpus", f"WITH {_L} SELECT true AS is_synonym, count(*) AS n FROM (SELECT DISTINCT a, b FROM syn)")
def _(s, d):
    """All synonyms are there; the negatives, drawn, are compared in a test."""
    got = C.intra_corpus(_labels(s, d, _entity()), _edges(s, d, _entity()))
    return got.where("is_synonym").groupBy("is_synonym").agg(F.count("*").alias("n"))


@query(
    "lexicon_pairs",
    """SELECT DISTINCT p_type AS a, p_brand AS b, true AS is_synonym FROM part WHERE p_size % 2 = 0 UNION ALL
SELECT p_type, arg_min(p_name, (p_partkey, p_name)), false FROM part GROUP BY 1""",
)
def _(s, d):
    p = table(s, d, "part")
    lexicon = p.where("p_size % 2 = 0").select(F.col("p_type").alias("word"), F.col("p_brand").alias("lemma"), F.lit("synonym").alias("kind"), F.lit(0).cast("long").alias("rank")).union(p.select("p_type", "p_name", F.lit("antonym"), "p_partkey"))
    return C.lexicon_pairs(p.select(F.col("p_type").alias("word")), lexicon)


@query("atomic_samples", "SELECT 'n' || n_nationkey AS sub, 'r' || n_regionkey AS sup FROM nation")
def _(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    closed = H.closure(table(s, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
    none = s.createDataFrame([], "node string, instance string")
    return C.atomic_samples(closed, none, 3).where("is_subsumption").select("sub", "sup")


@query("corrupted_classes", "SELECT DISTINCT p_brand AS cls, p_type AS prop, p_name AS filler FROM part")
def _(s, d):
    r = table(s, d, "part").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("prop"), F.col("p_name").alias("filler"))
    closed = H.closure(s.createDataFrame([("none", "top")], "child string, parent string"))
    return C.corrupted(r, closed).where("kind = 'whole'").drop("kind")


@query(
    "context_texts",
    """WITH e AS (SELECT 'n' || n_nationkey AS c, n_name, 'r' || n_regionkey AS p, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT c AS node, n_name AS label, r_name AS l, 1 AS hop, p AS o FROM e UNION ALL SELECT a.c, a.n_name, b.n_name, 2, b.c FROM e a JOIN e b ON a.p = b.p AND a.c <> b.c UNION ALL SELECT p, r_name, n_name, 1, c FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hop, l, o) AS r FROM x) SELECT node, min(label) || ' <SEP> ' || string_agg(l, ' <SEP> ' ORDER BY r) AS text FROM k WHERE r <= 3 GROUP BY node""",
)
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    labels = n.select(name("n", "n_nationkey").alias("entity"), F.col("n_name").alias("label")).union(r.select(name("r", "r_regionkey"), "r_name"))
    return C.contexts(n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")), labels, 2, 3)


@query("sample_strings", "SELECT 'n' || n_nationkey AS sub, 'r' || n_regionkey AS sup, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    texts = n.select(name("n", "n_nationkey").alias("node"), F.col("n_name").alias("text")).union(r.select(name("r", "r_regionkey"), "r_name"))
    return C.sample_strings(n.select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("sup")), texts)


@query(
    "neighbour_pool",
    """SELECT DISTINCT 'c' || c_custkey AS src, 'n' || b.n_nationkey AS cand FROM customer JOIN nation a ON c_nationkey = a.n_nationkey
JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey UNION SELECT 'c' || c_custkey, 'r' || n_regionkey
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(s, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    return C.POOLS["neighbour"](table(s, d, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("tgt")), edges, 2)


@query("random_pool", "SELECT 'c' || c_custkey AS src, 5 AS n FROM customer")
def _(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pool = C.POOLS["random"](table(s, d, "customer").select(name("c", "c_custkey").alias("src")), table(s, d, "nation").select(name("n", "n_nationkey").alias("node")), 5)
    return pool.groupBy("src").agg(F.countDistinct("cand").alias("n"))
