"""Queries of alignments. Sources are the parts' names; a target is the same name, its plural or its words the other way round, by its first letter; nouns are above both."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import alignment as A, corpora as C
from graphloom.registry import query, table, union

_L = """n AS (SELECT DISTINCT p_name AS x, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 2) AS v FROM part WHERE contains(p_name, ' ')),
a AS (SELECT 's/' || x AS entity, x AS label FROM n UNION SELECT 's/' || x, 'the ' || x FROM n),
b AS (SELECT 't/' || x AS entity, CASE WHEN x < 'g' THEN x WHEN x < 's' THEN x || 's' ELSE v || ' ' || w END AS label FROM n)"""
_STRING = "st AS (SELECT DISTINCT a.entity AS src, b.entity AS tgt FROM a JOIN b USING (label))"
_SIM = "1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))"
_SCORED = f"""tok AS (SELECT DISTINCT entity, unnest(regexp_extract_all(lower(label), '[a-z0-9]+')) AS token FROM a WHERE entity NOT IN (SELECT src FROM st)), tokb AS (SELECT DISTINCT entity, unnest(regexp_extract_all(lower(label), '[a-z0-9]+')) AS token FROM b),
cand AS (SELECT DISTINCT tok.entity AS src, tokb.entity AS tgt FROM tok JOIN tokb USING (token)),
sc AS (SELECT src, tgt, round(max({_SIM}), 6) AS score FROM cand JOIN a ON a.entity = src JOIN b ON b.entity = tgt GROUP BY ALL)"""


def _names(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("x")).where("contains(x, ' ')").distinct()
    return p.withColumn("w", F.get(F.split("x", " "), 0)).withColumn("v", F.get(F.split("x", " "), 1))


def _labels(s, d):
    n = _names(s, d)
    src = n.select(F.concat(F.lit("s/"), "x").alias("entity"), F.explode(F.array("x", F.concat(F.lit("the "), "x"))).alias("label"))
    b = F.when(F.col("x") < "g", F.col("x")).when(F.col("x") < "s", F.concat("x", F.lit("s"))).otherwise(F.concat_ws(" ", "v", "w"))
    return src, n.select(F.concat(F.lit("t/"), "x").alias("entity"), b.alias("label"))


@query("string_matches", f"WITH {_L}, {_STRING} SELECT src, tgt, 1.0::DOUBLE AS score FROM st")
def _(s, d):
    return A.string_matches(*_labels(s, d))


@query("candidate_pool", f"WITH {_L}, {_STRING}, {_SCORED} SELECT src, tgt FROM cand")
def _(s, d):
    src, tgt = _labels(s, d)
    known = A.string_matches(src, tgt).select(F.col("src").alias("entity")).distinct()
    return A.candidates(src.join(known, "entity", "left_anti"), tgt, 200)


@query(
    "label_pairs",
    f"""WITH {_L} SELECT 's/' || x AS src, 't/' || x AS tgt, a.label AS a, b.label AS b FROM n JOIN a ON a.entity = 's/' || x
JOIN b ON b.entity = 't/' || x""",
)
def _(s, d):
    src, tgt = _labels(s, d)
    return A.label_pairs(_names(s, d).select(F.concat(F.lit("s/"), "x").alias("src"), F.concat(F.lit("t/"), "x").alias("tgt")), src, tgt)


for _name, _agg, _mean in (("pair_scores_max", "max", False), ("pair_scores_mean", "avg", True)):

    @query(_name, f"WITH {_L} SELECT 's/' || x AS src, 't/' || x AS tgt, round({_agg}({_SIM}), 6) AS score FROM n JOIN a ON a.entity = 's/' || x JOIN b ON b.entity = 't/' || x GROUP BY x")
    def _(s, d, mean=_mean):
        src, tgt = _labels(s, d)
        return A.scored(_names(s, d).select(F.concat(F.lit("s/"), "x").alias("src"), F.concat(F.lit("t/"), "x").alias("tgt")), src, tgt, "levenshtein", mean)


@query(
    "alignment_predicted",
    f"""WITH {_L}, {_STRING}, {_SCORED} SELECT src, tgt, 1.0::DOUBLE AS score, 'string' AS way FROM st UNION ALL
SELECT src, tgt, score, 'scored' FROM sc WHERE score >= 0.85""",
)
def _(s, d):
    """What string matches and the scorer give; what the scan for low scores adds is in alignment_low, a test compares it with a plain scan."""
    return A.predict(*_labels(s, d)).where("way <> 'low'").select("src", "tgt", "score", "way")


@query("alignment_low")
def _(s, d):
    return A.predict(*_labels(s, d)).where("way = 'low'").select("src", "tgt", "score", "rank")


@query(
    "alignment_kinds",
    f"""WITH {_L}, {_STRING} SELECT src, tgt, 1.0::DOUBLE AS score, 'class' AS kind FROM st UNION ALL SELECT DISTINCT 'p/' || p_type, 'q/' || p_type, 1.0,
'objectProperty' FROM part""",
)
def _(s, d):
    src, tgt = (x.withColumn("kind", F.lit("class")) for x in _labels(s, d))
    t = table(s, d, "part").select(F.col("p_type").alias("label")).distinct()
    own = lambda p: t.select(F.concat(F.lit(p), "label").alias("entity"), "label").withColumn("kind", F.lit("objectProperty"))
    return A.predict_kinds(src.unionByName(own("p/")), tgt.unionByName(own("q/"))).where("way = 'string'").select("src", "tgt", "score", "kind")


_ALL = """la AS (SELECT * FROM a UNION SELECT 's:' || v, v FROM n), lb AS (SELECT * FROM b UNION SELECT 't:' || v, v
FROM n), ea AS (SELECT DISTINCT 's/' || x AS child, 's:' || v AS parent FROM n), eb AS (SELECT DISTINCT 't/' || x AS child, 't:' || v AS parent
FROM n)"""
_EXTENDED = f"""WITH RECURSIVE {_L}, {_STRING}, {_ALL}, mean AS (SELECT a.entity AS src, b.entity AS tgt, round(avg({_SIM}), 6) AS score FROM la a, lb b GROUP BY ALL),
step AS (SELECT src, tgt, p.src2, p.tgt2 FROM (SELECT x.child AS src, y.child AS tgt, x.parent AS src2, y.parent AS tgt2 FROM ea x, eb y UNION SELECT x.parent, y.parent, x.child, y.child FROM ea x, eb y) p),
reach AS (SELECT src, tgt FROM st UNION SELECT s.src2, s.tgt2 FROM reach r JOIN step s ON s.src = r.src AND s.tgt = r.tgt JOIN mean m ON m.src = s.src2 AND m.tgt = s.tgt2 WHERE m.score >= 0.85 OR EXISTS (SELECT 1 FROM st WHERE st.src = s.src2 AND st.tgt = s.tgt2)),
done AS (SELECT src, tgt, 1.0::DOUBLE AS score FROM st UNION ALL SELECT r.src, r.tgt, m.score FROM reach r JOIN mean m ON m.src = r.src AND m.tgt = r.tgt WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.src = r.src AND st.tgt = r.tgt))
SELECT src, tgt, score FROM done WHERE score >= 0.9"""


def _trees(s, d):
    n = _names(s, d)
    edges = [n.select(F.concat(F.lit(f"{p}/"), "x").alias("child"), F.concat(F.lit(f"{p}:"), "v").alias("parent")).distinct() for p in "st"]
    above = [n.select(F.concat(F.lit(f"{p}:"), "v").alias("entity"), F.col("v").alias("label")).distinct() for p in "st"]
    return edges, [x.unionByName(y) for x, y in zip(_labels(s, d), above, strict=True)]


@query("alignment_extended", _EXTENDED)
def _(s, d):
    edges, labels = _trees(s, d)
    return A.extend(A.string_matches(*_labels(s, d)), *labels, *edges)


@query("repair_lines", f"WITH {_L}, {_STRING} SELECT src || '|' || tgt || '|=|1.0|CLS' AS line FROM st")
def _(s, d):
    return A.repair_lines(A.string_matches(*_labels(s, d)))


@query("candidate_document")
def _(s, d):
    """Partial ratios have no SQL; a test compares them with plain ones."""
    src, tgt = _labels(s, d)
    return A.candidate_document(A.predict(src, tgt), src, tgt)


@query("candidate_json", f"WITH {_L}, {_STRING} SELECT src, count(*) AS n, min(tgt) AS first FROM st GROUP BY 1")
def _(s, d):
    src, tgt = _labels(s, d)
    rows = A.candidate_json(A.candidate_document(A.string_matches(src, tgt), src, tgt))
    parsed = F.from_json("candidates", "array<struct<bes_rank:long,candidate:string,bes:double>>")
    return rows.select("src", F.size(parsed).cast("long").alias("n"), F.array_min(F.transform(parsed, lambda x: x["candidate"])).alias("first"))


@query("top_mappings", f"WITH {_L}, {_STRING}, {_SCORED} SELECT src, tgt, score FROM sc ORDER BY score DESC, src, tgt LIMIT 20")
def _(s, d):
    src, tgt = _labels(s, d)
    known = A.string_matches(src, tgt).select(F.col("src").alias("entity")).distinct()
    open_ = src.join(known, "entity", "left_anti")
    return A.top(A.scored(A.candidates(open_, tgt, 200), open_, tgt, "levenshtein"), 20)


@query("score_floor", f"WITH {_L}, {_STRING}, {_SCORED} SELECT src, tgt, score, score >= 0.85 AS extends, score >= 0.9 AS stays FROM sc WHERE score >= 0.5")
def _(s, d):
    src, tgt = _labels(s, d)
    how = A.preset("health")
    open_ = src.join(A.string_matches(src, tgt).select(F.col("src").alias("entity")).distinct(), "entity", "left_anti")
    rows = A.scored(A.candidates(open_, tgt, how.pool), open_, tgt, how.scorer).where("score >= 0.5")
    return rows.select("src", "tgt", "score", (F.col("score") >= how.extend).alias("extends"), (F.col("score") >= how.keep).alias("stays"))


@query(
    "low_score_ranks",
    """SELECT l_orderkey AS src, l_partkey AS tgt, l_discount AS score, CASE WHEN l_discount > 0 THEN dense_rank() OVER (PARTITION BY l_orderkey, l_discount
> 0 ORDER BY l_discount DESC, l_quantity DESC) END AS rank FROM lineitem""",
)
def _(s, d):
    return A.low_score_ranks(table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("tgt"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("length"))).select("src", "tgt", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "alignment_evaluation",
    """WITH p AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS tgt FROM lineitem WHERE l_quantity > 20 AND l_tax <> 0.05), r AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS tgt FROM lineitem WHERE l_discount > 0.02),
i AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS tgt FROM lineitem WHERE l_tax = 0.01), p2 AS (SELECT * FROM p EXCEPT SELECT * FROM i), r2 AS (SELECT * FROM r EXCEPT SELECT * FROM i),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM p2 INTERSECT SELECT * FROM r2)) AS tp, (SELECT count(*) FROM p2) AS a, (SELECT count(*) FROM r2) AS b)
SELECT tp, round(tp / a, 3) AS precision, round(tp / b, 3) AS recall, round(2 * (tp / a) * (tp / b) / (tp / a + tp / b), 3) AS f1 FROM n""",
)
def _(s, d):
    pick = lambda w: table(s, d, "lineitem").where(w).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("tgt"))
    return A.evaluation(pick("l_quantity > 20 and l_tax <> 0.05"), pick("l_discount > 0.02"), pick("l_tax = 0.01"))


@query(
    "alignment_hits",
    f"""WITH {_L}, {_STRING}, {_SCORED}, k AS (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM sc), r AS (SELECT 's/' || x AS src, 't/' || x AS tgt FROM n),
j AS (SELECT rank FROM r LEFT JOIN k USING (src, tgt)) SELECT round(avg(coalesce((rank <= 1)::INT, 0)), 3) AS hits1, round(avg(coalesce((rank <= 5)::INT, 0)), 3) AS hits5, round(avg(coalesce(1 / rank, 0)), 3) AS mrr FROM j""",
)
def _(s, d):
    src, tgt = _labels(s, d)
    open_ = src.join(A.string_matches(src, tgt).select(F.col("src").alias("entity")).distinct(), "entity", "left_anti")
    ranked = A.best_of(A.scored(A.candidates(open_, tgt, 200), open_, tgt, "levenshtein"), 1_000)
    return A.hits(ranked, _names(s, d).select(F.concat(F.lit("s/"), "x").alias("src"), F.concat(F.lit("t/"), "x").alias("tgt")), (1, 5))


_TOKENS = "SELECT entity, label, len(regexp_extract_all(lower(label), '[a-z0-9]+')) AS n FROM (SELECT doc_id AS entity, text AS label FROM documents)"


@query(
    "label_profile",
    f"""WITH t AS ({_TOKENS}) SELECT count(DISTINCT entity) AS entities, count(*) AS labels, round(count(*) / count(DISTINCT entity), 3) AS per_entity,
round(avg(n), 3) AS mean_tokens, max(n)::INTEGER AS max_tokens, round(avg((n <= 128)::INT), 3) AS within_128, round(avg((n <= 256)::INT), 3) AS
within_256, round(avg((n <= 512)::INT), 3) AS within_512 FROM t""",
)
def _(s, d):
    return A.label_profile(table(s, d, "documents").select(F.col("doc_id").alias("entity"), F.col("text").alias("label")))


@query(
    "decorated_matches",
    """SELECT o_custkey AS element, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position, o_orderkey AS tgt,
o_totalprice AS score, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || lower(o_orderpriority) ELSE '' END AS labels
FROM orders""",
)
def _(s, d):
    o = table(s, d, "orders")
    labels = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("entity"), F.explode(F.array("o_orderpriority", F.lower("o_orderpriority"))).alias("label"))
    return A.decorated(o.select(F.col("o_custkey").alias("element"), F.col("o_orderkey").alias("tgt"), F.col("o_totalprice").alias("score")), labels)


@query(
    "attached_results",
    """SELECT c_custkey AS element, coalesce((SELECT string_agg(k || ':' || o_orderkey, ',' ORDER BY k)
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k
FROM orders) x WHERE o_custkey = c_custkey), '') AS matches FROM customer""",
)
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    m = table(s, d, "orders").select(F.col("o_custkey").alias("element"), F.row_number().over(w).alias("rank"), F.col("o_orderkey").cast("string").alias("tgt"), F.col("o_totalprice").alias("score"))
    rows = A.attached(table(s, d, "customer").select(F.col("c_custkey").alias("element")), m)
    return rows.select("element", F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["tgt"])), ",").alias("matches"))


@query(
    "set_matches",
    """SELECT c_custkey AS element, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE 'old' END AS match, CASE
WHEN c_custkey % 4 = 0 THEN 'x>y' ELSE '' END AS path, 'old' AS initial FROM customer""",
)
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("element"))
    none = F.lit(None).cast("array<string>")
    path = F.when(F.col("element") % 4 == 0, F.array(F.lit("x"), F.lit("y")))
    chosen = c.where("element % 2 = 0").select("element", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("tgt"), path.alias("path"))
    rows = A.set_matches(c.select("element", F.array(F.lit("old")).alias("match"), none.alias("path")), chosen)
    return rows.select("element", F.array_join("match", ",").alias("match"), F.array_join("path", ">").alias("path"), F.array_join("initial_match", ",").alias("initial"))


@query(
    "matches_store",
    """WITH o AS (SELECT o_custkey AS element, o_orderkey AS seq, o_orderstatus AS st FROM orders) SELECT element, arg_max(st, seq) FILTER (st <> 'O') AS match, arg_max(seq::VARCHAR, seq) FILTER (seq % 3 = 0) AS path FROM o GROUP BY 1""",
)
def _(s, d):
    o = table(s, d, "orders")
    match = F.when(F.col("o_orderstatus") != "O", F.array("o_orderstatus")).otherwise(F.array().cast("array<string>"))
    path = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_orderkey").cast("string")))
    rows = A.stored(o.select(F.col("o_custkey").alias("element"), F.col("o_orderkey").alias("seq"), match.alias("match"), path.alias("path")))
    return rows.select("element", F.get("match", 0).alias("match"), F.get("path", 0).alias("path"))


@query(
    "held_by_all_domains",
    """WITH e AS (SELECT DISTINCT p_type AS key, p_brand AS domain, p_name AS cand FROM part) SELECT key, cand
FROM e GROUP BY 1, 2 HAVING count(DISTINCT domain) = (SELECT count(DISTINCT domain) FROM e x WHERE x.key = e.key)
UNION ALL SELECT 'own', n_name FROM nation WHERE n_regionkey = 0""",
)
def _(s, d):
    p = table(s, d, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("domain"), F.col("p_name").alias("cand"))
    n = table(s, d, "nation")
    row = lambda w, x: n.where(w).select(F.lit("own").alias("key"), F.lit(x).alias("domain"), F.col("n_name").alias("cand"))
    return A.held_by_all(union([p, row("n_regionkey = 0", "a"), row("n_regionkey = 0", "b"), row("n_regionkey = 1", "a")]))


@query(
    "neighbour_difference",
    """SELECT DISTINCT 'n' || a.n_nationkey AS node, 'n' || b.n_nationkey AS other FROM nation a JOIN nation b USING (n_regionkey)
WHERE a.n_nationkey <> b.n_nationkey AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = a.n_nationkey
AND c_custkey % 25 = b.n_nationkey)""",
)
def _(s, d):
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    e = table(s, d, "nation").select(name(F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    known = table(s, d, "customer").select(name(F.col("c_nationkey")).alias("node"), name(F.col("c_custkey") % 25).alias("other")).distinct()
    return A.neighbours_apart(C.hops(e, e.select(F.col("child").alias("node")), 2).where("hop = 2 and node <> other"), known)


