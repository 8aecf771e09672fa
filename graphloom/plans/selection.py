"""Queries of the choice of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H, selection as S
from graphloom.registry import query, table

_TYPES = ("xsd:integer", "xsd:decimal", "xsd:date", "xsd:string", "xsd:boolean")
_RANGES = ("xsd:integer", "xsd:double", "xsd:dateTime", "xsd:string", "xsd:boolean", None)

_T, _R = "unnest(['xsd:integer','xsd:decimal','xsd:date','xsd:string','xsd:boolean'])", "unnest(['xsd:integer','xsd:double','xsd:dateTime','xsd:string','xsd:boolean',NULL])"


@query(
    "range_fits",
    f"""WITH a AS (SELECT {_T} AS own), b AS (SELECT {_R} AS other) SELECT own, other, other IS NULL OR other = 'xsd:string' OR own = other OR (own IN
('xsd:integer','xsd:decimal') AND other = 'xsd:double') OR (own = 'xsd:date' AND other = 'xsd:dateTime') AS fits
FROM a, b""",
)
def _(s, d):
    rows = s.createDataFrame([(a, b) for a in _TYPES for b in _RANGES], "own string, other string")
    return rows.select("own", "other", S.range_fits(F.col("own"), F.col("other"), F.lit(None).cast("array<string>")).alias("fits"))


#: Candidates of orders: the object is a customer's segment, the class its nation, the data property its status.
def _cands(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("k"), (F.col("o_custkey") % 3 + 1).cast("int").alias("pj_rank"), F.round(F.col("o_totalprice") % 100, 2).alias("bes"))
    pick = lambda n, f: o.select("key", F.concat(F.lit(n), (F.col("k") % f).cast("string")).alias("cand"), "bes", (1 / F.col("pj_rank")).alias("pj"), "pj_rank")
    return pick("p", 4).unionByName(pick("p", 7)).dropDuplicates(["key", "cand"]), pick("c", 5), pick("a", 6)


_CANDS = """o AS (SELECT o_orderkey AS key, o_custkey AS k FROM orders), ob AS (SELECT DISTINCT key, 'p' || unnest([k % 4, k % 7]) AS obj
FROM o), cl AS (SELECT key, 'c' || k % 5 AS cls FROM o), da AS (SELECT key, 'a' || k % 6 AS data
FROM o), rel AS (SELECT * FROM (VALUES ('c0','c0'),('c1','c1'),('c2','c2'),('c3','c3'),('c4','c4'),('c1','c0'),('c0','c1'),('c2','c0'),('c0','c2'))
v(x, y)), rg AS (SELECT * FROM (VALUES ('p0','c0'),('p1','c1'),('p2','c2'),('p3','c4')) v(prop, range)), us AS (SELECT *
FROM (VALUES ('c0','a0'),('c0','a1'),('c3','a3'),('c4','a2')) v(cls, prop))"""


def _onto(s):
    closed = H.closure(s.createDataFrame([("c1", "c0"), ("c2", "c0"), ("c3", "top"), ("c4", "top")], "child string, parent string")).where("ancestor <> 'top' and node <> 'top'")
    ranges = s.createDataFrame([("p0", "c0"), ("p1", "c1"), ("p2", "c2"), ("p3", "c4")], "prop string, range string")
    return closed, ranges, s.createDataFrame([("c0", "a0"), ("c0", "a1"), ("c3", "a3"), ("c4", "a2")], "cls string, prop string")


@query(
    "nary_paths",
    f"""WITH {_CANDS}, c AS (SELECT cl.key, cl.cls, u.data FROM cl LEFT JOIN (SELECT key, data, cls FROM da
JOIN us ON us.prop = da.data) u ON u.key = cl.key AND u.cls = cl.cls), w AS (SELECT c.key, obj, c.cls, c.data
FROM ob JOIN rg ON obj = prop JOIN rel ON x = range JOIN c ON c.key = ob.key AND c.cls = y) SELECT *
FROM w UNION ALL SELECT key, NULL, cls, data FROM c WHERE data IS NOT NULL AND NOT EXISTS (SELECT 1
FROM w WHERE w.key = c.key AND w.cls = c.cls)""",
)
def _(s, d):
    closed, ranges, uses = _onto(s)
    return S.paths(*_cands(s, d), ranges, uses, S.related(closed))


@query(
    "optimal_candidates",
    """WITH e AS (SELECT l_orderkey AS key, l_partkey AS cand, l_linenumber AS r, l_quantity AS bes FROM lineitem), m AS (SELECT key, min(r) AS r
FROM e GROUP BY 1), t AS (SELECT e.* FROM e JOIN m USING (key, r)), b AS (SELECT key, max(bes) AS bes
FROM t GROUP BY 1) SELECT key, string_agg(DISTINCT cand::VARCHAR, ',' ORDER BY cand::VARCHAR) AS cands
FROM t JOIN b USING (key, bes) GROUP BY 1""",
)
def _(s, d):
    e = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").cast("string").alias("cand"), F.col("l_linenumber").alias("pj_rank"), F.col("l_quantity").alias("bes"))
    return S.optimal(e, False).select("key", F.array_join("cands", ",").alias("cands"))


_GROUPS = (("k1", "Date", 50.0, 0.5, 2), ("k1", "NoteDate", 60.0, 0.5, 2), ("k2", "A", 50.0, 0.5, 1), ("k2", "B", 60.0, 0.5, 1), ("k3", "A", 50.0, 0.7, 1), ("k3", "B", 60.0, 0.5, 2), ("k4", "Lone", 70.0, 1.0, 1), ("k5", "Date", 50.0, 0.9, 1), ("k5", "NoteDate", 60.0, 0.5, 2))


@query(
    "hierarchy_collapse",
    """SELECT * FROM (VALUES ('k1','NoteDate',60.0::DOUBLE,0.5::DOUBLE,2), ('k2','Up',60.0,0.5,1), ('k3','A',60.0,0.7,1), ('k4','Lone',70.0,1.0,1),
('k5','Date',60.0,0.9,1)) v(key, cand, bes, pj, pj_rank)""",
)
def _(s, d):
    closed = H.closure(s.createDataFrame([("NoteDate", "Date"), ("A", "Up"), ("B", "Up"), ("Lone", "Far")], "child string, parent string"))
    return S.collapsed(s.createDataFrame(_GROUPS, "key string, cand string, bes double, pj double, pj_rank int"), closed, 2)


_ROW = "key string, cand string, bes double, pj double, pj_rank int"


@query(
    "column_triple_select",
    """SELECT * FROM (VALUES ('whole','hasName','Name','text'), ('noObject',NULL,'Name','text'), ('voteClass',NULL,'Place','zip'),
('voteObject','hasName',NULL,'text'), ('dataOnly',NULL,NULL,'age')) v(key, obj, cls, data)""",
)
def _(s, d):
    """A case for each branch: a whole path, a class with its property, either winner of a vote, a property of the table's class."""
    row = lambda *r: s.createDataFrame(r, _ROW)
    objects = row(("whole", "hasName", 90.0, 1.0, 1), ("voteClass", "hasName", 60.0, 0.6, 1), ("voteObject", "hasName", 95.0, 1.0, 1), ("ambiguous", "hasName", 90.0, 1.0, 1), ("ambiguous", "hasPlace", 90.0, 1.0, 1), ("weak", "hasName", 10.0, 0.1, 1))
    classes = row(("whole", "Name", 90.0, 1.0, 1), ("noObject", "Name", 90.0, 1.0, 1), ("voteClass", "Place", 90.0, 0.9, 1), ("voteObject", "Place", 70.0, 0.7, 1), ("ambiguous", "Name", 90.0, 1.0, 1), ("ambiguous", "Place", 90.0, 1.0, 1))
    data = row(("whole", "text", 80.0, 1.0, 1), ("noObject", "text", 80.0, 1.0, 1), ("voteClass", "zip", 80.0, 1.0, 1), ("voteObject", "text", 80.0, 1.0, 1), ("dataOnly", "age", 80.0, 1.0, 1), ("dataOnly", "zip", 95.0, 1.0, 1))
    tables = s.createDataFrame([(k, "Person") for k in ("whole", "noObject", "voteClass", "voteObject", "ambiguous", "weak", "dataOnly")], "key string, table_class string")
    domains = s.createDataFrame([("hasName", "Person")], "prop string, domain string")
    ranges = s.createDataFrame([("hasName", "Name"), ("hasPlace", "Place")], "prop string, range string")
    uses = s.createDataFrame([("Name", "text"), ("Place", "zip"), ("Person", "age")], "cls string, prop string")
    closed = H.closure(s.createDataFrame([("Person", "PTop"), ("Name", "NTop"), ("Place", "LTop")], "child string, parent string"))
    return S.select_triples(objects, classes, data, tables, domains, ranges, uses, closed, 0.3, 30.0, 1)
