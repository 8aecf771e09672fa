"""Queries of decoded image tags, made of orders: a file for each customer, a nested status."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import dicom as D
from graphloom.registry import query, table


@query(
    "dicom_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS da, strftime(o_orderdate,
'%Y-%m-%dT%H:%M:%S.%f') AS dt, CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE strftime(o_orderdate, '%H:%M:%S') END AS tm
FROM orders""",
)
def _(s, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    raw = table(s, d, "orders").select("o_orderkey", F.when(k % 3 == 0, "none").otherwise(F.date_format(t, "yyyyMMdd")).alias("da"), F.date_format(t, "yyyyMMddHHmmss.SSSSSS").alias("dt"), F.when(k % 2 == 0, "12").otherwise(F.date_format(t, "HHmmss.SSS")).alias("tm"))
    return raw.select("o_orderkey", *(D.value_of(F.lit(vr.upper()), F.col(vr)).alias(vr) for vr in ("da", "dt", "tm")))


def _tags(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("file"), "o_orderstatus", "o_orderpriority")
    top = o.select("file", F.array().cast("array<string>").alias("path"), F.lit("(0010,0010)").alias("code"), F.col("o_orderpriority").alias("value"))
    nested = o.select("file", F.array(F.lit("Study"), F.lit("Series")).alias("path"), F.lit("(0020,000D)").alias("code"), F.col("o_orderstatus").alias("value"))
    plain = o.select("file", F.array().cast("array<string>").alias("path"), F.lit("(0099,0099)").alias("code"), F.lit("x").alias("value"))
    return top.unionByName(nested).unionByName(plain)


@query(
    "dicom_placement",
    """SELECT 'f' || o_custkey % 50 AS file, 'Patient' AS parent, '(0010,0010)' AS code, 'Patient Name' AS name, min(o_orderpriority) AS value
FROM orders GROUP BY ALL UNION ALL SELECT 'f' || o_custkey % 50, 'Study/Series', '(0020,000D)', 'Study UID', min(o_orderstatus)
FROM orders GROUP BY ALL UNION ALL SELECT DISTINCT 'f' || o_custkey % 50, 'Image', '(0099,0099)', 'Unknown Tag and Data', 'x'
FROM orders""",
)
def _(s, d):
    names = s.createDataFrame([("(0010,0010)", "Patient Name"), ("(0020,000D)", "Study UID")], "code string, name string")
    tags = D.with_domain(D.named(_tags(s, d), names), s.createDataFrame([("(0020,000D)", "Study")], "code string, domain string"), s.createDataFrame([("Patient Name", "Patient")], "name string, domain string"))
    return D.placed(tags, "Image")


@query("dicom_item_paths", "SELECT * FROM (VALUES ('Root', 'hasItem', 'StudyItem'), ('StudyItem', 'hasItem', 'SeriesItem')) v(parent, prop, child)")
def _(s, d):
    return D.item_edges(_tags(s, d))


@query("dicom_definition", "SELECT 'f' || k AS file, CASE WHEN k % 2 = 0 THEN 'CTImage' ELSE 'MRImage' END AS cls FROM (SELECT DISTINCT o_custkey % 50 AS k FROM orders)")
def _(s, d):
    k = F.col("o_custkey") % 50
    tags = table(s, d, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.array().cast("array<string>").alias("path"), F.lit("(0008,0016)").alias("code"), F.when(k % 2 == 0, "1.2.2").otherwise("1.2.4").alias("value"))
    return D.definition(tags, s.createDataFrame([("1.2.2", "CTImage"), ("1.2.4", "MRImage")], "uid string, cls string"))


@query("ntriples_scan", "SELECT 'http://n/' || n_nationkey AS s, 'http://p/name' AS p, n_name AS o, 'lit' AS o_kind, 'http://x#string' AS datatype, NULL::VARCHAR AS lang FROM nation UNION ALL SELECT 'http://n/' || n_nationkey, 'http://p/in', 'http://r/' || n_regionkey, 'iri', NULL, NULL FROM nation UNION ALL SELECT 'http://n/' || n_nationkey, 'http://p/label', 'a \"' || lower(n_name) || '\" \\', 'lit', NULL, 'en' FROM nation")
def _(s, d):
    from graphloom.sources.mappings import parse_ntriples

    n = table(s, d, "nation")
    subject = F.concat(F.lit("<http://n/"), F.col("n_nationkey").cast("string"), F.lit("> "))
    lines = [F.concat(subject, F.lit('<http://p/name> "'), "n_name", F.lit('"^^<http://x#string> .')), F.concat(subject, F.lit("<http://p/in> <http://r/"), F.col("n_regionkey").cast("string"), F.lit("> . # in")), F.concat(subject, F.lit('<http://p/label> "a \\"'), F.lower("n_name"), F.lit('\\" \\\\"@en .')), F.lit("# a comment")]
    return parse_ntriples(n.select(F.explode(F.array(*lines)).alias("value")))


@query("json_repair", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS n FROM part")
def _(s, d):
    from graphloom.sources.mappings import repair_json

    one = F.concat(F.lit('{"k": '), F.col("p_partkey").cast("string"), F.lit("}"))
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(one, F.lit("\n"), one)).alias("t"))
    return p.select("p_partkey", F.json_array_length(repair_json(F.col("t"))).alias("n"))
