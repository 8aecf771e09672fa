"""Queries of personal data. Tables are brands, columns are types; an element's matches are the names of its parts, nouns are classes above these."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H, pii as P
from graphloom.registry import query, table

#: The cross map and the taxonomy, both inputs.
_CROSS = {"Email": ["ring", "bolt"], "Health": ["gear"], "Name": ["red ring", "cog"], "Colour": ["blue bolt"]}
_TAXONOMY = (("Email", "Contact"), ("Contact", "PersonalData"), ("Health", "SpecialCategoryPersonalData"), ("SpecialCategoryPersonalData", "PersonalData"), ("Name", "Identifying"), ("Identifying", "PersonalData"), ("Colour", "Thing"))
_PAIRS = "(VALUES " + ", ".join(f"('{m}', '{k}')" for k, ms in _CROSS.items() for m in ms) + ") x(match, dpv)"
_TAX = "tax AS (SELECT * FROM (VALUES " + ", ".join(map(str, _TAXONOMY)) + """) v(child, parent)), up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM tax UNION ALL
SELECT node, parent, depth + 1 FROM up JOIN tax ON ancestor = child), rup AS (SELECT * FROM up UNION ALL
SELECT DISTINCT x, x, 0 FROM (SELECT child AS x FROM tax UNION SELECT parent FROM tax))"""
_FOUND = f"""m AS (SELECT DISTINCT p_brand AS "table", p_type AS "column", p_brand || '#' || p_type AS element, p_name AS match FROM part WHERE p_size <> 7 UNION SELECT DISTINCT p_brand, p_type, p_brand || '#' || p_type, p_name FROM part WHERE p_size = 7),
a AS (SELECT "table", "column", element, match FROM m UNION SELECT "table", "column", element, split_part(match, ' ', 2) FROM m),
found AS (SELECT DISTINCT "table", "column", element, dpv FROM a JOIN {_PAIRS} USING (match) UNION SELECT p_brand, p_type, p_brand || '#' || p_type, 'Name' FROM part WHERE p_size = 50)"""


def _mappings(s, d):
    """Matches of most sizes; those of size 7 are matches of the first run; size 50 has a direct match with the taxonomy."""
    p = table(s, d, "part")
    all_of = lambda w, c: F.collect_set(F.when(F.expr(w), c))
    m = p.groupBy(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).agg(all_of("p_size <> 7", F.col("p_name")).alias("match"), all_of("p_size = 7", F.col("p_name")).alias("initial_match"), all_of("p_size = 50", F.lit("Name")).alias("dpv"))
    return m.withColumn("element", F.concat_ws("#", "table", "column"))


def _cross(s):
    import json

    return P.cross_map(s.createDataFrame([(json.dumps(_CROSS),)], "text string"))


def _closed(s, d):
    names = table(s, d, "part").select(F.col("p_name").alias("child"), F.get(F.split("p_name", " "), 1).alias("parent")).where("parent is not null").distinct()
    return H.closure(names)


def _taxonomy(s):
    return H.closure(s.createDataFrame(_TAXONOMY, "child string, parent string"))


@query("cross_map_scan", f"SELECT match, string_agg(dpv, ',' ORDER BY dpv) AS dpv FROM {_PAIRS} GROUP BY 1")
def _(s, d):
    return P.inverted(_cross(s)).select("match", F.array_join("dpv", ",").alias("dpv"))


@query("pii_detected", f"WITH {_FOUND} SELECT * FROM found")
def _(s, d):
    return P.detected(_mappings(s, d), _closed(s, d), _cross(s))


@query("pii_cross_matches", f"""WITH {_FOUND} SELECT DISTINCT "table", "column", element, dpv FROM a JOIN {_PAIRS} USING (match)""")
def _(s, d):
    return P.cross_matches(_mappings(s, d), _closed(s, d), _cross(s))


@query("pii_fields", f"""WITH {_FOUND} SELECT "table", "column", string_agg(DISTINCT element, ',' ORDER BY element) AS elements FROM found GROUP BY ALL""")
def _(s, d):
    return P.fields(P.detected(_mappings(s, d), _closed(s, d), _cross(s))).select("table", "column", F.array_join("elements", ",").alias("elements"))


@query(
    "pii_taxonomy_appended",
    """WITH e AS (SELECT DISTINCT p_brand || '#' || p_type AS element, p_type, bool_or(p_size = 50) AS has FROM part GROUP BY 1, 2)
SELECT element, concat_ws(',', CASE WHEN p_type < 'M' THEN 'Health' END, CASE WHEN has OR p_type < 'F' THEN 'Name' END) AS dpv FROM e""",
)
def _(s, d):
    m = _mappings(s, d)
    second = m.where("column < 'M'").select("element", F.lit("Health").alias("dpv")).union(m.where("column < 'F'").select("element", F.lit("Name")))
    return P.appended(m, second).select("element", F.array_join("dpv", ",").alias("dpv"))


_DOC = f"""WITH RECURSIVE {_TAX}, {_FOUND}, f AS (SELECT DISTINCT "table", "column", dpv FROM found),
s AS (SELECT "column" AS el, string_agg(DISTINCT "table" || '.csv:' || 'id ' || "table", ',' ORDER BY "table" || '.csv:' || 'id ' || "table") AS sources FROM f GROUP BY 1),
g AS (SELECT "column" AS el, bool_or(ancestor = 'PersonalData') AS is_personal_data, bool_or(ancestor = 'Identifying') AS is_identifying, bool_or(ancestor = 'SpecialCategoryPersonalData') AS is_special FROM f JOIN rup ON node = dpv GROUP BY 1),
mm AS (SELECT DISTINCT "column" AS el, dpv, coalesce((SELECT string_agg(depth || ' ' || ancestor || ' ' || CASE WHEN ancestor = 'Contact' THEN '-' ELSE 'about ' || ancestor END, '>' ORDER BY depth, ancestor) FROM up WHERE node = dpv), '') AS above FROM f)
SELECT el AS dataset_element, sources, is_personal_data, is_identifying, is_special, string_agg('the ' || dpv || ':' || above, ',' ORDER BY dpv) AS matches FROM mm JOIN s USING (el) JOIN g USING (el) GROUP BY ALL"""


def _document(s, d):
    found = P.detected(_mappings(s, d), _closed(s, d), _cross(s))
    classes = sorted({x for e in _TAXONOMY for x in e})
    texts = s.createDataFrame([(c, f"the {c}", None if c == "Contact" else f"about {c}") for c in classes], "entity string, label string, description string")
    sources = table(s, d, "part").select(F.col("p_brand").alias("table"), F.concat("p_brand", F.lit(".csv")).alias("filename"), F.concat(F.lit("id "), "p_brand").alias("metadata_id")).distinct()
    return P.document(found, _taxonomy(s), texts, sources)


@query("pii_document", _DOC)
def _(s, d):
    """The nested document, written out as texts so that it can be compared."""
    above = lambda m: F.array_join(F.transform(m["is_subclass_of"], lambda a: F.concat_ws(" ", a["depth"].cast("string"), a["uri"], F.coalesce(a["description"], F.lit("-")))), ">")
    return _document(s, d).select(
        "dataset_element",
        F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["filename"], x["metadata_id"])), ",").alias("sources"),
        "is_personal_data",
        "is_identifying",
        F.col("is_special_category_personal_data").alias("is_special"),
        F.array_join(F.transform("dpv_matches", lambda m: F.concat_ws(":", m["label"], above(m))), ",").alias("matches"),
    )


@query("pii_messages", "SELECT DISTINCT p_type AS dataset_element, 'parts' AS domain, 'NULL' AS previous, 'm2' AS current, true AS written_out FROM part")
def _(s, d):
    m = P.messages(_document(s, d), "parts", None, "m2")
    part = lambda p: F.get_json_object("value", p)
    return m.select(part("$.attribute.dataset_element").alias("dataset_element"), part("$.domain").alias("domain"), F.when(F.contains("value", F.lit('"prev_metadata_id":null')), "NULL").alias("previous"), part("$.current_metadata_id").alias("current"), F.contains("value", F.lit('"is_identifying":')).alias("written_out"))


@query("pii_column_names", "SELECT page_id, list_last(string_split(url, '/')) || CASE WHEN page_id % 2 = 0 THEN '|Tag' || page_id ELSE '' END AS name FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", P.column_name(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Tag"), F.col("page_id").cast("string")))).alias("name"))
