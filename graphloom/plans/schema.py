"""Queries of keys, inclusion and the rules from a schema to an ontology. Answers are derived from the tables, or from a catalog that is the rules' input."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import profile as P, rules as R
from graphloom.registry import query, table, union

#: Every column that isn't an array.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "documents": "doc_id lang source n_chars",
}
FKS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def bare(column: str) -> str:
    """A column's name without its table's letter."""
    return column[2:] if column[1:2] == "_" else column


def _all(s, d, tables=COLUMNS):
    return {t: table(s, d, t).select(*COLUMNS[t].split()) for t in tables}


def _key_sql(tables=COLUMNS) -> str:
    one = "SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_values, count(*) = count(DISTINCT {c}) AS is_key FROM {t}"
    return " UNION ALL ".join(one.format(t=t, c=c) for t in tables for c in COLUMNS[t].split())


@query("candidate_keys", _key_sql())
def _(s, d):
    return union([P.candidate_keys(df, t) for t, df in _all(s, d).items()])


def _overlaps(s, d):
    return P.overlaps(_all(s, d, sorted({t for a, _, b, _ in FKS for t in (a, b)})), [((a, x), (b, y)) for a, x, b, y in FKS])


@query(
    "fk_inclusion",
    " UNION ALL ".join(f"SELECT '{a}.{x}' AS src, '{b}.{y}' AS tgt, count(DISTINCT {x}) FILTER ({x} NOT IN (SELECT {y} FROM {b})) AS missing FROM {a}" for a, x, b, y in FKS),
)
def _(s, d):
    name = lambda x: F.concat_ws(".", f"{x}_table", f"{x}_column").alias(x)
    return _overlaps(s, d).select(name("src"), name("tgt"), (F.col("n_src") - F.col("shared")).alias("missing"))


@query(
    "fk_set_equality",
    " UNION ALL ".join(
        f"SELECT '{a}.{x}' AS src, '{b}.{y}' AS tgt, count(DISTINCT {x}) FILTER ({x} NOT IN (SELECT {y} FROM {b})) AS only_source, "
        f"(SELECT count(DISTINCT {y}) FROM {b} WHERE {y} NOT IN (SELECT {x} FROM {a})) AS only_target FROM {a}"
        for a, x, b, y in FKS
    ),
)
def _(s, d):
    name = lambda x: F.concat_ws(".", f"{x}_table", f"{x}_column").alias(x)
    return _overlaps(s, d).select(name("src"), name("tgt"), (F.col("n_src") - F.col("shared")).alias("only_source"), (F.col("n_tgt") - F.col("shared")).alias("only_target"))


def _discovery_sql() -> str:
    one = (
        "SELECT '{s}' AS src_table, '{c}' AS src_column, '{t}' AS tgt_table, '{k}' AS tgt_column "
        "WHERE (SELECT count(*) = count(DISTINCT {k}) FROM {t}) AND NOT EXISTS (SELECT 1 FROM {s} WHERE CAST({c} AS VARCHAR) NOT IN (SELECT CAST({k} AS VARCHAR) FROM {t}))"
    )
    return " UNION ALL ".join(one.format(s=s, c=c, t=t, k=k) for s in COLUMNS for c in COLUMNS[s].split() for t in COLUMNS if t != s for k in COLUMNS[t].split() if bare(c) == bare(k))


@query("fk_discovery", _discovery_sql())
def _(s, d):
    """All columns of all tables; a name is compared without its table's letter."""
    return P.discover_fks(_all(s, d), bare)


#: The rules' input: table, column, is_pk, fk_table, fk_column. It has a link table, self references, tables that merge, a table that is no class.
CATALOG = (
    ("person", "id", 1, None, None),
    ("person", "name", 0, None, None),
    ("person", "boss", 0, "person", "id"),
    ("person_pupil", "id", 1, "person", "id"),
    ("person_staff", "id", 1, "person", "id"),
    ("course", "id", 1, None, None),
    ("course", "title", 0, None, None),
    ("course", "room", 0, "room", "id"),
    ("takes", "pid", 1, "person", "id"),
    ("takes", "cid", 1, "course", "id"),
    ("takes", "tutor", 0, "teacher", "id"),
    ("knows", "one", 1, "teacher", "id"),
    ("knows", "two", 1, "teacher", "id"),
    ("knows", "since", 0, None, None),
    ("exam", "pid", 1, "person", "id"),
    ("exam", "day", 1, None, None),
    ("exam", "mark", 0, None, None),
    ("exam", "room", 0, "room", "id"),
    ("room", "id", 1, None, None),
    ("room", "seats", 0, None, None),
    ("room", "course", 0, None, None),
    ("teacher", "id", 1, None, None),
    ("teacher", "deputy", 0, "teacher", "id"),
    ("grade", "scale", 1, None, None),
    ("grade", "step", 1, None, None),
    ("grade", "word", 0, None, None),
    ("report", "id", 1, None, None),
    ("report", "word", 0, "grade", "word"),
    ("report", "author", 0, "person_staff", "id"),
)
_VALUES = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in CATALOG) + ') c("table", "column", is_pk, fk_table, fk_column)'
#: Of the catalog: c, its rows; t, what the tables are; cls, the classes, merged groups by their greatest common stretch.
_CLASSES = f"""WITH RECURSIVE c AS (SELECT * FROM {_VALUES}),
k AS (SELECT "table", list_sort(list("column") FILTER (is_pk = 1)) AS pk, list_sort(list("column") FILTER (fk_table IS NOT NULL)) AS fk, count(*) AS n, bool_or(is_pk = 0 AND fk_table IS NULL) AS simple FROM c GROUP BY 1),
t AS (SELECT "table", n, simple, coalesce(len(pk), 0) AS n_pk, len(list_intersect(coalesce(pk, []), coalesce(fk, []))) AS n_both, fk IS NOT NULL AND pk = fk AS equal, list_has_all(coalesce(fk, []), coalesce(pk, [])) AS within FROM k),
tie AS (SELECT "table" AS a, fk_table AS b FROM c JOIN t USING ("table") WHERE equal AND fk_table IS NOT NULL),
both_ways AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
grp AS (SELECT a AS "table", min(b) AS comp FROM reach GROUP BY 1),
firsts AS (SELECT comp, min("table") AS f, list("table") AS names FROM grp GROUP BY 1),
stems AS (SELECT comp, names, i, substr(f, i::INT, l::INT) AS stem FROM firsts, range(1, 40) a(i), range(1, 40) b(l) WHERE i + l - 1 <= length(f)),
best AS (SELECT comp, arg_min(stem, (-length(stem), i)) AS class FROM stems WHERE len(list_filter(names, lambda x: NOT contains(x, stem))) = 0 GROUP BY 1),
cls AS (SELECT "table", coalesce(class, array_to_string(list_sort(names), '_')) AS class, 1 AS rule FROM grp JOIN firsts USING (comp) LEFT JOIN best USING (comp)
  UNION ALL SELECT "table", "table", 2 FROM t WHERE (n_pk = 1 OR n_both >= 1 OR (simple AND within)) AND "table" NOT IN (SELECT "table" FROM grp))"""


def catalog(s):
    return s.createDataFrame(CATALOG, "table string, column string, is_pk int, fk_table string, fk_column string")


@query("class_rules", _CLASSES + " SELECT \"table\", class, rule FROM cls")
def _(s, d):
    return R.classes(catalog(s))


_FK = """, f AS (SELECT c.*, t.n, t.n_pk, t.within, x.class AS here, y.class AS there, EXISTS (SELECT 1 FROM c k WHERE k."table" = c.fk_table AND k."column" = c.fk_column AND k.is_pk = 1) AS to_key
FROM c JOIN t USING ("table") LEFT JOIN cls x ON x."table" = c."table" LEFT JOIN cls y ON y."table" = c.fk_table WHERE c.fk_table IS NOT NULL)"""


@query(
    "object_property_rules",
    _CLASSES + _FK + """ SELECT 'r1' AS rule, here AS src, there AS tgt FROM f WHERE is_pk = 0 AND to_key AND here <> there
UNION SELECT 'r1inv', there, here FROM f WHERE is_pk = 0 AND to_key AND here <> there
UNION SELECT 'r2', here, there FROM f WHERE is_pk = 1 AND n_pk > 1 AND n > n_pk AND here <> there
UNION SELECT 'r3', a.there, b.there FROM f a JOIN f b ON a."table" = b."table" WHERE a.within AND a.there <> b.there
UNION SELECT 'r4', there, here FROM f WHERE within AND there <> here
UNION SELECT 'r6', min(there), min(there) FROM f WHERE is_pk = 1 AND within AND n_pk % 2 = 0 GROUP BY "table" HAVING count(DISTINCT coalesce(there, '')) = 1 AND min(there) IS NOT NULL
UNION SELECT 'r7', here, here FROM f WHERE fk_table = "table" AND to_key AND here IS NOT NULL
UNION SELECT 'r8', a.here, b.here FROM f a JOIN f b ON a.fk_table = b.fk_table AND a.fk_column = b.fk_column WHERE a.is_pk = 0 AND b.is_pk = 0 AND a.here <> b.here""",
)
def _(s, d):
    return R.object_property_rules(catalog(s))


_DATA = f"""WITH c AS (SELECT * FROM {_VALUES}),
k AS (SELECT "table", CASE WHEN "column" IN (SELECT "table" FROM c) THEN "column" || '_ATTR' ELSE "column" END AS a FROM c WHERE is_pk = 0 AND fk_table IS NULL)"""


@query(
    "data_property_rules",
    _DATA + """ SELECT "table" AS domain, 'has_' || a AS prop, a AS range FROM k UNION ALL SELECT a, 'has_' || a || '_VALUE', 'xsd:string'
FROM k""",
)
def _(s, d):
    return R.data_property_rules(catalog(s), attributes_to_classes=True)


@query("data_property_rules_direct", _DATA + " SELECT \"table\" AS domain, 'has_' || a AS prop, 'xsd:string' AS range FROM k")
def _(s, d):
    return R.data_property_rules(catalog(s), attributes_to_classes=False)


@query(
    "property_union",
    f"""SELECT 'has_' || "column" AS prop, string_agg(DISTINCT "table", ',' ORDER BY "table") AS domains, 'xsd:string' AS ranges, string_agg(DISTINCT 'r' || is_pk, ',' ORDER BY 'r' || is_pk) AS rules,
string_agg(DISTINCT "table" || '.' || "column", ',' ORDER BY "table" || '.' || "column") AS fields FROM {_VALUES} GROUP BY 1""",
)
def _(s, d):
    rows = catalog(s).select(F.concat(F.lit("has_"), "column").alias("prop"), F.col("table").alias("domain"), F.lit("xsd:string").alias("range"), F.concat(F.lit("r"), F.col("is_pk").cast("string")).alias("rule"), F.concat_ws(".", "table", "column").alias("field"))
    return R.merged_properties(rows).select("prop", *(F.array_join(c, ",").alias(c) for c in ("domains", "ranges", "rules", "fields")))


@query(
    "common_stem",
    """WITH g AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS names FROM part GROUP BY 1),
s AS (SELECT p_type, names, i, substr(names[1], i::INT, l::INT) AS stem FROM g, range(1, 20) a(i), range(1, 20) b(l) WHERE i + l - 1 <= length(names[1]))
SELECT p_type, arg_min(stem, (-length(stem), i)) AS stem FROM s WHERE len(list_filter(names, lambda x: NOT contains(x, stem))) = 0 GROUP BY 1""",
)
def _(s, d):
    return table(s, d, "part").groupBy("p_type").agg(R.stem_of(F.array_sort(F.collect_set("p_brand"))).alias("stem"))
