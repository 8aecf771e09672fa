"""Queries of scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as X, values as V
from graphloom.registry import query, table


@query(
    "identifier_split",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'order Status ' || o_orderstatus WHEN 1 THEN 'Order ID Of ' || upper(left(o_orderpriority, 1)) ||
'x' ELSE 'plain' END AS words FROM orders""",
)
def _(s, d):
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("orderStatus"), "o_orderstatus")).when(k == 1, F.concat(F.lit("OrderIDOf"), F.upper(F.left("o_orderpriority", F.lit(1))), F.lit("x"))).otherwise("plain")
    return table(s, d, "orders").select("o_orderkey", V.split_identifier(name).alias("words"))


@query("annotation_texts", "SELECT p_partkey, lower(p_name) || ' part size' AS split, lower(p_name) || ' partsize' AS whole FROM part")
def _(s, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_PartSize"))
    return table(s, d, "part").select("p_partkey", V.annotation_text(name, True).alias("split"), V.annotation_text(name).alias("whole"))


@query("thesaurus_tokens", "SELECT p_partkey, replace(p_name, ' ', '|') || '|brand|kind' AS tokens FROM part")
def _(s, d):
    text = F.concat(F.lit("The "), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("'s, of a Brand-12 and kind_7!"))
    return table(s, d, "part").select("p_partkey", F.array_join(F.filter(V.thesaurus_tokens(text), lambda x: x != "s"), "|").alias("tokens"))


@query("tag_codes_named", "SELECT p_partkey, p_brand || ' ' || CASE WHEN p_size % 2 = 0 THEN 'Even' ELSE '(0000,' || p_size || ')' END || ' end' AS text FROM part")
def _(s, d):
    names = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(50), F.lit(2)), lambda i: F.struct(F.concat(F.lit("(0000,"), i.cast("string"), F.lit(")")), F.lit("Even"))))
    text = F.concat("p_brand", F.lit(" (0000,"), F.col("p_size").cast("string"), F.lit(") end"))
    return table(s, d, "part").select("p_partkey", V.named_codes(text, names).alias("text"))


@query(
    "file_names",
    """SELECT c_custkey, 'csv' AS extension, 'f.' || c_custkey AS stem, 'in/' || c_nationkey || '/processed/f.' || c_custkey || '.csv' AS processed
FROM customer""",
)
def _(s, d):
    path = F.concat(F.lit("in/"), F.col("c_nationkey").cast("string"), F.lit("/f."), F.col("c_custkey").cast("string"), F.lit(".csv"))
    return table(s, d, "customer").select("c_custkey", V.file_extension(path).alias("extension"), V.file_stem(path).alias("stem"), V.processed_path(path).alias("processed"))


@query(
    "loader_dates",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 2 THEN strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S')
WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day
FROM orders""",
)
def _(s, d):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 4, "soon")
    for i, f in enumerate(V.LOADER_FORMATS):
        text = text.when(k == i, F.date_format(day, f))
    return table(s, d, "orders").select("o_orderkey", F.date_format(V.loaded_date(text), "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("softmax_share", "SELECT l_orderkey, l_partkey, l_linenumber, round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 6) AS share FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(V.second_share(F.col("l_discount"), F.col("l_tax")), 6).alias("share"))


@query("path_ends", "SELECT page_id, string_split(url, '/')[1] AS first, list_last(string_split(url, '/')) AS last FROM pages")
def _(s, d):
    first, last = V.ends_of(F.split("url", "/"))
    return table(s, d, "pages").select("page_id", first.alias("first"), last.alias("last"))


@query("span_substitution", "SELECT p_partkey, 'Size ' || p_size || substr(p_name, 3) || ' end' AS text FROM part")
def _(s, d):
    text = F.concat("p_name", F.lit(" E.O.F"))
    n = F.length("p_name")
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("new")), F.struct((n + 1).alias("start"), (n + 6).alias("end"), F.lit("end").alias("new")))
    return table(s, d, "part").select("p_partkey", V.substituted(text, spans).alias("text"))


@query(
    "consecutive_runs",
    """WITH x AS (SELECT DISTINCT p_brand, p_size FROM part), g AS (SELECT p_brand, p_size, p_size - row_number() OVER (PARTITION BY p_brand
ORDER BY p_size) AS g FROM x), r AS (SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM g
GROUP BY p_brand, g) SELECT p_brand, string_agg(low || '-' || high, ',' ORDER BY low) AS runs FROM r
GROUP BY 1""",
)
def _(s, d):
    runs = table(s, d, "part").groupBy("p_brand").agg(V.runs_of(F.array_sort(F.collect_set("p_size"))).alias("r"))
    return runs.select("p_brand", F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["low"].cast("string"), x["high"].cast("string"))), ",").alias("runs"))


@query("uniqified", "SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(V.uniqified(F.split("text", " "))).cast("long").alias("n"))


@query(
    "array_product",
    """WITH p AS (SELECT DISTINCT p_type, p_brand FROM part), q AS (SELECT DISTINCT p_type, p_name FROM part)
SELECT p_type, p_brand || ' ' || p_name AS expansion FROM p JOIN q USING (p_type)""",
)
def _(s, d):
    lists = table(s, d, "part").groupBy("p_type").agg(F.array(F.collect_set("p_brand"), F.collect_set("p_name")).alias("options"))
    return lists.select("p_type", F.explode(V.product(F.col("options"))).alias("expansion"))


@query("truth_values", "SELECT doc_id, toxic = 1 AS toxic, CASE WHEN quality = 1 THEN true WHEN doc_id % 2 = 0 THEN false END AS quality FROM labels")
def _(s, d):
    q = F.when(F.col("quality") == 1, "TRUE").when(F.col("doc_id") % 2 == 0, "false").otherwise("no")
    return table(s, d, "labels").select("doc_id", V.value_of_boolean(F.col("toxic").cast("string")).alias("toxic"), V.value_of_boolean(q).alias("quality"))


@query("valid_names", "SELECT page_id, replace(replace(replace(replace(replace(url, '/', '_'), '\\', '_'), '%', '_'), '#', '_'), ' ', '_') AS name FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.valid_name(F.col("url")).alias("name"))


@query(
    "length_differences",
    """WITH n AS (SELECT DISTINCT p_name AS x FROM part) SELECT a.x AS a, b.x AS b, round(abs(length(a.x) - length(b.x)) / ((length(a.x) + length(b.x)) / 2)
* 100, 6) AS difference, round(jaccard(a.x, b.x), 6) AS alike FROM n a JOIN n b ON split_part(a.x, ' ', 1) = split_part(b.x, ' ', 1)
WHERE a.x < b.x""",
)
def _(s, d):
    n = table(s, d, "part").select(F.col("p_name").alias("x"), F.get(F.split("p_name", " "), 0).alias("w")).distinct()
    pairs = n.alias("a").join(n.alias("b"), "w").where("a.x < b.x").select(F.col("a.x").alias("a"), F.col("b.x").alias("b"))
    return pairs.select("a", "b", F.round(X.length_difference(F.col("a"), F.col("b")), 6).alias("difference"), F.round(X.char_jaccard(F.col("a"), F.col("b")), 6).alias("alike"))


@query("fuzzy_ratios")
def _(s, d):
    """Three similarities of the names that share a word; a test compares them with plain ones."""
    n = table(s, d, "part").select(F.col("p_name").alias("x"), F.get(F.split("p_name", " "), 0).alias("w")).distinct()
    pairs = n.alias("a").join(n.alias("b"), "w").where("a.x < b.x").select(F.col("a.x").alias("a"), F.col("b.x").alias("b"))
    return pairs.select("a", "b", X.ratio("a", "b").alias("ratio"), X.partial_ratio("a", "b").alias("partial"), X.partial_token_sort_ratio("a", "b").alias("sorted"))


@query(
    "position_maxima",
    """SELECT p_brand, string_agg(m, ',' ORDER BY i) AS maxima FROM (SELECT p_brand, i, max(CASE i WHEN 0 THEN p_size
WHEN 1 THEN p_partkey % 100 ELSE 50 - p_size END) AS m FROM part, range(3) r(i) GROUP BY ALL) GROUP BY 1""",
)
def _(s, d):
    values = F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 100, 50 - F.col("p_size").cast("long"))
    each = table(s, d, "part").select("p_brand", F.posexplode(values).alias("i", "v")).groupBy("p_brand", "i").agg(F.max("v").alias("m"))
    return each.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"].cast("string")), ",").alias("maxima"))


@query("first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(s, d):
    """The first put of each key stays."""
    best = F.min(F.struct("o_orderkey", "o_orderstatus")).alias("x")
    return table(s, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "x.*")


@query("header_alphabet", "SELECT DISTINCT unnest(string_split(lower(p_name || p_type || p_brand), '')) AS letter FROM part")
def _(s, d):
    return table(s, d, "part").select(F.explode(F.filter(F.split(F.lower(F.concat("p_name", "p_type", "p_brand")), ""), lambda x: x != "")).alias("letter")).distinct()


@query("rows_with_value", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def _(s, d):
    c = table(s, d, "customer")
    return c.join(F.broadcast(c.agg(F.min("c_mktsegment").alias("c_mktsegment"))), "c_mktsegment", "left_semi").select("c_custkey", "c_name")


@query("sorted_candidates", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _(s, d):
    return table(s, d, "orders").orderBy("o_totalprice", "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")
