"""Rows to triples along the paths that a refined ontology gives their columns, and what a table's own matches say about its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import is_not_null
from graphloom.operators.kg import BASE, key_text, row_uri


def node_uri(cls: str, table: str, rank: int, keys: list[str], refs: dict[str, tuple[str, str, int]], base: str = BASE) -> Column:
    """The node of a class on a row's paths: the referenced row where a foreign key points to the class's table and is not null, else one of the row's own."""
    out = F.concat(F.lit(f"{base}{cls}_{table}_{rank}_"), key_text(keys))
    for column, (ref_class, ref_table, ref_rank) in refs.items():
        if ref_class == cls:
            out = F.when(is_not_null(F.col(column)), row_uri(ref_table, ref_rank, [column], base)).otherwise(out)
    return out


def path_triples(table: str, cls: str, rows: DataFrame, rank: int, keys: list[str], paths: dict[str, list[str]], datatypes: dict[str, str], refs: dict[str, tuple[str, str, int]], inverses: dict[str, str] | None = None, base: str = BASE) -> DataFrame:
    """s, p, o, o_kind, datatype of every row: its type and comment, and of every column with a value the nodes and edges of its path, ending in a typed literal.

    paths: a column's object properties and classes in turn, a data property last; nodes of one class are one node of a row, whichever column made it. refs: foreign key to (class, table, rank) of
    its target. inverses: only properties that have one get an edge back. Paths are few, as columns are; each row is read once and nothing is shuffled but what nodes of referenced rows repeat.
    """
    lit = lambda x: F.lit(x).cast("string")
    t = lambda s, p, o, kind, datatype=None: F.struct(s.alias("s"), lit(p).alias("p"), o.alias("o"), lit(kind).alias("o_kind"), lit(datatype).alias("datatype"))
    me = row_uri(table, rank, keys, base)
    own, shared = [t(me, "rdf:type", lit(base + cls), "iri"), t(me, "rdfs:comment", lit(table), "lit", "xsd:string")], []
    for column, path in paths.items():
        there, at = is_not_null(F.col(column)), me
        for prop, other in zip(path[:-1:2], path[1::2], strict=True):
            node = node_uri(other, table, rank, keys, refs, base)
            foreign = any(c == other for c, _, _ in refs.values())
            edges = [t(at, prop, node, "iri")] + ([t(node, inverses[prop], at, "iri")] if inverses and prop in inverses else [])
            for e in (*edges, t(node, "rdf:type", lit(base + other), "iri")):
                (shared if foreign else own).append(F.when(there, e))
            at = node
        own.append(F.when(there, t(at, path[-1], F.col(column).cast("string"), "lit", datatypes[path[-1]])))
    # within a row, columns may tell the same edge twice
    whole = rows.select(F.inline(F.array_distinct(F.filter(F.array(*own), lambda x: x.isNotNull()))))
    return whole if not shared else whole.unionByName(rows.select(F.inline(F.filter(F.array(*shared), lambda x: x.isNotNull()))).distinct())


def path_report(paths: DataFrame) -> DataFrame:
    """table and its columns' paths as one text. paths: table, column, step, element."""
    one = paths.groupBy("table", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "element"))), lambda x: x["element"]), " > ").alias("path"))
    return one.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "path"))), lambda x: F.concat_ws(": ", x["column"], x["path"])), "\n").alias("report"))


def table_rules(matches: DataFrame, keys: DataFrame, held: DataFrame) -> DataFrame:
    """What each column keeps once the tables' own matches are known: table, column, obj, cls, data, path, fk_table.

    A column whose class match is its table's keeps its data property only: it is the table's own attribute, and, if its values are a key, one that other tables may point to. A column of another table with
    the name of such a key, whose values the key holds, is a foreign key: it keeps its data property, with the key's class as its path.

    matches: table, table_match, column, obj, cls, data; keys: table, column of candidate keys; held: src_table, src_column, tgt_table, tgt_column of inclusions.
    """
    direct = (F.col("cls") == F.col("table_match")) & F.col("table_match").isNotNull()
    rows = matches.withColumn("direct", F.coalesce(direct, F.lit(False)))
    target = rows.where("direct").join(keys, ["table", "column"], "left_semi").select(F.col("table").alias("tgt_table"), F.col("column").alias("tgt_column"), F.col("table_match").alias("key_class"))
    points = held.join(target, ["tgt_table", "tgt_column"]).where("src_column = tgt_column and src_table <> tgt_table")
    points = points.groupBy(F.col("src_table").alias("table"), F.col("src_column").alias("column")).agg(F.min(F.struct("tgt_table", "key_class")).alias("k"))
    out = rows.join(points, ["table", "column"], "left")
    bare = F.col("direct") | F.col("k").isNotNull()
    return out.select("table", "column", *(F.when(~bare, F.col(c)).alias(c) for c in ("obj", "cls")), "data", F.col("k.key_class").alias("path"), F.col("k.tgt_table").alias("fk_table"))


def templated(rows: DataFrame, subject: str, cls: str | None, predicates: dict[str, str]) -> DataFrame:
    """s, p, o, o_kind of rows by a declarative mapping: a template of the subject with {columns}, its class, and a column or {template} for each predicate; rows with a null in a template give nothing for it."""
    import re

    def filled(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*(F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)))

    s = filled(subject)
    t = lambda p, o, kind: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    parts = [t("rdf:type", F.lit(cls), "iri")] if cls else []
    parts += [t(p, filled(x) if "{" in x else F.col(x).cast("string"), "iri" if "{" in x else "lit") for p, x in predicates.items()]
    return rows.select(s.alias("s"), F.inline(F.filter(F.array(*parts), lambda x: x["o"].isNotNull()))).where("s is not null")


def load_order(catalog: DataFrame) -> list[str]:
    """The tables of a catalog with each after those it points to; of a cycle's tables the least first. One row for each table and foreign key goes to the driver."""
    names = sorted(r.table for r in catalog.select("table").distinct().collect())
    needs: dict[str, set[str]] = {n: set() for n in names}
    for r in catalog.where("fk_table is not null").select("table", "fk_table").distinct().collect():
        if r.fk_table != r.table and r.fk_table in needs:
            needs[r.table].add(r.fk_table)
    out: list[str] = []
    while len(out) < len(names):
        free = [n for n in names if n not in out and needs[n] <= set(out)] or [next(n for n in names if n not in out)]
        out += free
    return out


def deferred_keys(catalog: DataFrame, order: list[str]) -> DataFrame:
    """table, column, why (missing, later, self): foreign keys that can't be written with their row, as the target has no table or comes no sooner. They are updated afterwards."""
    place = catalog.sparkSession.createDataFrame(list(enumerate(order)), "n int, t string")
    fks = catalog.where("fk_table is not null").join(place.select(F.col("t").alias("table"), F.col("n").alias("own")), "table", "left").join(place.select(F.col("t").alias("fk_table"), F.col("n").alias("other")), "fk_table", "left")
    why = F.when(F.col("other").isNull(), "missing").when(F.col("fk_table") == F.col("table"), "self").when(F.col("other") > F.col("own"), "later")
    return fks.select("table", "column", why.alias("why")).where("why is not null")


def declared_order(ddl: DataFrame) -> DataFrame:
    """pos and table of the tables that a script creates, in its order. ddl: text (one row)."""
    said = ddl.select(F.posexplode(F.split("text", ";")).alias("pos", "statement"))
    name = F.regexp_extract("statement", r"(?is)create\s+table\s+if\s+not\s+exists\s+[`\"\[]?([\w.]+)", 1)
    return said.select("pos", name.alias("table")).where("table <> ''")
