"""Choice of one (object property, class, data property) for each column out of ranked candidates.

Candidates are rows (key, cand, bes, pj, pj_rank); key names the column. Every step is a join or an aggregate over all
columns at once, so the number of tables and columns doesn't matter. select_triples writes its intermediate
tables (a few rows a column) to the shared folder, so that plans stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

#: Families of XSD types.
DECIMALS = ("xsd:double", "xsd:float", "xsd:decimal")
INTEGERS = ("xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:unsignedInt", "xsd:unsignedShort")
DATES = ("xsd:date", "xsd:dateTime", "xsd:dateTimeStamp", "xsd:time")


def range_fits(own: Column, other: Column, union: Column) -> Column:
    """Whether a column of type own may be mapped to a property of range other (null: any); union: the members of a union range or null. Integers fit decimals, not the other way round."""
    fits = (other == "xsd:string") | (other == own) | (own.isin(*INTEGERS) & other.isin(*INTEGERS, *DECIMALS)) | (own.isin(*DECIMALS) & other.isin(*DECIMALS)) | (own.isin(*DATES) & other.isin(*DATES))
    return F.coalesce(F.array_contains(union, own), other.isNull() | fits)


def related(closed: DataFrame) -> DataFrame:
    """x, y: equal, or one an ancestor of the other. closed: the reflexive closure."""
    pairs = closed.select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
    return pairs.union(pairs.select(F.col("y"), F.col("x"))).distinct()


def confident(cands: DataFrame, least_pj: float, least_bes: float) -> DataFrame:
    return cands.where((F.col("pj") >= least_pj) & (F.col("bes") >= least_bes))


def objects_of_table(objects: DataFrame, tables: DataFrame, domains: DataFrame, rel: DataFrame) -> DataFrame:
    """Object properties whose domain goes with the table's class; without either only those without a domain. tables: key, table_class; domains: prop, domain."""
    rows = objects.join(tables, "key", "left").join(domains.select(F.col("prop").alias("cand"), "domain"), "cand", "left")
    near = rel.select(F.col("x").alias("domain"), F.col("y").alias("table_class"), F.lit(True).alias("near"))
    return rows.join(near, ["domain", "table_class"], "left").where(F.col("domain").isNull() | F.col("near")).select(objects.columns)


def collapsed(cands: DataFrame, closed: DataFrame, most_depth: int) -> DataFrame:
    """Candidates that share an ancestor become one row: key, cand, bes, pj, pj_rank (the best of the group).

    Each candidate goes to its largest group (then the nearest, then the least ancestor). If the ancestor is a member itself, a unique best
    member below it that is no worse takes its place; else a unique best member does; without one the ancestor stands for the group.
    """
    up = cands.join(closed, cands["cand"] == closed["node"]).where(F.col("depth") <= most_depth).select("key", "cand", "ancestor", "depth")
    sizes = up.groupBy("key", "ancestor").agg(F.count("*").alias("size"), F.when(F.min("depth") == 0, 0).otherwise(F.max("depth")).alias("far"))
    best = F.min(F.struct((-F.col("size")).alias("s"), "far", "ancestor")).alias("b")
    home = up.join(sizes, ["key", "ancestor"]).groupBy("key", "cand").agg(best).select("key", "cand", F.col("b.ancestor").alias("ancestor"))
    rows = cands.join(home, ["key", "cand"], "left").withColumn("ancestor", F.coalesce("ancestor", "cand"))
    group = Window.partitionBy("key", "ancestor")
    own = F.col("cand") == F.col("ancestor")
    top = {c: F.max(F.when(own, F.col(c))).over(group) for c in ("pj_rank", "pj")}
    rows = rows.select("*", top["pj_rank"].alias("a_rank"), top["pj"].alias("a_pj")).withColumn("rival", F.coalesce(~own & (F.col("pj_rank") <= F.col("a_rank")) & (F.col("pj") >= F.col("a_pj")), F.col("a_rank").isNull()))
    rows = rows.withColumn("r_min", F.min(F.when(F.col("rival"), F.col("pj_rank"))).over(group)).withColumn("p_max", F.max(F.when(F.col("rival"), F.col("pj"))).over(group))
    win = F.col("rival") & (F.col("pj_rank") == F.col("r_min")) & (F.col("pj") == F.col("p_max"))
    out = rows.groupBy("key", "ancestor").agg(F.count_if(win).alias("n"), F.min(F.when(win, F.col("cand"))).alias("w"), F.max("bes").alias("bes"), F.max("pj").alias("pj"), F.min("pj_rank").alias("pj_rank"))
    return out.select("key", F.when(F.col("n") == 1, F.col("w")).otherwise(F.col("ancestor")).alias("cand"), "bes", "pj", "pj_rank")


def paths(objects: DataFrame, classes: DataFrame, data: DataFrame, ranges: DataFrame, uses: DataFrame, rel: DataFrame) -> DataFrame:
    """key, obj, cls, data that go together: the object's range with the class, the class with a data property it uses. Classes without an object are kept if they have a data property. ranges: prop, range; uses: cls, prop."""
    c = classes.select("key", F.col("cand").alias("cls"))
    used = data.select("key", F.col("cand").alias("data")).join(uses.select("cls", F.col("prop").alias("data")).distinct(), "data")
    c = c.join(used, ["key", "cls"], "left").select("key", "cls", "data")
    reach = objects.select("key", F.col("cand").alias("obj")).join(ranges.select(F.col("prop").alias("obj"), F.col("range").alias("x")), "obj").join(rel, "x").select("key", "obj", F.col("y").alias("cls"))
    whole = reach.join(c, ["key", "cls"]).select("key", "obj", "cls", "data")
    rest = c.where(F.col("data").isNotNull()).join(whole, ["key", "cls"], "left_anti").select("key", F.lit(None).cast("string").alias("obj"), "cls", "data")
    return whole.unionByName(rest)


def optimal(cands: DataFrame, union: bool) -> DataFrame:
    """key, cands: the least pj_rank; of several the highest bes unless a union is allowed. Sorted."""
    least = cands.withColumn("m", F.min("pj_rank").over(Window.partitionBy("key"))).where("pj_rank = m").drop("m")
    if not union:
        least = least.withColumn("m", F.max("bes").over(Window.partitionBy("key"))).where("bes = m")
    return least.groupBy("key").agg(F.array_sort(F.collect_set("cand")).alias("cands"))


def _first(cands: DataFrame, name: str) -> DataFrame:
    """One best candidate of a key: least pj_rank, highest bes, least name."""
    return cands.groupBy("key").agg(F.min(F.struct("pj_rank", (-F.col("bes")).alias("b"), "cand")).alias("m")).select("key", F.col("m.cand").alias(name))


def select_paths(found: DataFrame, objects: DataFrame, classes: DataFrame, data: DataFrame, ranges: DataFrame, uses: DataFrame) -> DataFrame:
    """key, obj, cls, data of the best path. A key where several objects and several classes are on top is left out."""
    o = objects.select("key", F.col("cand").alias("obj"), F.col("pj_rank").alias("o_rank"))
    c = classes.select("key", F.col("cand").alias("cls"), F.col("pj_rank").alias("c_rank"))
    p = found.join(c, ["key", "cls"]).join(o, ["key", "obj"], "left").withColumn("total", F.coalesce(F.col("o_rank").cast("long"), F.lit(2147483647)) + F.col("c_rank"))
    w = Window.partitionBy("key")
    p = p.select("*", F.min("o_rank").over(w).alias("mo"), F.min("c_rank").over(w).alias("mc"), F.min("total").over(w).alias("mt"))
    tops = p.groupBy("key").agg(F.collect_set(F.when((F.col("o_rank") == F.col("mo")) | (F.col("total") == F.col("mt")), F.col("obj"))).alias("os"), F.collect_set(F.when((F.col("c_rank") == F.col("mc")) | (F.col("total") == F.col("mt")), F.col("cls"))).alias("cs"))
    tops = cut(tops.where((F.size("os") <= 1) | (F.size("cs") <= 1)).select("key", F.when(F.size("os") == 1, F.col("os")[0]).alias("obj1"), F.when(F.size("cs") == 1, F.col("cs")[0]).alias("cls1")))
    led = p.join(tops, "key")
    by_obj = classes.join(led.where("obj = obj1").select("key", F.col("cls").alias("cand")).distinct(), ["key", "cand"])
    by_cls = objects.join(led.where("cls = cls1 and obj1 is null and obj is not null").select("key", F.col("obj").alias("cand")).distinct(), ["key", "cand"])
    got = cut(tops.join(_first(by_obj, "c2"), "key", "left").join(_first(by_cls, "o2"), "key", "left").select("key", F.coalesce("obj1", "o2").alias("obj"), F.coalesce("c2", "cls1").alias("cls")))
    on_path = found.join(got.withColumnsRenamed({"obj": "go", "cls": "gc"}), "key").where((F.col("cls") == F.col("gc")) & (F.col("go").isNull() | F.col("obj").eqNullSafe(F.col("go"))) & F.col("data").isNotNull())
    direct = data.join(on_path.select("key", F.col("data").alias("cand")).distinct(), ["key", "cand"])
    return got.join(_first(direct.unionByName(_usable(data, got, ranges, uses).join(direct.select("key").distinct(), "key", "left_anti")), "data"), "key", "left")


def _usable(data: DataFrame, got: DataFrame, ranges: DataFrame, uses: DataFrame) -> DataFrame:
    """Data properties that the chosen class uses, or else the object's range; without either all."""
    home = got.join(ranges.select(F.col("prop").alias("obj"), "range"), "obj", "left").select("key", F.coalesce("cls", "range").alias("home"))
    fit = data.join(home, "key").join(uses.select(F.col("cls").alias("home"), F.col("prop").alias("cand"), F.lit(True).alias("uses")).distinct(), ["home", "cand"], "left")
    return fit.where(F.col("home").isNull() | F.col("uses")).select(data.columns)


def select_apart(objects: DataFrame, classes: DataFrame, data: DataFrame, tables: DataFrame, ranges: DataFrame, uses: DataFrame, rel: DataFrame) -> DataFrame:
    """Where no path exists: the best object and the best class vote by bes and pj; the loser goes unless they are compatible. key, obj, cls, data."""
    pick = lambda df, n: df.groupBy("key").agg(F.min(F.struct("pj_rank", (-F.col("bes")).alias("b"), "cand", "bes", "pj")).alias(n))
    both = pick(objects, "o").join(pick(classes, "c"), "key", "full").join(ranges.select(F.col("prop").alias("rp"), F.col("range").alias("rr")), F.col("o.cand") == F.col("rp"), "left")
    both = both.join(rel.select("x", F.col("y").alias("ry"), F.lit(True).alias("near")), (F.col("rr") == F.col("x")) & (F.col("c.cand") == F.col("ry")), "left")
    near = F.col("rr").isNull() | F.coalesce("near", F.lit(False))
    win = lambda a, b: sum(((F.col(f"{a}.{k}") >= F.col(f"{b}.{k}")).cast("int") for k in ("bes", "pj")), F.lit(0))
    contest = F.col("o").isNotNull() & F.col("c").isNotNull() & ~near
    got = both.select("key", F.when(~(contest & (win("o", "c") < win("c", "o"))), F.col("o.cand")).alias("obj"), F.when(~(contest & (win("o", "c") > win("c", "o"))), F.col("c.cand")).alias("cls"))
    got = cut(got.join(data.select("key").distinct(), "key", "full").select("key", "obj", "cls"))
    home = got.join(tables, "key", "left")
    fit = _usable(data, home.where("obj is not null or cls is not null or table_class is null").select("key", "obj", "cls").unionByName(home.where("obj is null and cls is null and table_class is not null").select("key", "obj", F.col("table_class").alias("cls"))), ranges, uses)
    return got.join(_first(fit, "data"), "key", "left")


def select_triples(objects: DataFrame, classes: DataFrame, data: DataFrame, tables: DataFrame, domains: DataFrame, ranges: DataFrame, uses: DataFrame, closed: DataFrame, least_pj: float, least_bes: float, most_depth: int) -> DataFrame:
    """The whole choice: key, obj, cls, data. data is expected to hold only properties whose range fits (range_fits)."""
    rel = cut(related(closed))
    objects = cut(collapsed(objects_of_table(confident(objects, least_pj, least_bes), tables, domains, rel), closed, most_depth))
    classes, data = cut(collapsed(confident(classes, least_pj, least_bes), closed, most_depth)), confident(data, least_pj, least_bes)
    found = cut(paths(objects, classes, data, ranges, uses, rel))
    rest = [x.join(found.select("key").distinct(), "key", "left_anti") for x in (objects, classes, data)]
    return select_paths(found, objects, classes, data, ranges, uses).unionByName(select_apart(*rest, tables, ranges, uses, rel))


def compatible(closed: DataFrame, unions: DataFrame, disjoint: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """x, y that go together: related classes, members of a union standing for it; with others (x, y) given, also those of them that nothing says are disjoint. unions: node, member; disjoint: x, y."""
    rel = related(closed)
    member = unions.select(F.col("member").alias("m"), F.col("node").alias("u"))
    lifted = rel.join(member, F.col("x") == F.col("m")).select(F.col("u").alias("x"), "y")
    both = rel.unionByName(lifted).unionByName(lifted.select(F.col("y").alias("x"), F.col("x").alias("y")))
    if others is not None and disjoint is not None:
        apart = disjoint.select("x", "y").unionByName(disjoint.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
        both = both.unionByName(others.select("x", "y").join(apart, ["x", "y"], "left_anti"))
    return both.distinct()


def used_properties(restrictions: DataFrame, domains: DataFrame, closed: DataFrame, closed_properties: DataFrame, rel: DataFrame) -> DataFrame:
    """cls, prop: the data properties that a class uses: its domain goes with the class, or the class or an ancestor of it has a restriction on the property or on one above it.

    restrictions: cls, prop; domains: prop, domain; closed, closed_properties: reflexive closures; rel: x, y.
    """
    by_domain = domains.join(rel.select(F.col("x").alias("domain"), F.col("y").alias("cls")), "domain").select("cls", "prop")
    up = closed.select(F.col("node").alias("cls"), F.col("ancestor").alias("up")).join(restrictions.select(F.col("cls").alias("up"), F.col("prop").alias("above")), "up").select("cls", "above")
    below = closed_properties.select(F.col("node").alias("prop"), F.col("ancestor").alias("above"))
    return by_domain.unionByName(up.join(below, "above").select("cls", "prop")).distinct()
