"""Hierarchies and graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut


def closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """node, ancestor and least depth. edges: child, parent; cycles do no harm.

    Each round doubles the depth that is known: a shortest path of 2^k + j steps is one of exactly 2^k steps and one of at most 2^k. So the rounds grow with the
    logarithm of the greatest depth, and a round joins only pairs at the greatest depth known.
    """
    e = edges.select("child", "parent").distinct()
    found = cut(e.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        far = found.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("mid"))
        near = found.select(F.col("node").alias("mid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        step = far.join(near, "mid").where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        new = cut(step.join(found, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        found, reach = cut(found.unionByName(new)), 2 * reach
    if not reflexive:
        return found
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    return found.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def top_superclass(closed: DataFrame) -> DataFrame:
    """The farthest ancestor of each node; of several the least."""
    best = F.min(F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("a")))
    return closed.groupBy("node").agg(best.alias("b")).select("node", F.col("b.a").alias("top"), (-F.col("b.d")).alias("depth"))


def inherited(closed: DataFrame, own: DataFrame) -> DataFrame:
    """The nearest value on the way up. own: node, value."""
    got = closed.join(own.withColumnRenamed("node", "ancestor"), "ancestor")
    return got.groupBy("node").agg(F.min(F.struct("depth", "value")).alias("b")).select("node", "b.value", "b.depth")


def common_ancestors(closed: DataFrame, candidates: DataFrame, most_depth: int) -> DataFrame:
    """Ancestors that two candidates or more share within a depth: ancestor, number of candidates, greatest depth."""
    near = closed.join(candidates, "node").where(F.col("depth") <= most_depth)
    return near.groupBy("ancestor").agg(F.count("*").alias("n_members"), F.max("depth").alias("max_depth")).where("n_members > 1")


def largest_groups(closed: DataFrame, candidates: DataFrame, most_depth: int) -> DataFrame:
    """Each candidate in its largest group (then the nearest, then the least ancestor); a candidate without company is its own."""
    groups = common_ancestors(closed, candidates, most_depth)
    near = closed.join(candidates, "node").where(F.col("depth") <= most_depth).join(groups, "ancestor")
    best = near.groupBy("node").agg(F.min(F.struct((-F.col("n_members")).alias("n"), "depth", "ancestor")).alias("b")).select("node", F.col("b.ancestor").alias("grp"))
    return candidates.select("node").join(best, "node", "left").withColumn("grp", F.coalesce("grp", "node"))


def siblings(edges: DataFrame) -> DataFrame:
    """Children of one parent, where there are two or more."""
    return edges.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"), F.countDistinct("child").alias("n")).where("n > 1")


def prune(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The hierarchy without the nodes gone: their children become children of their nearest remaining ancestors, however long the chain of nodes gone."""
    removed = gone.select(F.col("node").alias("x")).distinct()
    left = edges.select("child", "parent").join(removed, F.col("child") == F.col("x"), "left_anti")
    up = edges.select(F.col("child").alias("x"), F.col("parent").alias("up")).join(removed, "x")
    inside = closure(up.join(removed.withColumnRenamed("x", "up"), "up").select(F.col("x").alias("child"), F.col("up").alias("parent")))
    beyond = up.join(removed.select(F.col("x").alias("up")), "up", "left_anti")
    through = inside.select(F.col("node").alias("parent"), F.col("ancestor").alias("x")).unionByName(removed.select(F.col("x").alias("parent"), "x")).join(beyond, "x").select("parent", "up").distinct()
    moved = left.join(through, "parent").select("child", F.col("up").alias("parent"))
    return left.join(removed, F.col("parent") == F.col("x"), "left_anti").unionByName(moved).where("child <> parent").distinct()


#: Parts that the edges of one node are dealt in.
SALTS = 256


def with_least(edges: DataFrame) -> DataFrame:
    """a, b and m, the least b of each a. A node's edges are dealt in SALTS parts, of which only those there come back with m, so no task holds all edges of a node."""
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("a", "s").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return dealt.join(parts.select("a", "m", F.explode("s").alias("s")), ["a", "s"]).select("a", "b", "m")


def connected(edges: DataFrame) -> DataFrame:
    """node and the least node of its part; edges: a, b.

    Large and small stars in turn, until nothing changes: first each node's greater neighbours are tied to its least one, then its lesser ones. Edges never
    become more, and the rounds grow with the logarithm of a part's size.
    """
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    now, state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = with_least(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        tied = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        now = cut(with_least(large).select(F.inline(tied)).where("a <> b").distinct())
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    comp = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    roots = now.select(F.col("b").alias("node")).unionByName(alone).distinct().join(comp, "node", "left_anti")
    return comp.unionByName(roots.withColumn("comp", F.col("node")))
