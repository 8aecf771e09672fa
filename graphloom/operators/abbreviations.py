"""Expansion of abbreviated headers: candidates, similarities, filters, votes.

inventory: sf, lf (short and full forms); vectors: text, v (any embedding). All steps are joins on the short form or the header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine
from graphloom.operators.hierarchy import connected
from graphloom.session import cut

FIRST, SECOND = 0.82, 0.85


def lookups(headers: DataFrame, inventory: DataFrame) -> DataFrame:
    """header, abbrev, lf of the entries that the inventory has. headers: header, entries."""
    entry = headers.select("header", F.explode("entries").alias("abbrev")).distinct()
    return entry.join(inventory.select(F.lower("sf").alias("k"), "lf").distinct(), F.lower("abbrev") == F.col("k")).select("header", "abbrev", "lf")


def longest_prefix(words: DataFrame, inventory: DataFrame) -> DataFrame:
    """word and the longest short form that it begins with: an equi-join with the word's own prefixes, not a comparison of all pairs."""
    prefixes = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda n: F.left(F.col("word"), n))).alias("sf"))
    return prefixes.join(inventory.select("sf").distinct(), "sf").groupBy("word").agg(F.max_by("sf", F.length("sf")).alias("sf"))


def similarities(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """The cosine of an abbreviation and its full form, added as score (0 without vectors)."""
    a, b = vectors.select(F.col("text").alias("abbrev"), F.col("v").alias("va")), vectors.select(F.col("text").alias("lf"), F.col("v").alias("vb"))
    return found.join(a, "abbrev", "left").join(b, "lf", "left").select("header", "abbrev", "lf", F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0)).alias("score"))


def filtered(scored: DataFrame, first: float = FIRST, second: float = SECOND) -> DataFrame:
    """Full forms under the first threshold go. Those under the second go too, from every header, unless some header's own score for the pair reaches it. scored: header, abbrev, lf, score, local."""
    kept = scored.where((F.col("local") > first) | (F.col("score") > first))
    best = F.max("local").over(Window.partitionBy("abbrev", "lf"))
    return kept.withColumn("m", best).where((F.col("m") >= second) | (F.col("score") >= second)).drop("m")


def seeds(scored: DataFrame, alone: float = 0.85, unique: float = 0.90, tied: float = 0.93) -> DataFrame:
    """abbrev, lf that are sure: the only full form over `alone`, the one best over `unique`, or any over `tied`."""
    rows = scored.groupBy("abbrev", "lf").agg(F.max("score").alias("score"))
    w = Window.partitionBy("abbrev")
    rows = rows.select("*", F.count("*").over(w).alias("n"), F.max("score").over(w).alias("top")).withColumn("n_top", F.count_if(F.col("score") == F.col("top")).over(w))
    sure = ((F.col("n") == 1) & (F.col("score") >= alone)) | ((F.col("n_top") == 1) & (F.col("score") == F.col("top")) & (F.col("score") >= unique)) | (F.col("score") >= tied)
    return rows.where(sure).select("abbrev", "lf")


def seed_scores(scored: DataFrame, sure: DataFrame, vectors: DataFrame) -> DataFrame:
    """abbrev, lf and the mean cosine to the seeds of all other abbreviations.

    The mean of cosines is the cosine's dot product with the mean of unit vectors: sums of unit vectors over all seeds, less those of the own
    abbreviation, replace the pairs of candidates and seeds.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors.withColumn("__n", norm).where("__n > 0").select(F.col("text").alias("lf"), F.transform("v", lambda x: x / F.col("__n")).alias("u"))
    parts = sure.join(unit, "lf").select("abbrev", F.posexplode("u").alias("i", "x"))
    own = parts.groupBy("abbrev", "i").agg(F.sum("x").alias("own"), F.count("*").alias("n_own"))
    whole = own.groupBy("i").agg(F.sum("own").alias("all"), F.sum("n_own").alias("n_all"))
    cands = scored.select("abbrev", "lf").distinct().join(unit, "lf").select("abbrev", "lf", F.posexplode("u").alias("i", "x"))
    rest = cands.join(whole, "i").join(own, ["abbrev", "i"], "left")
    n = F.col("n_all") - F.coalesce("n_own", F.lit(0))
    return rest.groupBy("abbrev", "lf").agg(F.sum(F.when(n > 0, F.col("x") * (F.col("all") - F.coalesce("own", F.lit(0.0))) / n)).alias("seed_score"))


def header_votes(cands: DataFrame) -> DataFrame:
    """Each header votes for its best full form by score, and for the one best by both context and seeds. cands: header, abbrev, lf, score, context, seed_score."""
    w = Window.partitionBy("header", "abbrev")
    top = cands.select("*", *(F.max(c).over(w).alias(f"m_{c}") for c in ("score", "context", "seed_score")))
    one = top.where("score = m_score").groupBy("header", "abbrev").agg(F.min("lf").alias("lf"))
    two = top.where("context = m_context and seed_score = m_seed_score").groupBy("header", "abbrev").agg(F.min("lf").alias("lf"))
    return one.unionByName(two)


def elected(votes: DataFrame, groups: DataFrame) -> DataFrame:
    """abbrev, lf of the groups of near-duplicate full forms with most votes; on a tie all of them. votes: abbrev, lf; groups: lf, grp (a full form without one is its own)."""
    rows = votes.join(groups, "lf", "left").withColumn("grp", F.coalesce("grp", "lf"))
    n = rows.groupBy("abbrev", "grp").agg(F.count("*").alias("n"), F.collect_set("lf").alias("lfs")).withColumn("m", F.max("n").over(Window.partitionBy("abbrev"))).where("n = m")
    return n.select("abbrev", F.explode("lfs").alias("lf")).distinct()


def duplicate_groups(forms: DataFrame) -> DataFrame:
    """lf and grp: full forms with the same words in any order, or the same letters once blanks and punctuation are gone; the representative is the shortest, then the least."""
    words = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("lf"), F.lit("[a-z0-9]+"), F.lit(0)))), " ")
    joined = F.regexp_replace(F.lower("lf"), "[^a-z0-9]", "")
    rows = forms.select("lf").distinct().select("lf", F.explode(F.array(F.concat(F.lit("w"), words), F.concat(F.lit("j"), joined))).alias("k"))
    heads = cut(rows.withColumn("head", F.min("lf").over(Window.partitionBy("k"))))
    parts = connected(heads.select(F.col("lf").alias("a"), F.col("head").alias("b")))
    best = F.min(F.struct(F.length("node").alias("l"), "node")).over(Window.partitionBy("comp"))
    return parts.select(F.col("node").alias("lf"), best["node"].alias("grp"))
