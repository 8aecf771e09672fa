"""Headers among their neighbours: contexts, scores by context, groups of candidates, the document of expansions, and what is kept between runs."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine, length_difference, partial_token_sort_ratio, ratio, tokens
from graphloom.operators.hierarchy import connected
from graphloom.session import cut

ALIKE, SIDE = 0.465, 2


def tfidf(texts: list[str]) -> np.ndarray:
    """Cosines of the texts' weights: smoothed idf, unit length, words of two characters or more."""
    words = [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]
    place = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    counts = np.zeros((len(texts), max(1, len(place))))
    for i, ws in enumerate(words):
        for w in ws:
            counts[i, place[w]] += 1
    weights = counts * (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1)
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    weights = weights / np.where(norm == 0, 1, norm)
    return weights @ weights.T


def thinned(chosen: list[int], texts: list[str], abbrevs: list[set[str]], alike: np.ndarray) -> list[int]:
    """Of neighbours that share an abbreviation or much of their words the shortest one stays."""
    left, out = list(chosen), []
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if abbrevs[i] & abbrevs[j] or alike[i, j] >= ALIKE]
            left = [j for j in left if j not in near]
            todo += near
        out.append(min(group, key=lambda i: (len(texts[i]), i)))
    return sorted(out)


def contexts_of(texts: list[str], abbrevs: list[set[str]], clear: list[bool], side: int = SIDE) -> list[list[int]]:
    """Of each header the places of its context: up to `side` clear headers on each side, nearest first, that neither share its abbreviations or words nor served the same abbreviation before.

    Where a side ends early the other gives more; what is alike among those chosen is thinned out, and the search goes on outwards for what that leaves open.
    """
    n, alike = len(texts), tfidf(texts)
    served: dict[str, set[int]] = {}
    out = []
    for at in range(n):
        own = abbrevs[at]
        chosen: list[int] = []
        edge = {-1: at - 1, 1: at + 1}
        inside = lambda i: 0 <= i < n
        while len(chosen) < 2 * side and (inside(edge[-1]) or inside(edge[1])):
            wanted = {-1: side - sum(i < at for i in chosen), 1: side - sum(i > at for i in chosen)}
            if not inside(edge[1]):
                wanted = {-1: wanted[-1] + wanted[1], 1: 0}
            elif not inside(edge[-1]):
                wanted = {-1: 0, 1: wanted[-1] + wanted[1]}
            for step in (-1, 1):
                while inside(edge[step]) and wanted[step] > 0:
                    i = edge[step]
                    if clear[i] and alike[at, i] < ALIKE and not own & abbrevs[i] and all(i not in served.get(a, ()) for a in own):
                        chosen.append(i)
                        wanted[step] -= 1
                    edge[step] += step
            for a in own:
                served.setdefault(a, set()).update(chosen)
            chosen = thinned(sorted(chosen), texts, abbrevs, alike)
        out.append(sorted(chosen))
    return out


def contexts(headers: DataFrame) -> DataFrame:
    """dataset, header, context (a header of the same dataset): one group for each dataset, as wide as it has columns. headers: dataset, position, header, tokenised, abbrevs, clear."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("position")
        found = contexts_of(list(g["tokenised"]), [set(a) for a in g["abbrevs"]], [bool(c) for c in g["clear"]])
        names = list(g["header"])
        return pd.DataFrame([(g["dataset"].iloc[0], names[i], names[j]) for i, js in enumerate(found) for j in js], columns=["dataset", "header", "context"])

    return headers.groupBy("dataset").applyInPandas(run, "dataset string, header string, context string")


def context_scores(cands: DataFrame, near: DataFrame, vectors: DataFrame) -> DataFrame:
    """The candidates with context: the mean cosine of their form and their header's context; null without one. cands: header, form, ...; near: header, context; vectors: text, v."""
    v = lambda c, n: vectors.select(F.col("text").alias(c), F.col("v").alias(n))
    pairs = cands.select("header", "form").distinct().join(near.select("header", "context"), "header").join(v("form", "a"), "form").join(v("context", "b"), "context")
    mean = pairs.groupBy("header", "form").agg(F.avg(cosine(F.col("a"), F.col("b"))).alias("context"))
    return cands.join(mean, ["header", "form"], "left")


def grouped(cands: DataFrame) -> DataFrame:
    """header, grp, whole, score and context (the highest), forms (by score), global_scores (the highest at each place). cands: header, grp, whole, form, score, context, global_scores (array)."""
    one = cands.groupBy("header", "grp", "whole").agg(F.max("score").alias("score"), F.max("context").alias("context"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "form"))), lambda x: x["form"]).alias("forms"))
    each = cands.select("header", "grp", "whole", F.posexplode("global_scores").alias("i", "x")).groupBy("header", "grp", "whole", "i").agg(F.max("x").alias("x"))
    tops = each.groupBy("header", "grp", "whole").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("global_scores"))
    return one.join(tops, ["header", "grp", "whole"], "left")


def expansions_document(headers: DataFrame, cands: DataFrame) -> DataFrame:
    """header and its JSON text: tokenised, abbreviations, candidates with rank and four scores. headers: header, tokenised, abbrevs; cands: header, form, score, global_scores, context, seed_score."""
    w = Window.partitionBy("header").orderBy(F.desc("score"), "form")
    mean = F.aggregate("global_scores", F.lit(0.0), lambda s, x: s + x) / F.size("global_scores")
    one = F.struct((F.row_number().over(w) - 1).alias("rank"), F.col("form").alias("headerFF"), F.col("score").alias("localScore"), mean.alias("meanGlobalScores"), F.col("context").alias("meanLocalCtxScore"), F.col("seed_score").alias("meanGlobalCtxScore"))
    lists = cands.select("header", one.alias("c")).groupBy("header").agg(F.array_sort(F.collect_list("c")).alias("headerCands"))
    none = F.array().cast("array<struct<rank:int,headerFF:string,localScore:double,meanGlobalScores:double,meanLocalCtxScore:double,meanGlobalCtxScore:double>>")
    rows = headers.join(lists, "header", "left").withColumn("headerCands", F.coalesce("headerCands", none))
    return rows.select("header", F.to_json(F.struct("tokenised", "abbrevs", "headerCands"), {"ignoreNullFields": "false"}).alias("value"))


def all_known(headers: DataFrame, before: DataFrame) -> bool:
    """Whether a result saved before has every header, so that it can be used again. Both: header."""
    return headers.select("header").distinct().join(before.select("header"), "header", "left_anti").isEmpty()


def similar(a: Column, b: Column, strict: bool = True, least: float = 95.0) -> Column:
    """Whether two full forms are one: equal letters, equal word sets, or much alike: of about equal length in strict mode, the one in the other else."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    words = lambda c: F.array_sort(F.array_distinct(tokens(c)))
    same = (letters(a) == letters(b)) | (words(a) == words(b))
    alike = (length_difference(letters(a), letters(b)) < 15) & (ratio(letters(a), letters(b)) >= least) if strict else (partial_token_sort_ratio(a, b) >= least) | (ratio(letters(a), letters(b)) >= 95.0)
    return same | alike


def form_groups(forms: DataFrame, strict: bool = True, least: float = 95.0) -> DataFrame:
    """abbrev, lf, grp: near-duplicate full forms of an abbreviation are one group, named by the shortest, of equal ones by that with most blanks. forms: abbrev, lf."""
    rows = forms.select("abbrev", "lf").distinct()
    pairs = rows.alias("x").join(rows.alias("y"), "abbrev").where("x.lf < y.lf").select("abbrev", F.col("x.lf").alias("a"), F.col("y.lf").alias("b"))
    name = lambda c: F.concat_ws("\x1f", "abbrev", c)
    ties = pairs.where(similar(F.col("a"), F.col("b"), strict, least)).select(name("a").alias("a"), name("b").alias("b"))
    parts = connected(cut(ties.unionByName(rows.select(name("lf").alias("a"), name("lf").alias("b")))))
    split = lambda i: F.get(F.split("node", "\x1f"), i)
    named = parts.select("comp", split(0).alias("abbrev"), split(1).alias("lf"))
    blanks = F.size(F.split("lf", " "))
    best = F.min(F.struct(F.length("lf").alias("n"), (-blanks).alias("b"), "lf")).over(Window.partitionBy("comp"))
    return named.select("abbrev", "lf", best["lf"].alias("grp"))


def write_inventory(inventory: DataFrame, folder: str) -> None:
    """The inventory by the first letter of its short forms."""
    inventory.withColumn("letter", F.lower(F.left("sf", F.lit(1)))).write.mode("overwrite").partitionBy("letter").parquet(folder)


def read_inventory(spark: SparkSession, folder: str, headers: DataFrame | None = None) -> DataFrame:
    """The inventory; only the letters that the headers' entries begin with are read. headers: entries. There are as many letters as an alphabet has."""
    rows = spark.read.parquet(folder)
    if headers is None:
        return rows.drop("letter")
    letters = [r.x for r in headers.select(F.explode("entries").alias("e")).select(F.lower(F.left("e", F.lit(1))).alias("x")).distinct().collect()]
    return rows.where(F.col("letter").isin(letters)).drop("letter")


def cached_vectors(spark: SparkSession, folder: str, texts: DataFrame, embed) -> DataFrame:
    """text, v of the texts; those that the folder doesn't hold yet are embedded (embed: a frame of texts to one of text, v) and added to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    wanted = texts.select("text").distinct()
    new = wanted.join(spark.read.parquet(folder).select("text"), "text", "left_anti") if there else wanted
    if not new.isEmpty():
        embed(new).select("text", "v").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(wanted, "text", "left_semi")
