"""Alignment of two ontologies by their labels: exact matches first, then candidates by idf and a scorer, extension over neighbours, ranked candidates, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import levenshtein_similarity, partial_ratio, tokens
from graphloom.operators.matching import extend_one_hop, idf_pool, postings, suitable
from graphloom.session import cut


@dataclass(frozen=True)
class Settings:
    """How an alignment runs."""

    properties: tuple[str, ...] = ("rdfs:label", "skos:prefLabel", "skos:altLabel")
    scorer: str = "levenshtein"
    pool: int = 200
    best: int = 20
    floor: float = 0.85
    extend: float = 0.85
    keep: float = 0.90
    rounds: int = 10
    tolerance: float = 0.1


#: Presets by the kind of dataset.
PRESETS = {"default": Settings(), "health": Settings(properties=("rdfs:label", "skos:prefLabel", "skos:altLabel", "skos:hiddenLabel")), "finance": Settings(properties=("rdfs:label", "skos:prefLabel", "skos:altLabel", "skos:definition"))}


def preset(domain: str) -> Settings:
    return PRESETS.get(domain.lower(), PRESETS["default"])


#: Scorers of two labels by name; others may be added.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"levenshtein": levenshtein_similarity, "exact": lambda a, b: (a == b).cast("double"), "partial": lambda a, b: partial_ratio(a, b) / 100}
#: Ways to cut a text into tokens, by name.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words": tokens, "characters": lambda c: F.filter(F.split(F.lower(c), ""), lambda x: x.rlike("[a-z0-9]")), "blanks": lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")}


def string_matches(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """src, tgt, score 1: all pairs with a label in common. src, tgt: entity, label. A label that many entities have on both sides is matched with each of them, as each is a match."""
    return src.select(F.col("entity").alias("src"), "label").join(tgt.select(F.col("entity").alias("tgt"), "label"), "label").select("src", "tgt").distinct().withColumn("score", F.lit(1.0))


def candidates(src: DataFrame, tgt: DataFrame, pool: int, tokenizer: str = "words") -> DataFrame:
    """src, tgt: the pool of each source by the summed idf of shared tokens, over all its labels."""
    cut_up = TOKENIZERS[tokenizer]
    asked = src.select(F.col("entity").alias("src"), F.explode(cut_up(F.col("label"))).alias("token"))
    post = postings(tgt, "entity", "label") if tokenizer == "words" else tgt.select("entity", F.explode(cut_up(F.col("label"))).alias("token")).groupBy("token", "entity").agg(F.count("*").alias("tf"))
    return idf_pool(asked, post, tgt.agg(F.countDistinct("entity").alias("d")), pool).select("src", F.col("entity").alias("tgt"))


def label_pairs(pairs: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """src, tgt, a, b: every label of the one with every label of the other, for the given pairs."""
    return pairs.join(src.select(F.col("entity").alias("src"), F.col("label").alias("a")), "src").join(tgt.select(F.col("entity").alias("tgt"), F.col("label").alias("b")), "tgt").select("src", "tgt", "a", "b")


def scored(pairs: DataFrame, src: DataFrame, tgt: DataFrame, scorer: str, mean: bool = False) -> DataFrame:
    """src, tgt, score: the highest score of their label pairs, or the mean."""
    one = SCORERS[scorer](F.col("a"), F.col("b"))
    return label_pairs(pairs, src, tgt).groupBy("src", "tgt").agg(F.round(F.avg(one) if mean else F.max(one), 6).alias("score"))


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """The k best targets of each source, with their rank."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), "tgt")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def low_score_ranks(rows: DataFrame) -> DataFrame:
    """Dense rank by score and length, best first; rows without any score stay unranked. rows: src, tgt, score, length."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), F.desc("length"))
    some = rows.where("score > 0").withColumn("rank", F.dense_rank().over(w))
    return some.unionByName(rows.where("score <= 0 or score is null").withColumn("rank", F.lit(None).cast("int")))


def predict(src: DataFrame, tgt: DataFrame, how: Settings = PRESETS["default"]) -> DataFrame:
    """src, tgt, score, rank, way (string, scored, low).

    Sources with a label in common with any target take these; the others their best candidates at the floor or above; those with none take what the scan for low scores keeps of their best.
    """
    exact = cut(string_matches(src, tgt))
    open_ = src.join(exact.select(F.col("src").alias("entity")).distinct(), "entity", "left_anti")
    rows = cut(best_of(scored(candidates(open_, tgt, how.pool), open_, tgt, how.scorer), how.best))
    good = rows.where(F.col("score") >= how.floor)
    low = rows.join(good.select("src").distinct(), "src", "left_anti").join(tgt.groupBy(F.col("entity").alias("tgt")).agg(F.max(F.length("label")).alias("length")), "tgt")
    ranked = low_score_ranks(low.drop("rank")).where("rank is not null")
    order = Window.partitionBy("src").orderBy(F.desc("score"), "tgt")
    placed = ranked.withColumn("pos", F.row_number().over(order))
    kept = suitable(placed.select("src", "pos", "rank", "score"), how.tolerance).join(placed, ["src", "pos"])
    way = lambda d, name: d.select("src", "tgt", "score", F.lit(name).alias("way"))
    every = way(exact, "string").unionByName(way(good, "scored")).unionByName(way(kept, "low"))
    return best_of(every, how.best)


def predict_kinds(src: DataFrame, tgt: DataFrame, how: Settings = PRESETS["default"]) -> DataFrame:
    """The same for every kind of entity that both sides have, one kind matching only its own. src, tgt: kind, entity, label."""
    kinds = [r.kind for r in src.select("kind").distinct().join(tgt.select("kind").distinct(), "kind").orderBy("kind").collect()]  # a handful: kinds of entities
    own = lambda d, k: d.where(F.col("kind") == k).select("entity", "label")
    return reduce(DataFrame.unionByName, [predict(own(src, k), own(tgt, k), how).withColumn("kind", F.lit(k)) for k in kinds])


def extend(mappings: DataFrame, src: DataFrame, tgt: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, how: Settings = PRESETS["default"]) -> DataFrame:
    """The mappings with what parents and children of mapped pairs bring, at most `rounds` times: each round starts from the new pairs at `extend` or above, scored by the mean of their labels; at the end those at `keep` or above stay.

    mappings: src, tgt, score; edges: child, parent.
    """
    found = cut(mappings.select("src", "tgt", "score"))
    frontier = found.where(F.col("score") >= how.extend).select("src", "tgt")
    for _ in range(how.rounds):
        new = extend_one_hop(frontier, src_edges, tgt_edges).join(found, ["src", "tgt"], "left_anti")
        new = cut(scored(new, src, tgt, how.scorer, mean=True).where(F.col("score") >= how.extend))
        if new.isEmpty():
            break
        found, frontier = cut(found.unionByName(new)), new.select("src", "tgt")
    return found.where(F.col("score") >= how.keep)


def repair_lines(mappings: DataFrame, kind: str = "CLS") -> DataFrame:
    """src|tgt|=|score|kind, the form that repair tools read."""
    return mappings.select(F.concat_ws("|", "src", "tgt", F.lit("="), F.col("score").cast("string"), F.lit(kind)).alias("line"))


def partial_scores(pairs: DataFrame) -> DataFrame:
    """src, tgt, pj, pj_perc, c_len of the label pair with the highest pj_perc (then the longest, then the least).

    pj: the share of the target label's tokens, has and is left out, that the source label holds whole (those of one character are in the divisor only); pj_perc: their mean partial ratio.
    pairs: src, tgt, a (source label), b (target label).
    """
    words = F.filter(tokens(F.col("b")), lambda x: ~x.isin("has", "is"))
    rows = pairs.distinct().withColumn("t", words).withColumn("n", F.size("t"))
    each = rows.where("n > 0").select("src", "tgt", "a", "b", "n", F.explode("t").alias("x")).withColumn("r", partial_ratio(F.lower("a"), F.col("x")))
    whole = F.sum(((F.length("x") > 1) & F.contains(F.lower(F.col("a")), F.col("x"))).cast("int"))
    per = each.groupBy("src", "tgt", "a", "b").agg(F.round(whole / F.first("n"), 6).alias("pj"), F.round(F.avg("r"), 6).alias("pj_perc"))
    none = rows.where("n = 0").select("src", "tgt", "a", "b", F.lit(0.0).alias("pj"), F.lit(0.0).alias("pj_perc"))
    best = F.max(F.struct("pj_perc", F.length("b").alias("c_len"), "pj")).alias("x")
    return per.unionByName(none).groupBy("src", "tgt").agg(best).select("src", "tgt", "x.pj", "x.pj_perc", F.col("x.c_len").cast("long").alias("c_len"))


def candidate_document(predictions: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """src, tgt, bes (score in percent), bes_rank, pj, pj_perc, pj_rank, c_len of every predicted pair."""
    pairs = predictions.select("src", "tgt", F.round(F.col("score") * 100, 4).alias("bes"))
    rows = pairs.join(partial_scores(label_pairs(pairs, src, tgt)), ["src", "tgt"])
    bes, pj = Window.partitionBy("src").orderBy(F.desc("bes"), "tgt"), Window.partitionBy("src").orderBy(F.desc("pj"), F.desc("c_len"))
    return rows.withColumn("bes_rank", F.row_number().over(bes).cast("long")).withColumn("pj_rank", F.dense_rank().over(pj).cast("long"))


def candidate_json(rows: DataFrame) -> DataFrame:
    """src and its ranked candidates as one JSON text."""
    one = F.struct("bes_rank", F.col("tgt").alias("candidate"), "bes", "pj", "pj_perc", "pj_rank")
    return rows.groupBy("src").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("candidates"))


def top(mappings: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """The k mappings of the highest (or lowest) score."""
    return mappings.orderBy(F.desc("score") if descending else F.asc("score"), "src", "tgt").limit(k)


def evaluation(predictions: DataFrame, reference: DataFrame, ignored: DataFrame) -> DataFrame:
    """precision, recall and F1 (3 places), the ignored pairs taken off both sides. All: src, tgt."""
    left = lambda d: d.select("src", "tgt").distinct().join(ignored.select("src", "tgt"), ["src", "tgt"], "left_anti")
    p, r = left(predictions).withColumn("p", F.lit(1)), left(reference).withColumn("r", F.lit(1))
    n = p.join(r, ["src", "tgt"], "full").agg(F.count("p").alias("n_p"), F.count("r").alias("n_r"), F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("tp"))
    pre, rec = F.try_divide("tp", "n_p"), F.try_divide("tp", "n_r")
    return n.select("tp", F.round(pre, 3).alias("precision"), F.round(rec, 3).alias("recall"), F.round(F.try_divide(2 * pre * rec, pre + rec), 3).alias("f1"))


def hits(ranked: DataFrame, reference: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Hits@k and MRR (3 places) of a reference's targets among ranked candidates (src, tgt, rank); a target that isn't there counts as a miss."""
    rows = reference.select("src", "tgt").distinct().join(ranked.select("src", "tgt", "rank"), ["src", "tgt"], "left")
    at = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 3).alias(f"hits{k}") for k in ks]
    return rows.agg(*at, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"))


def label_profile(labels: DataFrame) -> DataFrame:
    """Entities, labels, labels an entity (3 places), and the length profile of labels in tokens: mean, maximum, shares up to 128, 256 and 512. labels: entity, label."""
    n = F.size(tokens(F.col("label")))
    share = [F.round(F.avg((n <= k).cast("int")), 3).alias(f"within_{k}") for k in (128, 256, 512)]
    return labels.agg(F.countDistinct("entity").alias("entities"), F.count("*").alias("labels"), F.round(F.count("*") / F.countDistinct("entity"), 3).alias("per_entity"), F.round(F.avg(n), 3).alias("mean_tokens"), F.max(n).alias("max_tokens"), *share)


def decorated(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """element, position, tgt, score, labels: an element's matches in order of their score, with the targets' labels. matches: element, tgt, score; labels: entity, label."""
    named = labels.groupBy(F.col("entity").alias("tgt")).agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))
    w = Window.partitionBy("element").orderBy(F.desc("score"), "tgt")
    return matches.join(named, "tgt", "left").select("element", F.row_number().over(w).cast("long").alias("position"), "tgt", "score", F.coalesce("labels", F.lit("")).alias("labels"))


def attached(mappings: DataFrame, matches: DataFrame) -> DataFrame:
    """Each mapping with the ordered list of its element's matches (tgt, score, rank); empty where there are none."""
    own = matches.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("rank", "tgt", "score"))).alias("matches"))
    return mappings.join(own, "element", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<rank:int,tgt:string,score:double>>")))


def set_matches(mappings: DataFrame, selected: DataFrame) -> DataFrame:
    """The mappings with the matches and the path selected for their element; what was there before goes to initial_match. selected: element, tgt (one or several rows), path."""
    chosen = selected.groupBy("element").agg(F.array_sort(F.collect_set("tgt")).alias("__match"), F.first("path", ignorenulls=True).alias("__path"))
    rows = mappings.join(chosen, "element", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("initial_match", F.coalesce("match", none)).withColumn("match", F.coalesce("__match", "match", none)).withColumn("path", F.coalesce("__path", "path", none)).drop("__match", "__path")


def stored(puts: DataFrame) -> DataFrame:
    """The last put of each element that isn't empty: element, match, path. puts: element, seq, match, path; a null path keeps the one put before."""
    some = F.when(F.size("match") > 0, F.struct("seq", "match"))
    way = F.when(F.col("path").isNotNull(), F.struct("seq", "path"))
    return puts.groupBy("element").agg(F.max(some)["match"].alias("match"), F.max(way)["path"].alias("path"))


def held_by_all(cands: DataFrame) -> DataFrame:
    """key, cand: the candidates that every domain of a key has. cands: key, domain, cand."""
    n = cands.groupBy("key").agg(F.countDistinct("domain").alias("n"))
    return cands.groupBy("key", "cand").agg(F.countDistinct("domain").alias("m")).join(n, "key").where("m = n").select("key", "cand")


def neighbours_apart(near: DataFrame, known: DataFrame) -> DataFrame:
    """The neighbours that aren't known yet. Both: node, other."""
    return near.select("node", "other").distinct().join(known, ["node", "other"], "left_anti")
