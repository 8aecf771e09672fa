"""Training pairs of labels and of classes, drawn from an ontology. Draws depend on an md5 order and a seed, so that a rerun draws the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut
from graphloom.sources.tabular import with_surrogate_key


def _numbered(rows: DataFrame, order: Column) -> DataFrame:
    """Rows with __i from 0 in an order; numbered in range partitions, so no task sees them all."""
    return with_surrogate_key(rows.withColumn("__k", order), "__k", "__i").withColumn("__i", F.col("__i").cast("long") - 1).drop("__k")


def _digest(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def synonyms(labels: DataFrame) -> DataFrame:
    """a, b: labels of one entity, each with itself and both ways round. labels: entity, label."""
    x = labels.select("entity", F.col("label").alias("a")).distinct()
    return x.join(x.withColumnRenamed("a", "b"), "entity").select("a", "b").distinct()


def soft_negatives(labels: DataFrame, ratio: int, seed: int = 0) -> DataFrame:
    """a, b of different entities: in a shuffled ring each label meets the next `ratio` ones. Pairs that are synonyms are left out; no pair of all labels is formed."""
    rows = _numbered(labels.select("entity", "label").distinct(), _digest(seed, "entity", "label"))
    n = rows.count()
    mate = rows.select(F.col("entity").alias("e2"), F.col("label").alias("b"), F.col("__i").alias("__j"))
    step = rows.withColumn("__s", F.explode(F.sequence(F.lit(1), F.lit(ratio)))).withColumn("__j", (F.col("__i") + F.col("__s")) % F.lit(max(n, 1)))
    pairs = step.join(mate, "__j").where("entity <> e2").select(F.col("label").alias("a"), "b").distinct()
    return pairs.join(synonyms(labels), ["a", "b"], "left_anti")


def hard_negatives(labels: DataFrame, edges: DataFrame, ratio: int, seed: int = 0) -> DataFrame:
    """a, b of sibling classes: children are shuffled within their parent and each meets the next `ratio` siblings. All parents are numbered in one order, so a parent with very many children isn't one task's work."""
    kids = edges.select("parent", F.col("child").alias("entity")).distinct().join(labels.select("entity", "label").distinct(), "entity")
    rows = _numbered(kids, F.concat_ws("\x00", F.col("parent"), _digest(seed, "entity", "label")))
    mate = rows.select(F.col("parent").alias("p2"), F.col("entity").alias("e2"), F.col("label").alias("b"), F.col("__i").alias("__j"))
    step = rows.withColumn("__s", F.explode(F.sequence(F.lit(1), F.lit(ratio)))).withColumn("__j", F.col("__i") + F.col("__s"))
    pairs = step.join(mate, "__j").where("parent = p2 and entity <> e2").select(F.col("label").alias("a"), "b").distinct()
    return pairs.join(synonyms(labels), ["a", "b"], "left_anti")


def cross_synonyms(mappings: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """a, b: labels of mapped entities both ways round, without equal ones. mappings: src, tgt."""
    x = mappings.join(source.select(F.col("entity").alias("src"), F.col("label").alias("a")), "src").join(target.select(F.col("entity").alias("tgt"), F.col("label").alias("b")), "tgt").where("a <> b").select("a", "b")
    return x.union(x.select("b", "a")).distinct()


def corpus(positives: list[DataFrame], negatives: list[DataFrame]) -> DataFrame:
    """a, b, is_synonym: all sub-corpora together; what is a synonym anywhere is no negative."""
    whole = lambda frames: reduce(DataFrame.unionByName, frames).distinct()
    pos = cut(whole(positives))
    return pos.withColumn("is_synonym", F.lit(True)).unionByName(whole(negatives).join(pos, ["a", "b"], "left_anti").withColumn("is_synonym", F.lit(False)))


def subsumptions(mappings: DataFrame, target_edges: DataFrame) -> DataFrame:
    """src, tgt: each source lies below the parents of its equivalent; no order of the mappings matters."""
    return mappings.join(target_edges.select(F.col("child").alias("tgt"), "parent"), "tgt").select("src", F.col("parent").alias("tgt")).distinct()


def assumed_disjoint(pairs: DataFrame, closed: DataFrame, instances: DataFrame) -> DataFrame:
    """Pairs x, y with no subsumption either way, no common descendant and no common instance. closed: reflexive closure; instances: node, instance."""
    below = closed.select(F.col("node").alias("n"), F.col("ancestor").alias("c"))
    shares = lambda who, held: who.join(held.select(F.col("c").alias("x"), "n"), "x").join(held.select(F.col("c").alias("y"), "n"), ["y", "n"], "left_semi").select("x", "y").distinct()
    held = below.unionByName(instances.select(F.concat(F.lit("i:"), F.col("instance")).alias("n"), F.col("node").alias("m")).join(below.select(F.col("n").alias("m"), "c"), "m").select("n", "c")).distinct()
    x = pairs.select("x", "y").distinct()
    return x.join(shares(x, held), ["x", "y"], "left_anti")


def negatives_of(references: DataFrame, pool: DataFrame, closed: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """src, cand: k drawn candidates of a source's pool that are neither its target nor an ancestor of it. references: src, tgt; pool: src, cand."""
    bad = references.unionByName(references.join(closed.where("depth > 0"), F.col("tgt") == F.col("node")).select("src", F.col("ancestor").alias("tgt"))).select("src", F.col("tgt").alias("cand"))
    left = pool.select("src", "cand").distinct().join(bad.distinct(), ["src", "cand"], "left_anti")
    w = Window.partitionBy("src").orderBy(_digest(seed, "src", "cand"), "cand")
    return left.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def hops(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """node, other, hop: parents and children within k steps, each at its least number of steps. starts: node."""
    both = edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(edges.select("parent", "child")).distinct()
    found = frontier = cut(starts.select("node", F.col("node").alias("other"), F.lit(0).alias("hop")).distinct())
    for i in range(1, k + 1):
        step = frontier.join(both, F.col("other") == F.col("a")).select("node", F.col("b").alias("other")).distinct()
        frontier = cut(step.join(found, ["node", "other"], "left_anti").withColumn("hop", F.lit(i)))
        found = found.unionByName(frontier)
    return found.where("hop > 0")


def upward_path(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, path: labels from a node up to a root over its least parents, joined by a separator; on a cycle up to the first node met again. labels: entity, label (one each)."""
    one = labels.groupBy("entity").agg(F.min("label").alias("label"))
    up = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    steps = up.join(one, up["parent"] == one["entity"]).select(F.col("child").alias("here"), F.col("parent").alias("above"), F.col("label").alias("name"))
    at = one.select(F.col("entity").alias("node"), F.col("entity").alias("here"), F.array("entity").alias("seen"), F.array("label").alias("path"))
    done = []
    while True:
        next_ = at.join(steps, "here", "left").withColumn("above", F.when(~F.array_contains("seen", F.col("above")), F.col("above")))
        next_ = cut(next_.select("node", F.col("above").alias("here"), F.when(F.col("above").isNotNull(), F.concat("seen", F.array("above"))).otherwise(F.col("seen")).alias("seen"), F.when(F.col("above").isNotNull(), F.concat("path", F.array("name"))).otherwise(F.col("path")).alias("path")))
        done.append(next_.where("here is null").select("node", F.array_join("path", " <SEP> ").alias("path")))
        at = next_.where("here is not null")
        if at.isEmpty():
            return reduce(DataFrame.unionByName, done)


def with_article(c: Column) -> Column:
    return F.concat(F.when(F.lower(c).rlike("^[aeiou]"), F.lit("an ")).otherwise(F.lit("a ")), c)


def prompt(sub: Column, sup: Column) -> Column:
    """The question form of a subsumption."""
    return F.concat(F.lit("It is "), with_article(sub), F.lit("? <MASK>, it is "), with_article(sup), F.lit("."))


def intra_corpus(labels: DataFrame, edges: DataFrame, soft: int = 2, hard: int = 2, seed: int = 0) -> DataFrame:
    """a, b, is_synonym of one ontology: its synonyms, and `soft` and `hard` negatives for each of them; where siblings give too few hard ones, soft ones make up for it.

    labels: entity, label; edges: child, parent. Negatives are drawn by a digest, so that a rerun draws the same.
    """
    pos = cut(synonyms(labels))
    n = pos.count()
    hards = cut(hard_negatives(labels, edges, max(1, hard), seed)) if hard else pos.limit(0)
    take = lambda d, k: d.withColumn("__d", _digest(seed, "a", "b")).orderBy("__d", "a", "b").limit(k).drop("__d")
    got = min(hards.count(), hard * n)
    wanted = soft * n + (hard * n - got)
    labels_n = max(1, labels.select("entity", "label").distinct().count())
    softs = soft_negatives(labels, max(1, -(-wanted // labels_n) + 1), seed)
    return corpus([pos], [take(hards, hard * n), take(softs.join(hards, ["a", "b"], "left_anti"), wanted)])


def lexicon_pairs(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """a, b, is_synonym of the words that a lexicon knows: their other lemmas, and the first antonym. words: word; lexicon: word, lemma, kind (synonym, antonym), rank."""
    known = words.select("word").distinct().join(lexicon, "word")
    same = known.where("kind = 'synonym' and lemma <> word").select(F.col("word").alias("a"), F.col("lemma").alias("b")).distinct().withColumn("is_synonym", F.lit(True))
    other = known.where("kind = 'antonym'").groupBy(F.col("word").alias("a")).agg(F.min(F.struct("rank", "lemma")).alias("x")).select("a", F.col("x.lemma").alias("b"), F.lit(False).alias("is_synonym"))
    return same.unionByName(other)


def atomic_samples(closed: DataFrame, instances: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """sub, sup, is_subsumption: all subsumptions of the closure, and for each class up to k drawn classes that it is assumed to be disjoint from. closed: reflexive."""
    pos = closed.where("depth > 0").select(F.col("node").alias("sub"), F.col("ancestor").alias("sup"), F.lit(True).alias("is_subsumption"))
    nodes = closed.select("node").distinct()
    rows = _numbered(nodes, _digest(seed, "node"))
    n = rows.count()
    mate = rows.select(F.col("node").alias("y"), F.col("__i").alias("__j"))
    pairs = rows.withColumn("__s", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(k, n - 1)))))).withColumn("__j", (F.col("__i") + F.col("__s")) % F.lit(max(n, 1))).join(mate, "__j").where("node <> y").select(F.col("node").alias("x"), "y")
    neg = assumed_disjoint(pairs, closed, instances).select(F.col("x").alias("sub"), F.col("y").alias("sup"), F.lit(False).alias("is_subsumption"))
    return pos.unionByName(neg)


def corrupted(restrictions: DataFrame, closed: DataFrame, seed: int = 0) -> DataFrame:
    """cls, prop, filler, kind (whole, corrupted) of complex classes: each restriction, and the same with another filler, drawn from those of its property, that neither is, lies above nor below the own one.

    restrictions: cls, prop, filler; closed: reflexive.
    """
    whole = restrictions.select("cls", "prop", "filler").distinct()
    fillers = whole.select("prop", F.col("filler").alias("other")).distinct()
    size = fillers.groupBy("prop").agg(F.count("*").alias("n"))
    w = Window.partitionBy("prop").orderBy(_digest(seed, "prop", "other"), "other")
    ring = fillers.withColumn("i", F.row_number().over(w) - 1).join(size, "prop")
    at = whole.join(ring.select("prop", F.col("other").alias("filler"), "i", "n"), ["prop", "filler"])
    mates = at.withColumn("j", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(8), F.col("n") - 1))))).withColumn("at", (F.col("i") + F.col("j")) % F.col("n"))
    drawn = mates.join(ring.select("prop", "other", F.col("i").alias("at")), ["prop", "at"]).where("other <> filler")
    near = closed.where("depth > 0").select(F.col("node").alias("filler"), F.col("ancestor").alias("other"))
    far = drawn.join(near.unionByName(near.select(F.col("other").alias("filler"), F.col("filler").alias("other"))), ["filler", "other"], "left_anti").join(whole.select("cls", "prop", F.col("filler").alias("other")), ["cls", "prop", "other"], "left_anti")
    one = far.groupBy("cls", "prop", "filler").agg(F.min(F.struct("j", "other")).alias("x")).select("cls", "prop", F.col("x.other").alias("filler"), F.lit("corrupted").alias("kind"))
    return whole.withColumn("kind", F.lit("whole")).unionByName(one)


def contexts(edges: DataFrame, labels: DataFrame, k: int, most: int) -> DataFrame:
    """node and text: its label and those of up to `most` neighbours within k steps, the nearest first, joined by a separator. labels: entity, label (one each)."""
    one = labels.groupBy("entity").agg(F.min("label").alias("label"))
    near = hops(edges, one.select(F.col("entity").alias("node")), k).join(one.select(F.col("entity").alias("other"), "label"), "other")
    w = Window.partitionBy("node").orderBy("hop", "label", "other")
    kept = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("l"))
    own = one.select(F.col("entity").alias("node"), "label").join(kept, "node", "left")
    return own.select("node", F.concat_ws(" <SEP> ", "label", F.array_join("l", " <SEP> ")).alias("text"))


def sample_strings(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """sub, sup, a, b: pairs of classes, of one ontology or of two, with their texts. pairs: sub, sup; texts: node, text."""
    t = lambda c, n: texts.select(F.col("node").alias(c), F.col("text").alias(n))
    return pairs.join(t("sub", "a"), "sub").join(t("sup", "b"), "sup").select("sub", "sup", "a", "b")


def neighbour_pool(references: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """src, cand: the targets' neighbours within k steps."""
    near = hops(edges, references.select(F.col("tgt").alias("node")).distinct(), k)
    return references.join(near.select(F.col("node").alias("tgt"), F.col("other").alias("cand")), "tgt").select("src", "cand").distinct()


def random_pool(references: DataFrame, targets: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """src, cand: for each source k targets from a shuffled ring, from a place that its own digest gives. targets: node."""
    rows = _numbered(targets.select("node").distinct(), _digest(seed, "node"))
    n = max(1, rows.count())
    start = references.select("src").distinct().withColumn("__b", F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(n)))
    places = start.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(min(k, n) - 1)))).withColumn("__i", (F.col("__b") + F.col("__s")) % F.lit(n))
    return places.join(rows, "__i").select("src", F.col("node").alias("cand"))


#: Pools of negative candidates by strategy; idf pools come from the alignment's candidates.
POOLS = {"random": random_pool, "neighbour": neighbour_pool}
