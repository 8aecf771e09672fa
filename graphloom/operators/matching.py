"""Label index, candidate pools, scores, ranks and selection of ontology matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import levenshtein_similarity, tokens
from graphloom.session import cut


def label_index(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """Different labels in lower case, underscores as blanks."""
    return rows.select(F.col(entity).alias("entity"), F.lower(F.replace(F.col(label), F.lit("_"), F.lit(" "))).alias("label")).where("label <> ''").distinct()


def postings(rows: DataFrame, entity: str, text: str, skip: tuple[str, ...] = ("has",)) -> DataFrame:
    """token, entity and how often."""
    return rows.select(F.col(entity).alias("entity"), F.explode(tokens(F.col(text))).alias("token")).where(~F.col("token").isin(*skip)).groupBy("token", "entity").agg(F.count("*").alias("tf"))


def inverted_index(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def idf_pool(queries: DataFrame, post: DataFrame, n_entities: DataFrame, k: int, blocks: int = 64) -> DataFrame:
    """The k entities of the highest sum of log10(D / df) over common tokens, for each query: src, entity, score, rank. queries: src, token; every token counts.

    Postings are made once, of the queries' tokens only. A token's postings are dealt in blocks by entity, so a token that all entities have is the work of many tasks; a block that holds
    an entity holds all its postings, so scores are whole there and only the best k of a block are ranked with those of others.
    """
    asked = queries.groupBy("src", "token").agg(F.count("*").alias("times"))
    held = cut(post.select("token", "entity").join(asked.select("token").distinct(), "token", "left_semi").withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int")))
    counts = held.groupBy("token", "block").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("df"))
    weights = asked.join(counts, "token").crossJoin(F.broadcast(n_entities)).select("src", "token", (F.col("times") * F.log10(F.col("d") / F.col("df"))).alias("w"))
    weights = weights.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = held.join(weights, ["token", "block"]).groupBy("src", "entity", "block").agg(F.round(F.sum("w"), 6).alias("score"))
    own, all_ = (Window.partitionBy(*p).orderBy(F.desc("score"), "entity") for p in (("src", "block"), ("src",)))
    best = scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(all_)).where(F.col("rank") <= k).drop("block")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most_queries: int = 20_000) -> DataFrame:
    """The k vectors of the highest cosine for each query, other than itself: src, tgt, sim, k. Both: vec_id, embedding.

    The queries go to every task, in parts of at most most_queries; each batch of vectors is one matrix product with them, of which the best k a query leave the task.
    """
    spark = vectors.sparkSession
    ids = queries.select(F.col("vec_id").cast("long").alias("src")).distinct()
    parts = max(1, -(-ids.count() // most_queries))
    found = []
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).select("vec_id", "embedding").collect()
        own = spark.sparkContext.broadcast(([r.vec_id for r in rows], [r.embedding for r in rows]))

        def run(batches, own=own):
            import numpy as np
            import pyarrow as pa

            unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            if not own.value[0]:
                return
            src, q = np.array(own.value[0], np.int64), unit(np.array(own.value[1], np.float64))
            for b in batches:
                if not b.num_rows:
                    continue
                tgt = b.column("vec_id").to_numpy()
                sim = np.round(q @ unit(np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)).T, 5)
                sim[src[:, None] == tgt[None, :]] = -9
                order = np.lexsort((np.broadcast_to(tgt, sim.shape), -sim), axis=1)[:, :k]
                rows, columns = np.repeat(np.arange(len(src)), order.shape[1]), order.ravel()
                keep = sim[rows, columns] > -9
                yield pa.RecordBatch.from_arrays([pa.array(src[rows][keep]), pa.array(tgt[columns][keep]), pa.array(sim[rows, columns][keep])], ["src", "tgt", "sim"])

        found.append(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "src long, tgt long, sim double"))
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "tgt")
    return reduce(DataFrame.unionByName, found).withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= k)


def exact_match(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Equal labels; the least target of a source. src, tgt: entity, label."""
    first = tgt.groupBy("label").agg(F.min("entity").alias("tgt"))
    return src.join(first, "label").groupBy(F.col("entity").alias("src")).agg(F.min("tgt").alias("tgt")).withColumn("score", F.lit(1.0))


def best_similarity(pairs: DataFrame) -> DataFrame:
    """Per (src, tgt) the highest label similarity. pairs: src, tgt, a, b."""
    return pairs.groupBy("src", "tgt").agg(F.round(F.max(levenshtein_similarity(F.col("a"), F.col("b"))), 6).alias("score"))


def partial_jaccard(pairs: DataFrame) -> DataFrame:
    """PJ: the share of the target's tokens (longer than one character) that the source label contains. pairs: src, tgt, a (source label), b (target label)."""
    t = tokens(F.col("b"))
    hits = F.size(F.filter(t, lambda x: (F.length(x) > 1) & F.contains(F.lower(F.col("a")), x)))
    return pairs.select("src", "tgt", F.round(F.coalesce(F.try_divide(hits, F.size(t)), F.lit(0.0)), 6).alias("pj"), F.length("b").alias("clen"))


def ranked(scored: DataFrame) -> DataFrame:
    """bes_rank by score, pj_rank (dense) by pj and length."""
    bes = Window.partitionBy("src").orderBy(F.desc("score"), "tgt")
    pj = Window.partitionBy("src").orderBy(F.desc("pj"), F.desc("clen"))
    return scored.withColumn("bes_rank", F.row_number().over(bes)).withColumn("pj_rank", F.dense_rank().over(pj))


def suitable(cands: DataFrame, tolerance: float) -> DataFrame:
    """The scan over a source's candidates in their order that keeps one if its rank is as good as the best kept so far or its score within tolerance of the best score: a fold over a sorted array. cands: src, pos, rank, score."""
    items = F.array_sort(F.collect_list(F.struct("pos", "rank", "score")))
    start = F.struct(F.lit(2147483647).alias("least"), F.lit(0.0).cast("double").alias("best"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        first = F.size(s["kept"]) == 0
        ok = first | (x["rank"] <= s["least"]) | (F.abs(x["score"] - s["best"]) <= tolerance * s["best"])
        return F.struct(F.when(ok, F.least(s["least"], x["rank"])).otherwise(s["least"]).alias("least"), F.when(first, x["score"].cast("double")).otherwise(s["best"]).alias("best"), F.when(ok, F.concat(s["kept"], F.array(x["pos"].cast("int")))).otherwise(s["kept"]).alias("kept"))

    return cands.groupBy("src").agg(F.aggregate(items, start, step, lambda s: s["kept"]).alias("kept")).select("src", F.explode("kept").alias("pos"))


def table_match(cands: DataFrame, bes_high: float, bes_low: float, pj_high: float) -> DataFrame:
    """One match of each source: over the thresholds, then least pj_rank, then highest pj, then least target."""
    good = cands.where((F.col("bes") >= bes_high) | ((F.col("bes") >= bes_low) & (F.col("pj") >= pj_high)))
    best = F.min(F.struct("pj_rank", (-F.col("pj")).alias("p"), "tgt"))
    return good.groupBy("src").agg(best.alias("b")).select("src", F.col("b.tgt").alias("tgt"))


def extend_one_hop(mappings: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame) -> DataFrame:
    """New pairs of parents and of children of mapped pairs."""
    s, t = (e.select(F.col("child").alias(f"{x}c"), F.col("parent").alias(f"{x}p")) for e, x in ((src_edges, "s"), (tgt_edges, "t")))
    up = mappings.join(s, mappings["src"] == s["sc"]).join(t, mappings["tgt"] == t["tc"]).select(F.col("sp").alias("src"), F.col("tp").alias("tgt"))
    down = mappings.join(s, mappings["src"] == s["sp"]).join(t, mappings["tgt"] == t["tp"]).select(F.col("sc").alias("src"), F.col("tc").alias("tgt"))
    return up.union(down).distinct().join(mappings, ["src", "tgt"], "left_anti")


def precision_recall(predicted: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    hit = predicted.join(reference, on, "left_semi").agg(F.count("*").alias("tp"))
    both = hit.crossJoin(predicted.agg(F.count("*").alias("p"))).crossJoin(reference.agg(F.count("*").alias("r")))
    p, r = F.try_divide("tp", "p"), F.try_divide("tp", "r")
    return both.select("tp", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 3).alias("f1"))


def exact_mapper(src: DataFrame, tgt: DataFrame, described: DataFrame) -> DataFrame:
    """src, tgt, score: for each entity the target of its kind with a label in common; a data property without domain and range scores 0.5 and gives way to one that has them; of equal ones the least.

    src, tgt: kind, entity, label; described: entity of the target properties with a domain or range.
    """
    known = described.select("entity", F.lit(True).alias("told")).distinct()
    rows = tgt.join(known, "entity", "left").withColumn("score", F.when((F.col("kind") == "dataProperty") & F.col("told").isNull(), 0.5).otherwise(1.0))
    best = rows.groupBy("kind", "label").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("entity").alias("tgt"))).alias("x"))
    met = src.join(best, ["kind", "label"]).groupBy(F.col("entity").alias("src")).agg(F.min("x").alias("x"))
    return met.select("src", "x.tgt", (-F.col("x.s")).alias("score"))


def synonym_groups(labels: DataFrame) -> DataFrame:
    """label and grp: labels that entities have in common make them one group, however many steps apart; grp is the least label. labels: entity, label."""
    from graphloom.operators.hierarchy import connected

    heads = labels.groupBy("entity").agg(F.min("label").alias("head"))
    ties = labels.join(heads, "entity").select(F.col("label").alias("a"), F.col("head").alias("b")).distinct()
    return connected(ties).select(F.col("node").alias("label"), F.col("comp").alias("grp"))


def inventory_groups(inventory: DataFrame) -> DataFrame:
    """sf and the sorted set of its full forms. inventory: sf, lf."""
    return inventory.groupBy("sf").agg(F.array_sort(F.collect_set("lf")).alias("lfs"))


def split_by_hash(rows: DataFrame, columns: list[str], share: float = 0.9, seed: int = 0) -> DataFrame:
    """The rows with part: train for a share of them, val for the others, by a digest of the columns, so that a rerun splits alike."""
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *columns, F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return rows.withColumn("part", F.when(place < int(share * 10_000), "train").otherwise("val"))
