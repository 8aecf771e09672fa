"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Texts with equal sets of five-word shingles are one representative with a weight, by an aggregation that
combines before it shuffles; from there on copies cost nothing. Signatures are cut into bands; the number
of bands and rows is the sharpest split that reaches RECALL at the threshold. Representatives are shuffled
on band hashes, and in each bucket every member is tied to its least member: as many ties as members, never
all pairs. The connected parts of these ties hold every candidate pair, so a part is verified as a whole: its full sets
are compared through the shingles that two or more of them share. A part larger than TILE is cut into tiles, each
pair of tiles a task of its own, so no task grows with a part; that is exact, and its work is quadratic only in the
number of different texts of one candidate part. What comes out is a count for each member and a spanning tree
of the links, not the links.

Result: a row for each document with class_id (the least doc_id of its connected part of links) and n_links (how many
other documents have likeness at least the threshold to it, copies included).

Defined results: words are runs between white space. A text of fewer than five words is one shingle; a text
without words is one shingle of its characters, so all empty and null texts are copies of one another.
Repeated rows are copies. Rows without doc_id take part; a class of such rows only has no class_id.
An id that stands for several texts gives a row for each.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, cut, give_back, id_and_text, kept, small_batches, table, tidy, whole_text
from .runs import chained, mixed, runs

N, THRESHOLD, RECALL = 5, 0.8, 0.999
MOST_HASHES = 256
TILE = 512
SMALL_ROWS = 2_000
#: Parts that the rows of one key are dealt in.
SALTS = 256
KEPT = 400_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band can have, and so the fewest false candidates, if the bands that then reach the recall fit into most hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance)) if chance > 1e-12 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Words(dict):
    def __missing__(self, run: str) -> int:
        h = int.from_bytes(hashlib.blake2b(run.encode(), digest_size=8).digest(), "little")
        if len(self) >= KEPT:
            self.clear()
        if len(run) <= 64:
            self[run] = h
        return h


_words = kept("ngram_join", Words())


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes (64 bits)."""
    alone("ngram_join")
    names, index, at = runs(texts)
    names = names.to_pylist()
    hashes = np.fromiter(map(_words.__getitem__, names), np.uint64, len(names))[index]
    out = []
    grams = chained([hashes[k : len(hashes) - n + 1 + k] for k in range(n)]) if len(hashes) >= n else hashes[:0]
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b - a == 1 and names[index[a]] == "":
            out.append(chained([np.array([len(texts[i].as_py().strip())], np.uint64)]))
        else:
            out.append(np.array([chained([hashes[a:b][k : k + 1] for k in range(b - a)])[0] ^ np.uint64(b - a)], np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_hashes(s: np.ndarray, multipliers: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of a set's signature."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        x = s[k : k + 4096, None] * multipliers[None, :]
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    rows = least.reshape(bands, -1)
    return chained([np.arange(bands, dtype=np.uint64), *(rows[:, k] for k in range(rows.shape[1]))]).view(np.int64)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash of the text: what a row is told apart by, where ids are null or stand for several texts."""
    return id_and_text(docs).withColumn("h", F.xxhash64("text"))


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, h, set_key and band hashes of every document."""
    small_batches(docs.sparkSession)
    bands, rows = bands_and_rows(threshold, recall)
    multipliers = seeds(bands * rows)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(list(map(set_key, sets)), pa.binary()), pa.array([band_hashes(s, multipliers, bands) for s in sets], pa.list_(pa.int64()))], ["doc_id", "h", "set_key", "bands"])

    return named(docs).mapInArrow(tidy(run), "doc_id long, h long, set_key binary, bands array<long>")


def beside(rows: DataFrame, key: str, spread: str, first: Column, whole) -> DataFrame:
    """The rows with x, an aggregate of their key's rows: first of each part, whole(x) of the parts. A key's rows are dealt in SALTS parts by the column spread, of which only those there come back with x, so no task holds all rows of a key."""
    dealt = rows.withColumn("s", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "s").agg(first.alias("x")).groupBy(key).agg(whole("x").alias("x"), F.collect_list("s").alias("s"))
    return dealt.join(parts.select(key, "x", F.explode("s").alias("s")), [key, "s"]).drop("s")


def with_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least v of each u."""
    return beside(edges, "u", "v", F.min("v"), F.min).select("u", "v", F.col("x").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp (the least node of its connected part), by alternating large and small stars.

    Each step ties nodes to the least neighbour they know, until nothing changes; the number of steps grows with the logarithm of
    a part's size, and the edges never become more. Steps are written to the shared folder.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        now = cut(with_least(large).select(F.inline(ends)).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tied = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = now.select(F.col("v").alias("u"), F.col("v")).distinct()
    return tied.unionByName(roots.join(tied, "u", "left_anti")).select(F.col("u").alias("node"), F.col("v").alias("comp"))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the left sets has which of the right ones at the threshold or above: a matrix of truth values, exact."""
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate([sets[i] for i in range(len(sets))])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    place = [np.full(len(sets), -1) for _ in range(2)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    for start in range(0, columns, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        blocks = []
        for k, side in enumerate((left, right)):
            x = np.zeros((len(side), min(4096, columns - start)), np.float32)
            mine = place[k][row[a:b]] >= 0
            x[place[k][row[a:b][mine]], column[a:b][mine] - start] = 1
            blocks.append(x)
        both += blocks[0] @ blocks[1].T
    union = size[left][:, None] + size[right][None, :] - both
    return both >= threshold * union - 1e-6


def verify(parts: pa.Table, threshold: float) -> pa.Table:
    """For each part or pair of tiles in the table: links of each member (weights of what it is linked to), and a tie to the least member it is linked through."""
    nodes, roots, links = [], [], []
    comp = np.array(parts.column("comp").to_pylist(), object)
    side = parts.column("side").to_numpy()
    key, weight, sets = parts.column("node").to_pylist(), parts.column("n").to_numpy(), [np.asarray(x, np.uint64) for x in parts.column("shingles").to_numpy()]
    by: dict[bytes, list[int]] = {}
    for i, c in enumerate(comp):
        by.setdefault(c, []).append(i)
    for members in by.values():
        own = [sets[i] for i in members]
        one = np.array([k for k, i in enumerate(members) if side[i] == 0])
        two = np.array([k for k, i in enumerate(members) if side[i] == 1], np.int64)
        crossed = len(two) > 0
        right = two if crossed else one
        found = linked(own, one, right, threshold) if len(one) and len(right) else np.zeros((len(one), len(right)), bool)
        if not crossed:
            np.fill_diagonal(found, False)
        w = np.array([weight[i] for i in members])
        total = np.zeros(len(members), np.int64)
        total[one] += found @ w[right]
        if crossed:
            total[two] += found.T @ w[one]
        parent = list(range(len(members)))

        def top(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(len(one)):
            for j in np.nonzero(found[i])[0]:
                x, y = top(int(one[i])), top(int(right[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        for k, i in enumerate(members):
            nodes.append(key[i])
            roots.append(key[members[top(k)]])
            links.append(int(total[k]))
    return pa.table([pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(links, pa.int64())], ["node", "root", "links"])


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """doc_id, h (the text's hash), set_key, comp (the class, whatever its doc_ids), class_id and n_links of every document."""
    signed = cut(signatures(docs, n, threshold, recall))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("k")
    reps = signed.groupBy("set_key").agg(first, F.count("*").alias("n"), F.first("bands").alias("bands")).select(F.col("set_key").alias("node"), F.col("k.doc_id").alias("rep"), F.col("k.h").alias("rep_h"), "n", "bands")
    banded = reps.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1").drop("members")
    parts = cut(components(banded.join(heads, "band").where("node <> head").select("node", "head").distinct(), "node", "head"))
    sized = beside(parts, "comp", "node", F.count("*"), F.sum).withColumnRenamed("x", "size")
    wanted = sized.join(reps.select("node", "rep", "rep_h", "n"), "node")

    def with_sets(batches):
        for b in batches:
            sets = [x.view(np.int64) for x in shingle_sets(b.column("text"), n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("comp", "node", "size", "n")), pa.array(sets, pa.list_(pa.int64()))], ["comp", "node", "size", "n", "shingles"])

    # id and text name a row; rows that repeat another whole bring the same set, and one of them stays
    texts = named(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h")))
    full = texts.select("text", "comp", "node", "size", "n").mapInArrow(tidy(with_sets), "comp binary, node binary, size long, n long, shingles array<long>").dropDuplicates(["node"])
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    bundle = F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(max(1, wanted.count() // SMALL_ROWS + 1))).cast("string"))
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.concat_ws("-", F.hex("comp"), F.least(own, t), F.greatest(own, t)).alias("g"), F.when(own > t, 1).otherwise(0).alias("side")))
    dealt = full.withColumn("at", F.explode(F.when(tiles == 1, F.array(F.struct(bundle.alias("g"), F.lit(0).alias("side")))).otherwise(pairs))).select("at.g", "at.side", "comp", "node", "n", "shingles")

    def verified_part(part: pa.Table) -> pa.Table:
        out = verify(part, threshold)
        give_back()
        return out

    verified = cut(dealt.groupBy("g").applyInArrow(verified_part, "node binary, root binary, links long"))
    ties = components(verified.where("node <> root").select("node", "root"), "node", "root")
    linked_to = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", "rep", "n").join(ties, "node", "left").join(linked_to, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    info = beside(known, "comp", "node", F.min("rep"), F.min).withColumnRenamed("x", "class_id").select(F.col("node").alias("set_key"), "comp", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "h", "set_key").join(info, "set_key")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least doc_id (rows without one come last), with all its columns.

    A row is named by its doc_id and its text's hash; only rows that repeat another in both are told apart by a shuffle of their own.
    """
    found = cut(join(docs).groupBy("comp", "doc_id", "h").agg(F.count("*").alias("copies")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "copies")).alias("k")
    taken = {c.lower() for c in docs.columns}
    keep, h, copies = (next(c for c in (f"__{x}{i}" for i in range(len(taken) + 1)) if c not in taken) for x in ("keep", "h", "copies"))
    kept = cut(found.groupBy("comp").agg(first).select(F.col("k.doc_id").alias(keep), F.col("k.h").alias(h), F.col("k.copies").alias(copies)))
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(keep)) & (F.xxhash64(whole_text()) == F.col(h)))
    single = rows.where(F.col(copies) == 1)
    if not kept.where(F.col(copies) > 1).isEmpty():
        single = single.unionByName(rows.where(F.col(copies) > 1).dropDuplicates([keep, h]))
    return single.drop(keep, h, copies)
