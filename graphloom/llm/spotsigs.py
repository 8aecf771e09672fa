"""Document fingerprints: SpotSigs.

A spot signature is a common word (the anchor) with the CHAIN content words that follow it, common words
skipped. Where none of the GAP words before a content word is an anchor (lists, names, other languages), it stands in for one itself:
its chain begins with it. A document's fingerprint is the set of its signatures, as 32-bit hashes, sorted, in base64.
Sets are compared by Jaccard likeness; sizes alone bound it (|A| / |B| for the smaller A), so fingerprints
are partitioned by set length such that sets alike enough lie in the same or neighbouring partitions, and
a comparison stops where its bound falls below what is asked. `near_copies` finds all documents alike that way: equal sets are one
first; of the others each meets, in its own and the next length partition, those with which it shares one of its rarest signatures, as
many of them as any set alike enough must share one of; a bucket of more than TILE sets is compared in pairs of tiles, each a task.

Defined results: a null text counts as empty. A text without a signature is its content words' one chain,
one without words is its characters, so equal texts always have equal fingerprints and only empty texts
have an empty one. Two empty fingerprints have likeness 1, an empty and another 0. Rows with the same
doc_id are ordered by their text's hash; rows without doc_id come last. One row is its own next document.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, id_and_text, small_batches, table
from .ngram_join import SALTS, components
from .runs import chained, runs

CHAIN, GAP = 2, 8
NEAR = 0.8
#: Anchors, the commonest function words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from has in is it of on or that the this to was were with "
    "au ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "con del el es las los no para por se su una y".split()
)
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»„“”¿¡…"
KEPT = 400_000
TILE = 512


class Words(dict):
    """A word's 64-bit hash, odd for anchors and even for content words, 1 for runs that are no word."""

    def __missing__(self, run: str) -> int:
        word = run.strip(_EDGE)
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        h = 1 if not word else (h | 1 if word in ANCHORS else h & ~1)
        if len(self) >= KEPT:
            self.clear()
        if len(run) <= 64:
            self[run] = h
        return h


_words = Words()


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """Each text's sorted 32-bit signatures."""
    names, index, at = runs(texts, lower=True)
    hashes = np.fromiter(map(_words.__getitem__, names.to_pylist()), np.uint64, len(names))[index]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    keep = hashes != 1
    hashes, doc = hashes[keep], doc[keep]
    anchor = (hashes & np.uint64(1)).astype(bool)
    content = np.nonzero(~anchor)[0]
    # for each anchor the first content word after it, and the chain that starts there, within the text; a word that stands in for an anchor is its own first one
    place = np.arange(len(hashes))
    last = np.maximum.accumulate(np.where(anchor, place, -1)) if len(place) else place
    spots = np.nonzero(anchor | (last < 0) | (place - last > GAP) | (doc[last] != doc))[0]
    first = np.searchsorted(content, spots)
    inside = first + chain <= len(content)
    spots, first = spots[inside], first[inside]
    inside = doc[content[first + chain - 1]] == doc[spots] if len(spots) else np.zeros(0, bool)
    spots, first = spots[inside], first[inside]
    sigs = (chained([np.where(anchor[spots], hashes[spots], np.uint64(3)), *(hashes[content[first + k]] for k in range(chain))]) >> np.uint64(32)) if len(spots) else np.zeros(0, np.uint64)
    both = np.unique((doc[spots].astype(np.uint64) << np.uint64(32)) | sigs)
    cuts = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    out = [both[a:b].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, x in enumerate(out):
        if not len(x):
            own = hashes[doc == i]
            text = own.tobytes() if len(own) else (texts[i].as_py() or "").encode()
            out[i] = np.frombuffer(hashlib.blake2b(text, digest_size=4).digest(), np.uint32) if text else x
    return out


def written(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def length_partition(n: int, least: float = NEAR) -> int:
    """Sets whose likeness can reach least are at most one partition apart."""
    return 0 if n <= 0 else int(np.floor(np.log(n) / -np.log(least))) + 1


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard likeness of two sorted sets; 0 as soon as their lengths or ranges show that it is below least, or 0 anyway."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)) or a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    found = both / (len(a) + len(b) - both)
    return found if found >= least else 0.0


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, fingerprint, n_signatures and length_partition of every document. One pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sigs = signatures(batch.column(1), chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(written, sigs)), pa.string()), pa.array([len(x) for x in sigs], pa.int64()), pa.array([length_partition(len(x)) for x in sigs], pa.int32())], ["doc_id", "fingerprint", "n_signatures", "length_partition"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string, n_signatures long, length_partition int")


def tied(rows: pa.Table, least: float) -> pa.Table:
    """node and root, the first one of the same bucket it is alike to, directly or through others. Sets are compared by length, the shortest first, as long as lengths allow, and only where no link is known yet."""
    nodes, roots = [], []
    key, side, sets = rows.column("node").to_pylist(), rows.column("side").to_pylist(), [np.asarray(x) for x in rows.column("sigs").to_numpy()]
    by: dict[tuple, list[int]] = {}
    for i, bucket in enumerate(zip(rows.column("sig").to_pylist(), rows.column("bucket").to_pylist(), strict=True)):
        by.setdefault(bucket, []).append(i)
    for members in by.values():
        members.sort(key=lambda i: (len(sets[i]), key[i]))
        crossed, parent = any(side[i] for i in members), {i: i for i in members}

        def top(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for n, i in enumerate(members):
            for j in members[n + 1 :]:
                if len(sets[i]) < least * len(sets[j]):
                    break
                if (not crossed or side[i] != side[j]) and top(i) != top(j) and likeness(sets[i], sets[j], least):
                    parent[top(j)] = top(i)
        for i in members:
            if top(i) != i:
                nodes.append(key[i])
                roots.append(key[top(i)])
    return pa.table([pa.array(nodes, pa.string()), pa.array(roots, pa.string())], ["node", "root"])


def near_copies(docs: DataFrame, least: float = NEAR, chain: int = CHAIN, tile: int = TILE) -> DataFrame:
    """doc_id and class_id of every document: the least doc_id among those it is alike to, directly or through others."""
    prints = cut(fingerprints(docs, chain))
    reps = prints.groupBy(F.col("fingerprint").alias("node")).agg(F.first("n_signatures").alias("n"), F.first("length_partition").alias("part"))
    small_batches(docs.sparkSession)

    def decoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n", "part")), pa.array([np.frombuffer(base64.b64decode(x), "<u4").astype(np.int64) for x in b.column("node").to_pylist()], pa.list_(pa.int64()))], ["node", "n", "part", "sigs"])

    sets = cut(reps.where("n > 0").mapInArrow(decoded, "node string, n long, part int, sigs array<long>").withColumn("id", F.sha2("node", 256)))
    one = sets.select("id", F.explode("sigs").alias("sig")).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    often = one.groupBy("sig", "s").agg(F.count("*").alias("c")).groupBy("sig").agg(F.sum("c").alias("df"), F.collect_list("s").alias("s"))
    # a signature of one set alone leads nowhere, but takes a place among the rarest
    rare = one.join(often.select("sig", "df", F.explode("s").alias("s")), ["sig", "s"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    some = F.size("order") - F.ceil(F.lit(least) * F.size("order") - 1e-9).cast("int") + 1
    prefix = rare.select("id", F.explode(F.slice("order", 1, some)).alias("x")).where("x.df > 1").select("id", F.col("x.sig").alias("sig"))
    met = sets.select("id", "part").join(prefix, "id").select("id", "sig", F.explode(F.array("part", F.col("part") + 1)).alias("bucket"))
    met = cut(met.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    sizes = met.groupBy("sig", "bucket", "s").agg(F.count("*").alias("c")).groupBy("sig", "bucket").agg(F.sum("c").alias("size"), F.collect_list("s").alias("s")).where("size > 1")
    full = met.join(sizes.select("sig", "bucket", "size", F.explode("s").alias("s")), ["sig", "bucket", "s"])
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(own, t).alias("x"), F.greatest(own, t).alias("y"), F.when(own > t, 1).otherwise(0).alias("side")))
    dealt = full.withColumn("at", F.explode(pairs)).select("id", "sig", "bucket", "at.*")
    groups = max(1, met.count() // 2_000 + 1)
    g = F.when((F.col("x") == 0) & (F.col("y") == 0), F.pmod(F.xxhash64("sig", "bucket"), F.lit(groups))).otherwise(F.xxhash64("sig", "bucket", "x", "y"))
    work = dealt.withColumn("g", g).join(sets.select("id", F.col("id").alias("node"), "sigs"), "id").select("g", "node", "sig", "bucket", "side", "sigs")
    ties = cut(work.groupBy("g").applyInArrow(lambda t: tied(t, least), "node string, root string"))
    comp = components(ties, "node", "root")
    member = prints.select("doc_id", F.sha2("fingerprint", 256).alias("node")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return member.join(member.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "comp").select("doc_id", "class_id")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents in buckets of descending doc_id, each with the next bucket's first document at its end.

    Columns b (bucket), doc_id, text, h (the text's hash) and peek (true for that further document). Only
    bounds and the buckets' first ids go to the driver, one each for a bucket; the texts are shuffled once.
    """
    spark = docs.sparkSession
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"))
    bounds = sorted({int(x) for x in ids.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf(T.IntegerType())
    def bucket(k):
        return pd.Series((len(cuts) - np.searchsorted(cuts, k.to_numpy(), side="left")).astype(np.int32))

    keyed = id_and_text(docs).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    heads = {r.b: r.k for r in ids.withColumn("b", bucket("k")).groupBy("b").agg(F.max("k").alias("k")).collect()}
    if not heads:
        return keyed.select(F.lit(0).alias("b"), "doc_id", "text", F.lit("").alias("h"), F.lit(False).alias("peek"), "k"), 0
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # the first bucket's head also ends the last bucket

    @F.pandas_udf(T.IntegerType())
    def peeked(k):
        return pd.Series([before.get(x) for x in k], dtype="Int32")

    placed = keyed.withColumn("b", bucket("k")).withColumn("p", peeked("k")).withColumn("h", F.sha2("text", 256))
    both = F.array(F.struct(F.col("b"), F.lit(False).alias("peek")), F.struct(F.col("p").alias("b"), F.lit(True).alias("peek")))
    rows = placed.withColumn("at", F.explode(F.filter(both, lambda x: x["b"].isNotNull()))).select("at.b", "at.peek", "doc_id", "text", "h", "k")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b").sortWithinPartitions("b", "peek", F.desc("k"), "h"), len(order)


def fingerprint_edits(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to each other and to the next document's."""
    small_batches(docs.sparkSession)
    rows, _ = in_order(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        last = None  # the document that still waits for the one after it
        for batch in batches:
            sigs = signatures(batch.column("text"), chain)
            texts, waiting = batch.column("text").to_pylist(), []
            for b, peek, doc, text, own in zip(batch.column("b").to_pylist(), batch.column("peek").to_pylist(), batch.column("doc_id").to_pylist(), texts, sigs, strict=True):
                if last is not None and last[0] == b:
                    waiting.append((*last[1:], text, own))
                last = None if peek else (b, doc, text, own)
            if not waiting:
                continue
            new = [edited(text, following) for _, text, _, following, _ in waiting]
            out = []
            for (doc, text, own, _, theirs), changed, changed_sigs in zip(waiting, new, signatures(pa.array(new, pa.string()), chain), strict=True):
                out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(own), written(changed_sigs), likeness(own, changed_sigs), likeness(own, theirs), len(own), length_partition(len(own))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.select("b", "peek", "doc_id", "text").mapInArrow(run, schema)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
