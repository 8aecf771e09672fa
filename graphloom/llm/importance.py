"""Quality classifier: importance resampling of documents by hashed n-gram models and Gumbel top-k.

Two generative models, of the target (documents labelled good) and of the raw corpus (all documents), each
give smoothed probabilities to hashed n-grams: words, pairs of words, and pairs of word shapes (case,
punctuation, length, whether the word repeats the one before it or closes a triple the text already had).
A document's log weight is the mean log ratio of its n-grams, summed over the three kinds and scaled to
LENGTH n-grams, so long and short documents compete on equal terms. Adding Gumbel noise and keeping the k
highest draws k documents without replacement in proportion to their weights.

Counts cover every document. Only the target's documents are a bounded sample (TARGET_ROWS labelled rows
by hash of doc_id); what goes to the driver is one row for each of the models' buckets, summed on the
executors first. k is the share of good rows among the labelled ones in the documents, with an allowance
so that clean documents aren't drawn away: ALLOWANCE of that share at any size, or the share's upper
confidence bound where few labels make it wider. The k-th highest key is found by counting
keys by their leading bits, 16 at a time: no global sort, and no row goes to one task.

Defined results: a null or empty text has no n-grams and log weight 0. Rows with the same doc_id and text
get the same key; rows tied at the threshold are all kept. Without labelled rows all are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, fresh_dir, give_back, id_and_text, kept, small_batches, table, whole_text
from .runs import chained, runs

TARGET_ROWS = 20_000
#: Misranked good rows grow with the corpus, so the part of k above the good share doesn't shrink with it.
ALLOWANCE = 0.005
WORDS = PAIRS = 1 << 16
CLASSES = 100
SHAPES = CLASSES * CLASSES * 3
BUCKETS = WORDS + PAIRS + SHAPES
LENGTH, SEED, SMOOTH = 50.0, 10, 1.0
KEPT = 400_000


class Words(dict):
    """A run's hash and shape, packed."""

    def __missing__(self, run: str) -> int:
        core = run.rstrip(".,;:!?")
        letters = core if core.isalpha() else "".join(filter(str.isalpha, core))
        case = 0 if not letters else 1 if letters.islower() else 3 if len(letters) > 1 and letters.isupper() else 2 if letters.istitle() else 4
        odd = 0 if core.isalnum() else sum(not c.isalnum() for c in core)
        tail = 4 if odd > 1 else 3 if odd else 0 if len(core) == len(run) else 1 if run[len(core) :] in (".", ",") else 2
        out = (xxhash.xxh64_intdigest(run.lower()) & ~127) | (case * 20 + tail * 4 + min(3, len(core) // 4))
        if len(self) >= KEPT:
            self.clear()
        if len(run) <= 64:
            self[run] = out
        return out


_words = kept("importance", Words())


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram and the number of its text: words, then pairs, then shapes."""
    alone("importance")
    names, index, at = runs(texts)
    names = names.to_pylist()
    packed = np.fromiter(map(_words.__getitem__, names), np.uint64, len(names))[index]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    if "" in names:
        real = index != names.index("")
        packed, doc = packed[real], doc[real]
    h, shape = packed >> np.uint64(7), (packed & np.uint64(127)).astype(np.int64)
    same_doc = doc[1:] == doc[:-1]
    first, second = h[:-1][same_doc], h[1:][same_doc]
    pair_doc = doc[1:][same_doc]
    place = np.nonzero(same_doc)[0]
    triple = np.zeros(len(place), bool)
    if len(h) > 2:
        inside = doc[2:] == doc[:-2]
        key = chained([h[:-2], h[1:-1], h[2:], doc[2:].astype(np.uint64)])
        again = np.zeros(len(h), bool)
        again[1:-1] = inside & pd.Series(key).duplicated().to_numpy()  # the second word of a triple that the text already had
        triple = again[place]
    flag = np.where(first == second, 2, triple.astype(np.int64))
    shapes = (shape[:-1][same_doc] * CLASSES + shape[1:][same_doc]) * 3 + flag
    buckets = np.concatenate([(h % np.uint64(WORDS)).astype(np.int64), WORDS + (chained([first, second]) % np.uint64(PAIRS)).astype(np.int64), WORDS + PAIRS + shapes])
    return buckets, np.concatenate([doc, pair_doc, pair_doc])


def target_ids(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> tuple[list[int], float]:
    """The target's documents, and the share of good ones among the labelled documents present, with its allowance."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    ids = known.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows).collect()
    share = good / n if n else 1.0
    return [r.doc_id for r in ids], min(1.0, share + max(ALLOWANCE * share, 2.6 * math.sqrt(share * (1 - share) / n))) if n else 1.0


def log_ratios(docs: DataFrame, target: list[int]) -> np.ndarray:
    """log p(target) - log p(raw) of every bucket."""
    small_batches(docs.sparkSession)
    wanted = np.array(sorted(target), np.int64)

    def run(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            buckets, doc = ngrams(b.column("text"))
            ids = b.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            mine = np.isin(ids, wanted)[doc] if len(doc) else np.zeros(0, bool)
            raw += np.bincount(buckets, minlength=BUCKETS)
            good += np.bincount(buckets[mine], minlength=BUCKETS)
            del buckets, doc, mine
            give_back()
        some = np.nonzero(raw)[0]
        for k in range(0, len(some), 10_000):
            part = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(good[part])], ["bucket", "raw", "good"])

    counts = id_and_text(docs).mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    out = np.zeros(BUCKETS, np.float32)
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy(np.int64)
    raw[at], good[at] = counts["raw"].to_numpy(float), counts["good"].to_numpy(float)
    for low, high in ((0, WORDS), (WORDS, WORDS + PAIRS), (WORDS + PAIRS, BUCKETS)):
        r, g = raw[low:high], good[low:high]
        prior = (r + 1e-9) / (r.sum() + 1e-9 * len(r))  # the target is smoothed towards the raw model
        out[low:high] = np.log((g + SMOOTH * 1000 * prior) / (g.sum() + SMOOTH * 1000)) - np.log(prior)
    return out


def log_weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """The log weight of each text."""
    n = len(texts)
    buckets, doc = ngrams(texts)
    kind = np.searchsorted([WORDS, WORDS + PAIRS], buckets, side="right")
    where = doc * 3 + kind
    total = np.bincount(where, weights=ratios[buckets], minlength=3 * n)
    count = np.bincount(where, minlength=3 * n)
    return LENGTH * (total / np.maximum(count, 1)).reshape(n, 3).sum(1)


def weight_column(spark: SparkSession, ratios: np.ndarray, text: Column) -> Column:
    """The log weight of a text, as a column beside all others."""
    shared = spark.sparkContext.broadcast(ratios)  # one number for each bucket, whatever the corpus

    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        out = pd.Series(log_weights(pa.array(texts, pa.string()), shared.value))
        give_back()
        return out

    return weight(F.coalesce(text, F.lit("")))


def gumbel(seed: int = SEED) -> Column:
    """Noise that depends on the document's id and text alone, so that a rerun draws the same and documents without an id draw apart."""
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), whole_text(), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_highest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th highest of a column of whole numbers (None if there are fewer), by counting leading bits."""
    if k <= 0:
        return 1 << 62
    x = F.col(column) + F.lit(1 << 47)  # keys lie within 48 bits
    prefix = None
    for shift in (32, 16, 0):
        rows = keys if prefix is None else keys.where(F.shiftright(x, shift + 16) == prefix)
        counts = sorted(((r.p, r.n) for r in rows.groupBy(F.shiftright(x, shift).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for p, n in counts:
            if k <= n:
                prefix = p
                break
            k -= n
        else:
            return None
    return prefix - (1 << 47)


def scored_rows(docs: DataFrame, labels: DataFrame, columns: list[str]) -> tuple[DataFrame, str, str, int | None]:
    """The given columns of each document with its log weight and key (24 binary places), written once to the shared folder; the names of these two; the least key kept (None: all)."""
    spark = docs.sparkSession
    target, share = target_ids(docs, labels)
    weight = weight_column(spark, log_ratios(docs, target), whole_text())
    key = lambda w: F.round((F.greatest(F.least(w + gumbel(), F.lit(4e6)), F.lit(-4e6))) * float(1 << 24)).cast("long")
    taken = {c.lower() for c in docs.columns}
    w, k = (next(c for c in (f"{x}{'_' * i}" for i in range(len(taken) + 1)) if c not in taken) for x in ("log_weight", "key"))
    folder = fresh_dir(spark, "scored")
    docs.withColumn(w, weight).withColumn(k, key(F.col(w))).select(*columns, w, k).write.parquet(folder)
    scored = spark.read.parquet(folder)
    return scored, w, k, kth_highest(scored, k, math.ceil(share * scored.count()))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, w, k, least = scored_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    kept = F.col(k) >= F.lit(least if least is not None else -(1 << 62))
    return scored.select("doc_id", F.col(w).alias("log_weight"), (F.col(k) / float(1 << 24)).alias("gumbel_key"), kept.alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents drawn, with all their columns. They are scored once and written with their keys; the rest of the work reads the keys only."""
    small_batches(docs.sparkSession)
    scored, w, k, least = scored_rows(docs, labels, docs.columns)
    return (scored.where(F.col(k) >= F.lit(least)) if least is not None else scored).drop(w, k)
