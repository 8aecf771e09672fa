"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

All pre-tokens to be encoded stand in one doubly linked list of token ids, with walls between them. Every
pair of neighbours that merges has a place in the bucket of its rank. A bitmap over the ranks, with a
bitmap over its words above it and so on, finds the lowest rank with a bucket by find-first-set at each
level. A bucket's positions are merged left to right; entries whose pair has changed meanwhile are stale
and skipped. So a pre-token of n bytes takes n log n steps, however long, and thousands of short ones
share one queue.

A batch's texts are cut at single blanks (a blank between two other characters always begins a match of
the pattern), each different run is cut by the pattern and encoded once, and kept in a bounded cache.

Defined results: a null or empty text has no ids and the digests of no bytes. Special strings are ordinary
text. Repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, small_batches, table
from .runs import blank_runs, spread
from .wordbpe import vocabulary

#: Entries of a cache, about 200 bytes each: the runs and pre-tokens that a worker meets are told once, not after every 20 MB anew.
CACHE_RUNS = 1_000_000
LONGEST_KEPT = 48
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A blank at an end of the text or beside other white space: such texts are cut by the pattern as a whole.
IRREGULAR = rf"(?:^|[{_WS}]) |(?: (?:$|[{_WS}]))"


class RankQueue:
    """Buckets of positions by rank, and bitmaps of 64-bit words that lead to the lowest rank that has one."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word, rank = rank >> 6, rank & 63
            before = level[word]
            level[word] = before | (1 << rank)
            if before:
                return
            rank = word

    def first(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        bucket = self.buckets.pop(rank)
        for level in self.levels:
            word, rank = rank >> 6, rank & 63
            level[word] &= ~(1 << rank)
            if level[word]:
                break
            rank = word
        return bucket


class ByteBPE:
    def __init__(self, path: str, pattern: str, rank_lines: list[bytes] | None = None):
        import regex

        lines = rank_lines if rank_lines is not None else open(path, "rb").read().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.size = max(self.bytes_of) + 1
        self.one = [self.ranks[bytes([b])] for b in range(256)]
        ranks = self.ranks
        #: The token that two neighbours merge into; its id is the merge's rank.
        self.merge = {(ranks[t[:k]] << 20) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pieces: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.begun: dict[str, bytes] = {}

    def merged(self, parts: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token."""
        merge, queue = self.merge.get, RankQueue(self.size)
        ids, heads = [], []
        for p in parts:
            heads.append(len(ids))
            ids.extend([self.one[b] for b in p])
            ids.append(-1)  # a wall: -1 merges with nothing
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [-1] * n
        held, push = queue.buckets, queue.push
        for i, (a, b) in enumerate(zip(ids, ids[1:])):  # noqa: B905
            if a >= 0 and b >= 0:
                r = merge((a << 20) | b)
                if r is not None:
                    rank_at[i] = r
                    if r in held:
                        held[r].append(i)
                    else:
                        push(r, i)
        while (rank := queue.first()) >= 0:
            bucket = sorted(queue.take(rank))
            for k, i in enumerate(bucket):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                ids[i], rank_at[j] = rank, -1
                after[i] = e = after[j]
                before[e] = i
                lower = False
                for x, y in ((before[i], i), (i, e)):
                    if x >= 0 and ids[x] >= 0:
                        r = merge((ids[x] << 20) | ids[y]) if ids[y] >= 0 else None
                        rank_at[x] = -1 if r is None else r
                        if r is not None:
                            if r in held:
                                held[r].append(x)
                            else:
                                push(r, x)
                            lower = lower or r < rank
                if lower:  # a new pair comes before the rest of this bucket
                    for x in bucket[k + 1 :]:
                        push(rank, x)
                    break
        out = []
        for i in heads:
            own = []
            while ids[i] >= 0:
                own.append(ids[i])
                i = after[i]
            out.append(own)
        return out

    def encode_pieces(self, pieces: set[str]) -> None:
        """Fills the cache for these pre-tokens; a whole token is itself, all others share one queue."""
        todo = []
        for p in pieces:
            if p not in self.pieces:
                b = p.encode()
                whole = self.ranks.get(b)
                if whole is not None:
                    self.pieces[p] = array("I", [whole]).tobytes()
                else:
                    todo.append((p, b))
        for (p, _), ids in zip(todo, self.merged([b for _, b in todo]), strict=True):
            self.pieces[p] = array("I", ids).tobytes()

    def fill(self, runs: list[str], blank: str, cache: dict[str, bytes]) -> None:
        new = [x for x in runs if x not in cache]
        if len(cache) + len(new) > CACHE_RUNS:
            cache.clear()
            new = runs
        if len(self.pieces) > CACHE_RUNS:
            self.pieces.clear()
        cut = [self.find(blank + x) for x in new]
        self.encode_pieces({p for c in cut for p in c})
        for x, c in zip(new, cut, strict=True):
            cache[x] = b"".join([self.pieces[p] for p in c])
        for p in {p for c in cut for p in c if len(p) > LONGEST_KEPT}:
            del self.pieces[p]

    def encoded(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers."""
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        names, index, at = blank_runs(pc.if_else(pa.array(odd), "", texts))
        names = names.to_pylist()
        self.fill(names, " ", self.inner)
        inner = [self.inner[x] for x in names]
        firsts = [names[i] for i in index[at[:-1]]]
        self.fill(list(dict.fromkeys(firsts)), "", self.begun)
        # a text's first run has no blank before it: it takes a place of its own after all others
        begun = list(dict.fromkeys(firsts))
        place = {x: len(names) + k for k, x in enumerate(begun)}
        index = index.copy()
        index[at[:-1]] = [place[x] for x in firsts]
        ids, begins = spread(inner + [self.begun[x] for x in begun], index, np.uint32)
        cuts = begins[at]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.nonzero(odd)[0]:
            pieces = self.find(texts[int(i)].as_py())
            self.encode_pieces(set(pieces))
            out[i] = np.frombuffer(b"".join([self.pieces[p] for p in pieces]), np.uint32)
            for p in {p for p in pieces if len(p) > LONGEST_KEPT}:
                del self.pieces[p]
            if len(self.pieces) > CACHE_RUNS:
                self.pieces.clear()
        for cache in (self.inner, self.begun):
            for x in (*names, *begun):
                if len(x) > LONGEST_KEPT:
                    cache.pop(x, None)
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_kept: dict[tuple[str, str], ByteBPE] = {}


def of_worker(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _kept:
        _kept[path, pattern] = ByteBPE(path, pattern)
    return _kept[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document. One pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = of_worker(path, pattern)
        for batch in batches:
            ids = bpe.encoded(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decoded(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
