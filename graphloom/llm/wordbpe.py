"""The word tokenizer's ids of whole texts, and token counts of huge documents by overlap resynchronisation.

The tokenizer drops white space and never lets a token or a special string span it, and none of its
normalisers looks across it. So a text's ids are those of its runs between blanks, in order, and each
run is encoded by the library once and then kept in a bounded cache.

Overlap resynchronisation is for documents too long to encode at once: chunks that overlap are encoded
with offsets; two neighbours are spliced at a place in their overlap that is provably stable (a token
starts there in both, right after white space) and after which both give the same tokens to the end of
the last whole run in the overlap. If there is none (a run longer than the overlap), the overlap is
doubled, up to the whole chunk, and then the chunk itself grows.

Defined results: a null or empty text, or one of white space only, has 0 tokens. Special strings in a
text become the special token, as is the library's default. Repeated rows are counted one by one.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, id_and_text, kept, small_batches, table, tidy
from .runs import runs, spread

#: Blanks at which runs are cut: white space for the library and for Python alike.
PLAIN = re.compile("[ \t\n\r]+")
#: A text without these characters is lower-cased at once and cut at any white space: common blanks, letters below U+0250.
RARE = r"[^\t\n\r -~\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"
#: Bounds the cache: beyond it, it starts anew.
CACHE_RUNS = 600_000
LONGEST_KEPT = 32
#: The byte-level alphabet. Printable bytes stand for themselves, the others for the code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 11
LIMIT = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBPE(dict):
    """A run's packed ids (little-endian unsigned 32-bit), by the run; what is missing is encoded by the library."""

    def __init__(self, path: str, most: int = CACHE_RUNS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.tokenize, self.ends = self.library.model.tokenize, {}

    def __missing__(self, run: str) -> bytes:
        """A run in lower case. One of letters only is one pre-token, of which the library's model has the ids; one full stop or comma after it is a pre-token of its own."""
        if run.isalpha():
            out = self.of_letters(run)
        elif run[-1:] in (".", ",") and run[:-1].isalpha():
            end = self.ends.get(run[-1]) or self.ends.setdefault(run[-1], self.encoded(run[-1]))
            out = (self.get(run[:-1]) or self.of_letters(run[:-1])) + end
        else:
            out = self.encoded(run)
        if len(run) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[run] = out
        return out

    def of_letters(self, run: str) -> bytes:
        spelt = run if run.isascii() else run.encode().decode("latin-1").translate(BYTE_LEVEL)
        return array("I", [t.id for t in self.tokenize(spelt)]).tobytes()

    def encoded(self, run: str) -> bytes:
        return array("I", self.library.encode(run, add_special_tokens=False).ids).tobytes()

    def packed(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids, as unsigned 32-bit integers."""
        rare = pc.match_substring_regex(texts, RARE).to_numpy(zero_copy_only=False)
        names, index, at = runs(pc.if_else(pa.array(rare), "", texts), lower=True)
        ids, begins = spread(list(map(self.__getitem__, names.to_pylist())), index, np.uint32)
        cuts = begins[at]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.nonzero(rare)[0]:
            out[i] = np.frombuffer(b"".join([self.encoded(x) for x in PLAIN.split(texts[int(i)].as_py()) if x]), np.uint32)
        return out

    def offsets(self, text: str, start: int) -> tuple[list[int], list[int]]:
        """ids and where each begins in the whole text, of the chunk that begins at start."""
        e = self.library.encode(text, add_special_tokens=False)
        return e.ids, [start + x for x, _ in e.offsets]


def splice_at(text: str, left: tuple, right: tuple, low: int, high: int) -> int | None:
    """The first place of text[low:high] from which both encodings agree to the last whole run, and that follows white space."""
    ends = [m.start() for m in PLAIN.finditer(text, low, high)]
    if not ends:
        return None
    last = ends[-1]
    (a, at), (b, bt) = left, right
    for m in PLAIN.finditer(text, low, high):
        p = m.end()
        if p >= last:
            break
        i, j = bisect_left(at, p), bisect_left(bt, p)
        k, n = bisect_left(at, last), bisect_left(bt, last)
        if i < k and at[i] == p and j < n and bt[j] == p and a[i:k] == b[j:n] and at[i:k] == bt[j:n]:
            return p
    return None


def resynchronised(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], int]:
    """The ids of a text of any length, and the number of chunks, never encoding more than a chunk at a time unless a run is longer."""
    if len(text) <= chunk:
        return encode(text, 0)[0], 1
    ids: list[int] = []
    start, end, n = 0, chunk, 1
    left, done = encode(text[:end], 0), 0  # what begins before done is counted
    while end < len(text):
        width, size = min(overlap, (end - start) // 2), chunk
        while True:
            low = max(start, done, end - width)
            until = min(len(text), low + max(size, 2 * (end - low)))
            right = encode(text[low:until], low)
            n += 1
            p = splice_at(text, left, right, low, end)
            if p is not None:
                i, j = bisect_left(left[1], done), bisect_left(left[1], p)
                ids += left[0][i:j]
                start, end, left, done = low, until, right, p
                break
            if low > max(start, done):
                width *= 2
            elif until == len(text):
                left, end = encode(text[done:], done), until
                break
            else:
                left, end = encode(text[done:until], done), until
                n, start, width = n + 1, done, overlap
                if end == len(text):
                    break
    return ids + left[0][bisect_left(left[1], done) :], n


_kept: dict[str, WordBPE] = kept("wordbpe", {})


def of_worker(path: str) -> WordBPE:
    """One tokenizer for a Python worker, kept from task to task of this kind."""
    alone("wordbpe")
    if path not in _kept:
        _kept[path] = WordBPE(path)
    return _kept[path]


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_chunks of every document; huge ones are resynchronised. One pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = of_worker(path)
        for batch in batches:
            texts = batch.column(1)
            huge = pc.greater(pc.utf8_length(texts), chunk)
            counts = [len(x) for x in bpe.packed(pc.if_else(huge, "", texts))]
            chunks = [1] * len(counts)
            for i in np.nonzero(huge.to_numpy(zero_copy_only=False))[0]:
                ids, chunks[i] = resynchronised(texts[int(i)].as_py(), bpe.offsets, chunk, overlap)
                counts[i] = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(chunks, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return id_and_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, n_chunks long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chunks")
