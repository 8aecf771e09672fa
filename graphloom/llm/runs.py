"""A batch of texts as runs between blanks: each different run once, and the places where it stands.

Everything that handles words does its work once per different run of a batch and spreads the result by
an index, so Python never loops over all words of a corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _list(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    flat = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def runs(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different runs between white space, the index of each run in order, and where each text's runs begin (one more entry than texts). A text of white space only is one empty run.

    Texts are trimmed first: Arrow's split now and then leaves a blank at a text's end in its last run.
    """
    texts = pc.utf8_trim_whitespace(texts)
    return _list(pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts))


def blank_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same, but cut at each single blank."""
    return _list(pc.split_pattern(texts, pattern=" "))


def spread(parts: list[bytes], index: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """parts[i] for each i of index, one after the other, as values of dtype; and where each begins."""
    width = np.dtype(dtype).itemsize
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    blob = np.frombuffer(b"".join(parts), dtype)
    n = sizes[index]
    ends = np.cumsum(n)
    begins = ends - n
    total = int(ends[-1]) if len(ends) else 0
    return blob[np.repeat(starts[index] - begins, n) + np.arange(total)], np.concatenate([begins, [total]])


#: Odd multipliers of a 64-bit mixing function.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of several columns of hashes, in their order."""
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + c)
    return out
