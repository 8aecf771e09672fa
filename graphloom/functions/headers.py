"""Column headers to tokens: split of run-together words, separators, repairs, tags and spans.

One Arrow-batched function; headers are a catalog's columns, so rows are few and short. The lexicon is a parameter of bounded
size (a list of words, the more frequent first); words, stop words and numbers are told apart by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUM, STOPWORD, WORD, UNK = "NUM", "STOPWORD", "WORD", "UNK"
#: Words that are never expanded.
STOPWORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was with".split())
SCHEMA = "tokens array<string>, separators array<string>, tags array<string>, tokenized string, starts array<int>, ends array<int>, unambiguous boolean, entries array<string>"
_NUMBER = re.compile(r"\d+(\.\d+)?")


def split_run(run: str, cost: dict[str, float]) -> list[str]:
    """The cheapest way to cut letters into words; a letter of no word is a piece of its own. Ties go to the longer last word."""
    longest = max(map(len, cost), default=1)
    best: list[tuple[float, int]] = [(0.0, 0)]
    low = run.lower()
    for i in range(1, len(run) + 1):
        best.append(min((best[i - k][0] + cost.get(low[i - k : i], 30.0 if k == 1 else math.inf), -k) for k in range(1, min(i, longest) + 1)))
    out, i = [], len(run)
    while i:
        k = -best[i][1]
        out.append(run[i - k : i])
        i -= k
    return out[::-1]


def _merged(tokens: list[str], seps: list[str], glue: list[bool]) -> tuple[list[str], list[str]]:
    """Tokens joined over each boundary that glue names."""
    out = [tokens[0]]
    for t, s, g in zip(tokens[1:], seps, glue, strict=True):
        if g:
            out[-1] += s + t
        else:
            out.append(t)
    return out, [s for s, g in zip(seps, glue, strict=True) if not g]


def single_letters(tokens: list[str], seps: list[str]) -> tuple[list[str], list[str]]:
    """A letter on its own goes to the token before it, else to the one after it, if nothing lies between and the case is the same."""
    alone = [len(t) == 1 and t.isalpha() for t in tokens]
    alike = [s == "" and a[-1].isupper() == b[0].isupper() for a, b, s in zip(tokens, tokens[1:], seps, strict=False)]
    glue = [ok and later for ok, later in zip(alike, alone[1:], strict=True)]
    for i, ok in enumerate(alike):
        if ok and alone[i] and not (i and glue[i - 1]):
            glue[i] = True
    return _merged(tokens, seps, glue)


def split_words(tokens: list[str], seps: list[str], known) -> tuple[list[str], list[str]]:
    """Runs of tokens with nothing or a hyphen between become one if that is a known word. A number beside one other token, or between two, stays apart."""
    glue = [False] * len(seps)
    for weak, places in groupby(range(len(seps)), key=lambda i: seps[i] in ("", "-")):
        at = list(places)
        part = tokens[at[0] : at[-1] + 2]
        if not weak or (len(part) == 2 and any(map(_NUMBER.fullmatch, part))):
            continue
        word = "".join(t + s for t, s in zip(part, [*(seps[i] for i in at), ""], strict=True))
        if known(word) and not re.search(r"\D\d+(\.\d+)?\D", word):
            for i in at:
                glue[i] = True
    return _merged(tokens, seps, glue)


def analyse(header: str, cost: dict[str, float]) -> dict:
    """What SCHEMA says of one header; an empty one has no tokens."""
    tag = lambda t: NUM if _NUMBER.fullmatch(t) else STOPWORD if len(t) == 1 or t.lower() in STOPWORDS else WORD if t.lower() in cost else UNK
    found = [(m.start() + sum(map(len, pieces[:k])), p) for m in re.finditer(r"\d+(?:\.\d+)?|[^\W\d_]+", header) for pieces in [[m[0]] if m[0][0].isdigit() else split_run(m[0], cost)] for k, p in enumerate(pieces)]
    tokens = [t for _, t in found]
    seps = [header[a + len(t) : b] for (a, t), (b, _) in zip(found, found[1:], strict=False)]
    if tokens:
        tokens, seps = split_words(*single_letters(tokens, seps), lambda w: tag(w) in (WORD, STOPWORD))
    tags = [tag(t) for t in tokens]
    seps = [" " if s in ("", "_") else s for s in seps]
    ends = list(accumulate(len(t) + n for t, n in zip(tokens, [0, *map(len, seps)], strict=False)))
    entries = [header]
    for i, (t, kind) in enumerate(zip(tokens, tags, strict=True)):
        if len(tokens) > 1 and kind == WORD:
            entries.append(t)
        if kind == NUM and i and tags[i - 1] != STOPWORD:
            entries.append(tokens[i - 1] + seps[i - 1] + t)
        if kind == NUM and i < len(seps) and tags[i + 1] != STOPWORD:
            entries.append(t + seps[i] + tokens[i + 1])
    return {"tokens": tokens, "separators": seps, "tags": tags, "tokenized": "".join(t + s for t, s in zip(tokens, [*seps, ""], strict=False)), "starts": [e - len(t) for e, t in zip(ends, tokens, strict=True)], "ends": ends, "unambiguous": UNK not in tags and not header.startswith("Unknown_Header"), "entries": list(dict.fromkeys(entries))}


def costs(lexicon: Sequence[str]) -> dict[str, float]:
    """Zipf's law: the k-th word costs log(k log n)."""
    n = math.log(len(lexicon) + 2)
    return {w.lower(): math.log((k + 1) * n) for k, w in enumerate(lexicon)}


def tokenised(header: Column, lexicon: Sequence[str]) -> Column:
    table = costs(lexicon)

    @F.pandas_udf(SCHEMA)
    def run(headers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse(h or "", table) for h in headers], columns=["tokens", "separators", "tags", "tokenized", "starts", "ends", "unambiguous", "entries"])

    return run(header)
