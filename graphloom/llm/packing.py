"""Best-fit packing by bin completion: documents' tokens into as few sequences of fixed length as can be.

Tokens are made once, in one pass over the texts; from then on only (document, piece, length) moves.
Pieces as long as a sequence are one. All others are dealt by a hash of their place into groups of a bounded number,
so no task ever gets more than about a group, and neither a hot document or source nor repeated rows meet in one. Each group is packed on its own:

* best-fit decreasing gives the incumbent, and total / capacity with the number of pieces over half a
  sequence a lower bound; where they meet the packing is proven best.
* else branch and bound over bin completions: the largest piece left opens a sequence, its undominated
  maximal fillings are enumerated by least waste, a branch is cut as soon as its waste exceeds what a
  packing with one sequence less could waste, and each better packing becomes the incumbent. The search is a heuristic
  where NODES (branches of a group), BRANCHES (fillings tried at a node) or STEPS (of one enumeration) cut it short; the
  incumbent stands then, and bin_completion says that it isn't proven. With these at their highest the search is complete.

The OPEN emptiest sequences of every group are taken apart and their pieces packed once more, in groups again,
until they are one group: what the borders of groups waste doesn't grow with the number of groups.

Defined results: a null or empty text is one piece that holds only the closing id 0. Repeated rows are
packed one by one. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, small_batches, table, tidy
from .wordbpe import LIMIT, of_worker, vocabulary

GROUP_ROWS = 8192
NODES = 8_000
#: Fillings tried at a node, by least waste, and steps of their enumeration.
BRANCHES, STEPS = 4, 60
#: Sequences of a group that are packed again with those of other groups.
OPEN = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(counts: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing. counts[n]: pieces of n tokens. The open sequences' room is a bitmap, searched by find-first-set."""
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    bits, out = 0, []
    for size in range(capacity, 0, -1):
        for _ in range(counts[size]):
            fits = bits >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                bin_ = rooms[room].pop()
                if not rooms[room]:
                    bits &= ~(1 << room)
            else:
                room, bin_ = capacity, []
                out.append(bin_)
            bin_.append(size)
            if room > size:
                rooms[room - size].append(bin_)
                bits |= 1 << (room - size)
    return out


def fillings(counts: list[int], present: int, room: int, most_waste: int, most: int = BRANCHES, steps: int = STEPS) -> tuple[list[list[int]], bool]:
    """Undominated maximal fillings of the room, by least waste, and whether they are all: a filling falls if one piece could stand for two of its own and still fit, or if a piece left over would fit too.

    present: a bitmap of the lengths of which pieces are left. steps bounds the enumeration, most what comes out.
    """
    found: list[tuple[int, list[int]]] = []
    left = steps

    def grow(chosen: list[int], room: int, largest: int) -> None:
        nonlocal left
        left -= 1
        fit = present & ((2 << min(largest, room)) - 1)
        tried = False
        while fit and left > 0 and not (len(found) >= most and all(waste == 0 for waste, _ in found)):
            n = fit.bit_length() - 1
            fit ^= 1 << n
            if counts[n] > chosen.count(n):
                tried = True
                grow([*chosen, n], room - n, n)
                if n == room:
                    return  # it fills the room: nothing with the same start is better
        if not tried and room <= most_waste and not spare_piece(chosen, 1, room) and not dominated(chosen, room):
            found.append((room, chosen))

    def spare_piece(chosen: list[int], low: int, high: int) -> bool:
        """Whether a piece of low to high tokens is left over."""
        bits = (present >> low) & ((2 << max(-1, high - low)) - 1) if high >= low else 0
        while bits:
            n = bits.bit_length() - 1
            bits ^= 1 << n
            if counts[n + low] > chosen.count(n + low):
                return True
        return False

    def dominated(chosen: list[int], waste: int) -> bool:
        return any(spare_piece(chosen, x + y, x + y + waste) for i, x in enumerate(chosen) for y in chosen[i + 1 :])

    grow([], room, room)
    found.sort(key=lambda x: x[0])
    return [x for _, x in found[:most]], left > 0 and len(found) < most


def bin_completion(counts: list[int], capacity: int, nodes: int = NODES, branches: int = BRANCHES, steps: int = STEPS) -> tuple[list[list[int]], bool]:
    """A packing of the pieces as lists of lengths, the best found, and whether it is proven best: it meets the bound, or the whole search found no better one."""
    whole = True
    incumbent = best_fit(counts, capacity)
    total = sum(n * c for n, c in enumerate(counts))
    least = max(-(-total // capacity), sum(counts[capacity // 2 + 1 :]))
    while len(incumbent) > least and nodes > 0:
        spare = (len(incumbent) - 1) * capacity - total  # a packing with one sequence less wastes no more
        left, done, stack = list(counts), [], []
        present = sum(1 << n for n, c in enumerate(counts) if c)
        count, found, waste = sum(counts), None, 0

        def take(filling: list[int], sign: int) -> None:
            nonlocal present, count
            for x in filling:
                left[x] -= sign
                present = present | (1 << x) if left[x] else present & ~(1 << x)
            count -= sign * len(filling)

        while nodes > 0:
            if count == 0:
                found = [list(x) for x in done]
                break
            nodes -= 1
            n = present.bit_length() - 1
            take([n], 1)
            options, all_of_them = fillings(left, present, capacity - n, spare - waste, branches, steps)
            whole = whole and all_of_them
            options = [[n, *x] for x in options]
            take([n], -1)
            stack.append([options, None, waste])  # the fillings not tried yet, the one in place, the waste before it
            while stack:
                top = stack[-1]
                if top[1] is not None:
                    take(top[1], -1)
                    done.pop()
                    top[1] = None
                if top[0]:
                    top[1] = top[0].pop(0)
                    take(top[1], 1)
                    done.append(top[1])
                    waste = top[2] + capacity - sum(top[1])
                    break
                stack.pop()
            if not stack:
                break
        if found is None or len(found) >= len(incumbent):
            return incumbent, whole and nodes > 0
        incumbent, whole = found, True
    return incumbent, len(incumbent) <= least


def pack(lengths: np.ndarray, capacity: int = LIMIT, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset in it of each piece."""
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    by_length = [list(x) for x in np.split(np.argsort(lengths, kind="stable"), np.cumsum(counts)[:-1])]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, bin_ in enumerate(bin_completion(counts, capacity, nodes)[0]):
        at = 0
        for n in bin_:
            i = by_length[n].pop()
            where[i], offset[i] = k, at
            at += n
    return where, offset


def emptiest(lengths: np.ndarray, where: np.ndarray, capacity: int, most: int = OPEN) -> np.ndarray:
    """Which pieces lie in one of the sequences with most room; beyond the first only as long as they are a quarter of all pieces at most."""
    filled, held = np.bincount(where, weights=lengths), np.bincount(where)
    order = np.argsort(filled, kind="stable")[:most]
    fits = np.cumsum(held[order]) <= len(lengths) // 4
    fits[0] = True
    return np.isin(where, order[fits & (filled[order] < capacity)])


def pieces(docs: DataFrame, path: str, capacity: int = LIMIT) -> DataFrame:
    """Each document's ids with a closing 0, cut only where longer than a sequence."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        bpe = of_worker(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.packed(batch.column(1)), strict=True):
                ids = ids.tobytes() + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return id_and_text(docs).mapInArrow(tidy(run), PIECES)


def pack_documents(docs: DataFrame, path: str, capacity: int = LIMIT, group_rows: int = GROUP_ROWS, nodes: int = NODES) -> DataFrame:
    """All pieces with their sequence and place. The pieces' numbers are written once and shuffled once, those of the emptiest sequences again."""

    def in_group(level: int, last: bool):
        def run(group: pa.Table) -> pa.Table:
            lengths = group.column("length").to_numpy()
            where, offset = pack(lengths, capacity, nodes)
            again = np.zeros(len(lengths), bool) if last else emptiest(lengths, where, capacity)
            ids = (level << 56) + (group.column("g").to_numpy() << 24) + where
            return group.drop_columns(["g"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again))

        return run

    made = cut(pieces(docs, path, capacity)).withColumn("r", F.monotonically_increasing_id())  # of written rows, so a rerun gives the same
    whole = F.col("length") == capacity
    left, level = made.where(~whole), 0
    done = [made.where(whole).select("*", (-1 - F.col("r")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rows = left.count()
    shrinks = True
    while rows:
        groups = -(-rows // group_rows)
        last = groups == 1 or not shrinks
        packed = left.withColumn("g", F.pmod(F.xxhash64("r", F.lit(level)), F.lit(groups))).groupBy("g").applyInArrow(in_group(level, last), PIECES + ", r long, sequence_id long, offset long, again boolean")
        if not last:
            packed = cut(packed)
        done.append(packed.where("not again").drop("again"))
        left, level = packed.where("again").select(*made.columns), level + 1
        before, rows = rows, 0 if last else left.count()
        shrinks = 2 * rows <= before  # else a sequence holds most of a group's pieces, and the next level is the last one
    return reduce(DataFrame.unionByName, done).drop("r")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
