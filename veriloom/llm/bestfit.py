"""Documents as few sequences as possible: exact complements by hashed length sums, then best fit for what is left.

A piece has one of ``length`` lengths, so how many pieces there are of each length
says all that packing depends on. The plan is made on these counts (a table whose
size does not grow with the documents) and holds *patterns*: lengths that share a
sequence, and how many sequences look like that. Pieces then find their place by
their number among the pieces of their length; no piece meets another one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, stored
from veriloom.llm.tokens import load_encoder

LENGTH = 1024
END_ID = 2


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all are full but the first, which takes what is over."""
    first = total % length or min(total, length)
    return [(0, first), *((at, length) for at in range(first, total, length))]


def _cut_batches(batches, length: int, end_id: int, path: str | None):
    encoder, part = load_encoder(path), TaskContext.get().partitionId()
    seen = [0] * (length + 1)
    for batch in batches:
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "part": [], "number": [], "ids": []}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*encoder.encode(text), end_id], dtype="<u4")
            for i, (at, n) in enumerate(cuts(len(ids), length)):
                for name, value in zip(out, (doc, i, at, n, part, seen[n], ids[at:at + n].tobytes())):
                    out[name].append(value)
                seen[n] += 1
        kinds = {"ids": pa.binary(), "piece": pa.int32(), "part": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def cut(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, part, number, ids) of whole texts with an end id.

    ``ids`` holds little-endian unsigned 32-bit numbers; ``number`` counts the
    pieces of one length in a task, ``part`` is that task. Null texts are empty.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _cut_batches(it, length, end_id, tokenizer_path),
        "doc_id long, piece int, start long, length long, part int, number long, ids binary")


class Sums:
    """Which single, pair or triple of the lengths still there adds up to a gap.

    Pairs are hashed by their sum, the most even pair first. Lengths only run out,
    so the larger half of a sum's first pair only moves up: an entry is a pointer.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.larger = {s: (s + 1) // 2 for s in range(2, len(counts))}

    def single(self, gap: int, cap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap <= cap and self.counts[gap] else None

    def pair(self, gap: int, cap: int) -> tuple[int, ...] | None:
        c, x = self.counts, self.larger.get(gap, gap)
        while x < gap and not (c[x] > (2 * x == gap) and c[gap - x]):
            x += 1
        self.larger[gap] = x
        return (x, gap - x) if x < gap and x <= cap else None

    def triple(self, gap: int, cap: int) -> tuple[int, ...] | None:
        c = self.counts
        for z in range(min(cap, gap - 2), 0, -1):
            if c[z] and (two := self.pair(gap - z, cap)) and c[z] > two.count(z):
                return (z, *two)
        return None


@dataclass
class Pattern:
    """``count`` sequences that hold these (length, repeats) one after the other and have ``room`` left."""

    parts: tuple[tuple[int, int], ...]
    count: int
    room: int


def exact_patterns(counts: np.ndarray, length: int, most: int = 3) -> list[Pattern]:
    """Takes from ``counts`` what a piece and at most ``most`` others fill exactly, long pieces first."""
    found = [Pattern(((length, 1),), int(counts[length]), 0)] if counts[length] else []
    counts[length] = 0
    sums = Sums(counts)
    kinds = (sums.single, sums.pair, sums.triple)[:most]
    for a in range(length - 1, 0, -1):
        cap = a
        while counts[a]:
            filled = next((f for look in kinds if (f := look(length - a, cap))), None)
            needed = Counter((a, *filled)) if filled else Counter()
            times = min((int(counts[n]) // k for n, k in needed.items()), default=0)
            if times:
                for n, k in needed.items():
                    counts[n] -= k * times
                found.append(Pattern(tuple(sorted(needed.items(), reverse=True)), times, 0))
            elif filled and cap == a:
                cap = a - 1  # too few of this length to be its own filling
            else:
                break
    return found


def best_fit(counts: np.ndarray, length: int) -> list[Pattern]:
    """Descending lengths into the tightest sequences with room; equal pieces and equal sequences in one step."""
    rooms: dict[int, list[Pattern]] = defaultdict(list)
    for a in range(length, 0, -1):
        left = int(counts[a])
        while left:
            room = min((r for r, p in rooms.items() if p and r >= a), default=None)
            have = rooms[room].pop() if room is not None else Pattern((), left, length)
            most = have.room // a
            taken = min(have.count, left // most)
            each = most
            if not taken:
                taken, each = 1, left
            if have.parts and have.count > taken:
                rooms[have.room].append(Pattern(have.parts, have.count - taken, have.room))
            rooms[have.room - each * a].append(Pattern((*have.parts, (a, each)), taken, have.room - each * a))
            left -= taken * each
    return [p for group in rooms.values() for p in group]


def fewest(counts: np.ndarray, length: int) -> list[Pattern]:
    """The patterns of the fewest sequences: combinations of up to three, two, one or no others are used up before best fit.

    Short pieces used up early can be missing where long ones have gaps, so the largest combinations aren't always the best.
    """
    plans = []
    for most in (3, 2, 1, 0):
        left = counts.copy()
        plans.append(exact_patterns(left, length, most) + best_fit(left, length))
    return min(plans, key=lambda patterns: sum(p.count for p in patterns))


def plan(counts: dict[int, int], length: int = LENGTH) -> pd.DataFrame:
    """(length, first, per, sequence, offset): from its ``first`` on, ``per`` pieces of a length share a sequence, from ``sequence`` and ``offset`` on."""
    left = np.zeros(length + 1, dtype=np.int64)
    for n, k in counts.items():
        left[n] = k
    patterns = fewest(left, length)
    rows, used, sequence = [], Counter(), 0
    for p in patterns:
        at = 0
        for n, each in p.parts:
            rows.append((n, used[n], each, sequence, at))
            used[n] += each * p.count
            at += n * each
        sequence += p.count
    return pd.DataFrame(rows, columns=["length", "first", "per", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def place(blocks: pd.DataFrame, length: np.ndarray, number: np.ndarray) -> pd.DataFrame:
    """(sequence_id, offset) of pieces given by length and number among the pieces of that length."""
    key = (blocks["length"].to_numpy() << 48) + blocks["first"].to_numpy()
    at = blocks.iloc[np.searchsorted(key, (length << 48) + number, side="right") - 1]
    k = number - at["first"].to_numpy()
    per = at["per"].to_numpy()
    return pd.DataFrame({"sequence_id": at["sequence"].to_numpy() + k // per, "offset": at["offset"].to_numpy() + k % per * length})


def pack(docs: DataFrame, payload: Column | None = None, length: int = LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset, payload) per piece of every row of ``docs``.

    Documents of at most ``length`` ids stay whole; longer ones are cut from their
    end, so only the first piece may be shorter. ``payload`` is an expression over
    ``ids``, the ids themselves if none is given. Null texts are one end id, null
    ids stay null, repeated rows are packed as often as they occur, an empty table
    gives an empty one; other columns are left out.
    """
    ids = F.col("ids") if payload is None else payload
    names = ["doc_id", "piece", "start", "length"]
    pieces = stored(cut(docs, length, end_id, tokenizer_path).select(*names, "part", "number", ids), "fitted")
    of_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    blocks = plan({r["length"]: r["n"] for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)  # at most one row a length
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = of_part.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(size: pd.Series, number: pd.Series) -> pd.DataFrame:
        return place(blocks, size.to_numpy(), number.to_numpy())

    rest = [c for c in pieces.columns if c not in {*names, "part", "number"}]
    return (pieces.join(before, ["part", "length"]).withColumn("at", placed("length", F.col("before") + F.col("number")))
            .select(*names, "at.sequence_id", "at.offset", *rest))
