"""Documents as token sequences of one length, balanced by the cost of attention."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import BATCH_ROWS, bound_batches
from veriloom.llm.tokens import load_encoder

LENGTH = 2048
END_ID = 1
#: Pieces that are packed together, about; more of them leave less padding.
GROUP_PIECES = 1 << 14


def cost(tokens: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    """Estimated cost of a piece: layers that work token by token, and attention within the piece."""
    return linear * tokens + quadratic * tokens.astype(float) ** 2


class _Rooms:
    """Sequences by remaining capacity; finds the cheapest one with room for a piece.

    A tree over the capacities 0..length keeps the least cost on each branch, so
    a step takes time in the logarithm of the length.
    """

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list] = [[] for _ in range(length + 1)]
        self.tree = [(np.inf, -1)] * (2 * self.size)

    def _refresh(self, room: int) -> None:
        i = room + self.size
        self.tree[i] = (self.heaps[room][0][0], room) if self.heaps[room] else (np.inf, -1)
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, room: int, price: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (price, sequence))
        self._refresh(room)

    def take(self, needed: int):
        """(room, price, sequence) of the cheapest sequence with ``needed`` tokens of room, or None."""
        lo, hi, best = needed + self.size, 2 * self.size, (np.inf, -1)
        while lo < hi:
            if lo & 1:
                best = min(best, self.tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo // 2, hi // 2
        if best[1] < 0:
            return None
        price, sequence = heapq.heappop(self.heaps[best[1]])
        self._refresh(best[1])
        return best[1], price, sequence


def assign(lengths: np.ndarray, length: int, linear: float = 1.0, quadratic: float = 1 / 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece.

    Pieces go in descending order of cost to the cheapest sequence that has room.
    As many sequences are open from the start as their tokens fill; another is
    opened when a piece fits in none.
    """
    n = len(lengths)
    order = np.lexsort((np.arange(n), -lengths))
    price = cost(lengths, linear, quadratic)
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    full = int((lengths == length).sum())
    sequence[order[:full]] = np.arange(full)
    opened = full + -(-int(lengths[order[full:]].sum()) // length)
    rooms = _Rooms(length)
    for s in range(full, opened):
        rooms.put(length, 0.0, s)
    for i in order[full:].tolist():
        needed = int(lengths[i])
        found = rooms.take(needed)
        if found is None:
            found, opened = (length, 0.0, opened), opened + 1
        room, spent, s = found
        sequence[i], offset[i] = s, length - room
        rooms.put(room - needed, spent + float(price[i]), s)
    return sequence, offset


def _pack_batches(batches, length: int, end_id: int, path: str | None, linear: float, quadratic: float, group_pieces: int):
    """Cuts texts into pieces and packs those of about ``group_pieces`` pieces at a time; sequence ids start with the task's number."""
    encoder, sequence = load_encoder(path), TaskContext.get().partitionId() << 32
    kinds = {"ids": pa.binary()}
    held = {"doc_id": [], "start": [], "length": [], "doc_tokens": [], "ids": []}

    def packed():
        nonlocal sequence
        numbers, offset = assign(np.array(held["length"], dtype=np.int64), length, linear, quadratic)
        columns = {**held, "sequence_id": numbers + sequence, "offset": offset}
        sequence += int(numbers.max()) + 1
        for at in range(0, len(numbers), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(v[at:at + BATCH_ROWS], kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))
        for values in held.values():
            values.clear()

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*encoder.encode(text), end_id], dtype="<u4")
            for at in range(0, len(ids), length):
                piece = ids[at:at + length]
                for name, value in zip(held, (doc, at, len(piece), len(ids), piece.tobytes())):
                    held[name].append(value)
            if len(held["doc_id"]) >= group_pieces:
                yield from packed()
    if held["doc_id"]:
        yield from packed()


def pack(docs: DataFrame, payload: Column | None = None, length: int = LENGTH, end_id: int = END_ID, tokenizer_path: str | None = None,
         linear: float = 1.0, quadratic: float = 1 / 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, payload) per piece of every row of ``docs``.

    Whole texts become ids with an end id, cut every ``length`` ids; all pieces of
    a document but the last are full. ``ids`` holds little-endian unsigned 32-bit
    numbers, ``payload`` is an expression over them, the ids themselves if none is
    given. The pieces of a sequence follow each other without a gap and hold at
    most ``length`` ids together.

    Pieces that one task cuts one after the other are packed together, about
    ``group_pieces`` at a time, so no id is stored or moved; a task with fewer
    pieces packs what it has. Null texts count as empty and are one end id.
    Repeated rows are packed as often as they occur; null ids stay null; an empty
    table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _pack_batches(it, length, end_id, tokenizer_path, linear, quadratic, group_pieces),
        "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*names, F.col("ids") if payload is None else payload)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the joined ids of each sequence and the lengths of its pieces, for block-diagonal attention."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
                    F.col("parts.length").alias("lengths")))
