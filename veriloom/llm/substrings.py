"""Repeated passages: documents meet at winnowed anchors, equal digests of the windows there are found, and the runs they cover cut out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, hashes, stored, words_of

WINDOW = 20
#: Words of an anchor. Each window has WINDOW - ANCHOR + 1 of them, one of which it shares with every equal window.
ANCHOR = 5
#: One in so many documents shows which anchors are frequent, and so how rows are dealt; what is found does not depend on it.
LAYOUT_SAMPLE = 64
#: An anchor with more than this share of the sampled anchors is frequent, so there are at most 100,000 of them.
FREQUENT = 1e-5
#: Rows of a frequent anchor's window are dealt to so many groups; the first of each group meet once more.
SALTS = 32
#: Bytes of a window's digest; with the hash of its anchor they tell windows apart by 120 bits.
DIGEST = 7
#: Rows of an unfinished group after which those that can hold no first place are given out.
FLUSH = 1 << 15

_POWERS: dict[int, np.ndarray] = {}
_STEPS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _mix(h: np.ndarray, turn: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, step: int) -> np.ndarray:
    """The first n powers of ``step``, kept for the next document."""
    kept = _POWERS.get(step)
    if kept is None or len(kept) < n:
        kept = _POWERS[step] = np.cumprod(np.full(max(1024, 2 * n), step, dtype=np.uint64))
    return kept[:n]


def _runs_of(h: np.ndarray, size: int, turn: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive word hashes, from differences of one running sum."""
    n = len(h)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(h, turn) * _powers(n, _STEPS[turn]), out=total[1:])
    return _mix((total[size:] - total[:-size]) * _powers(n, pow(_STEPS[turn], -1, 1 << 64))[:n - size + 1], turn + 2)


def _last_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the last of the least 40-bit values in every ``width`` neighbours; minima of doubling ranges find it."""
    place = np.uint64((1 << 24) - 1)
    out = np.empty(len(x) - width + 1, dtype=np.int64)
    for i in range(0, len(out), 1 << 20):
        part = x[i:i + (1 << 20) + width - 1]
        low = (part & ~place) | (place - np.arange(len(part), dtype=np.uint64))
        reach = 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[:reach - width], low[width - reach:])
        out[i:i + len(low)] = i + (place - (low & place)).astype(np.int64)
    return out


def anchors(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, first windows, digests of all windows) of a document.

    The anchor of a window is the rightmost of its word runs with the least hash,
    so equal windows have the same one at the same place. Windows that share an
    anchor follow each other; the second array has where each such row begins.
    """
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, dtype=np.uint64)
        return none, none.astype(np.int32), none
    h = hashes(words)
    grams = _runs_of(h, anchor, 0)
    at = _last_least(grams, window - anchor + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[first]], first.astype(np.int32), _runs_of(h, window, 1)


def _anchor_rows(batches, window: int, anchor: int, frequent: np.ndarray):
    """One row per anchor of a document with the digests of its windows; for frequent anchors one salted row per window."""
    for batch in batches:
        docs, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        parts: list[list] = [[], [], [], [], [], [], []]
        for doc, key, text in zip(docs, keys, batch.column(2).to_pylist()):
            seeds, first, digests = anchors(words_of(text), window, anchor)
            if not len(seeds):
                continue
            size = np.diff(np.r_[first, len(digests)]).astype(np.int32)
            often = np.zeros(len(seeds), dtype=bool)
            if len(frequent):
                often = frequent[np.minimum(np.searchsorted(frequent, seeds), len(frequent) - 1)] == seeds
            of_often = np.repeat(often, size)
            salt = int(_mix(np.array([doc], dtype=np.int64).view(np.uint64), 5)[0] % SALTS) + 1
            one = np.flatnonzero(of_often).astype(np.int32)
            groups = [(seeds[~often], np.zeros((~often).sum(), dtype=np.int32), first[~often], size[~often], digests[~of_often])]
            if len(one):
                groups.append((_mix(np.repeat(seeds, size)[of_often] ^ digests[of_often], 6), np.full(len(one), salt, dtype=np.int32), one,
                               np.ones(len(one), dtype=np.int32), digests[of_often]))
            for columns in groups:
                n = len(columns[0])
                for part, column in zip(parts, (np.full(n, doc), np.full(n, key), *columns)):
                    part.append(column)
        if not parts[0]:
            continue
        doc, key, seed, salt, first, size, digest = (np.concatenate(p) for p in parts)
        ends = pa.py_buffer(np.r_[0, np.cumsum(size) * DIGEST].astype(np.int32))
        packed = np.ascontiguousarray(digest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seed.view(np.int64)), pa.array(salt), pa.array(doc), pa.array(key), pa.array(first),
             pa.Array.from_buffers(pa.binary(), len(size), [None, ends, pa.py_buffer(packed)])],
            names=["anchor", "salt", "doc", "text_key", "first", "digests"])


def later_windows(group: np.ndarray, doc: np.ndarray, start: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which windows, given in order of (group, doc, start), have an equal one of their group that starts earlier."""
    order = np.lexsort((digest, group))
    g, d = group[order], digest[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    return later


def _mark_rows(batches):
    """Rows arrive sorted by (anchor, salt, doc, first) and leave with a bit for each window seen before, if there is one.

    A salted group also gives out its first row, with the anchor in ``head``: the
    firsts of the other salts are still to be compared with it. Of a long group
    only rows that hold the first place of a window are kept in memory.
    """
    rest: list = []
    limit = FLUSH

    def marks(part: pa.Table, done: bool):
        seed, salt, doc, key, first = (part.column(i).to_numpy() for i in range(5))
        blob = part.column(5).combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        ends = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset:blob.offset + len(blob) + 1]
        size = np.diff(ends) // DIGEST
        wide = np.zeros((int(size.sum()), 8), dtype=np.uint8)
        wide[:, :DIGEST] = np.frombuffer(blob.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].reshape(-1, DIGEST)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        group = np.cumsum(np.r_[True, (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])])[row]
        later = later_windows(group, doc[row], first[row] + place, wide.view("<u8").ravel())
        bits = np.bincount(row, weights=later * 2.0 ** place, minlength=len(size)).astype(np.int64)
        full = np.bincount(row, weights=later, minlength=len(size)) == size
        out = bits > 0 if done else full
        head = (salt > 0) & (bits == 0) & done
        chosen = np.flatnonzero(out | head)
        return full, pa.RecordBatch.from_arrays(
            [pa.array(doc[chosen]), pa.array(key[chosen]), pa.array(first[chosen]), pa.array(bits[chosen]),
             pa.array(seed[chosen], mask=~head[chosen])], names=["doc", "text_key", "first", "bits", "head"])

    for batch in batches:
        if not batch.num_rows:
            continue
        seed, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        other = (seed != seed[-1]) | (salt != salt[-1])
        cut = len(seed) - int(np.argmax(other[::-1])) if other.any() else 0
        if rest and not cut and (rest[-1].column(0)[-1].as_py(), rest[-1].column(1)[-1].as_py()) != (int(seed[0]), int(salt[0])):
            yield marks(pa.Table.from_batches(rest), True)[1]
            rest = []
        if cut:
            yield marks(pa.Table.from_batches([*rest, batch.slice(0, cut)]), True)[1]
            rest = []
        rest.append(batch.slice(cut))
        if sum(r.num_rows for r in rest) > limit:
            whole = pa.Table.from_batches(rest)
            full, found = marks(whole, False)
            yield found
            kept = whole.filter(pa.array(~full)).combine_chunks()
            rest, limit = kept.to_batches(), max(FLUSH, 2 * kept.num_rows)
    if rest:
        yield marks(pa.Table.from_batches(rest), True)[1]


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(_narrow_id().alias("doc"),
                       _text_key().alias("text_key"), "text")


def marked_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, text_key, first, bits): bit i is set if the window from word first + i also starts earlier.

    Earlier is a smaller doc_id (null last), or the same one and an earlier word.
    One row per anchor carries the digests of its windows to where all rows with
    that anchor meet, so equal windows are found there however far a match
    extends. The windows of frequent anchors go one by one, each to one of SALTS
    groups; what is first in its group then meets the firsts of the others.
    """
    bound_batches(docs.sparkSession)

    def rows(of: DataFrame, frequent: np.ndarray) -> DataFrame:
        return of.mapInArrow(lambda it: _anchor_rows(it, window, anchor, frequent),
                             "anchor long, salt int, doc long, text_key int, first int, digests binary")

    narrow = _narrow(docs)
    sample = narrow.where(F.pmod(F.xxhash64("doc", "text_key"), F.lit(LAYOUT_SAMPLE)) == 0)
    counts = stored(rows(sample, np.zeros(0, dtype=np.uint64)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchors")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.where(F.col("n") > F.lit(max(8.0, FREQUENT * total))).select("anchor").toPandas()
    frequent = np.sort(found["anchor"].to_numpy(dtype=np.int64).view(np.uint64))
    marks = stored(rows(narrow, frequent).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "first")
                   .mapInArrow(_mark_rows, "doc long, text_key int, first int, bits long, head long"), "marks")
    heads = marks.where("head is not null")
    least = heads.groupBy("head").agg(F.min(F.struct("doc", "first")).alias("least"))
    late = heads.join(least, "head").where((F.col("doc") != F.col("least.doc")) | (F.col("first") != F.col("least.first")))
    return marks.where("bits > 0").select("doc", "text_key", "first", "bits").union(late.select("doc", "text_key", "first", F.lit(1).cast("long")))


def covered(n_words: int, marks: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words lie in a marked window."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    for first, bits in marks:
        while bits:
            low = (bits & -bits).bit_length() - 1
            step[first + low] += 1
            step[first + low + window] -= 1
            bits &= bits - 1
    return np.cumsum(step[:-1]) > 0


def _cut_batches(batches, window: int):
    for batch in batches:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "repeats": []}
        for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = words_of(text)
            gone = covered(len(words), [(m["first"], m["bits"]) for m in marks or []], window)
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = words if not len(edge) else [w for w, g in zip(words, gone.tolist()) if not g]
            for name, value in zip(out, (doc, len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"),
                                          [{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2])])):
                out[name].append(value)
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), span))],
                                         names=list(out))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) for every row of ``docs``.

    ``repeats`` are the maximal runs of words (end exclusive) covered by windows
    that start earlier elsewhere, ``kept`` the other words joined by one space.
    Null and empty texts have no word. Rows equal in id and text get equal
    results and do not count as earlier than each other; a null id comes after
    all others. An empty table gives an empty table.
    """
    of_doc = marked_windows(docs, window, anchor).groupBy("doc", "text_key").agg(F.collect_list(F.struct("first", "bits")).alias("marks"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        of_doc, (_narrow_id() == F.col("doc")) & (_text_key() == F.col("text_key")), "left")
    return texts.select("doc_id", "text", "marks").mapInArrow(
        lambda it: _cut_batches(it, window),
        "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<from: int, to: int>>")


def _narrow_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _text_key() -> Column:
    """Tells different texts under one id apart."""
    return F.hash(F.coalesce("text", F.lit("")))
