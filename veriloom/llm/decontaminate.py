"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact shingle similarity."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, hashes, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Two sets of shingles this similar have fingerprints 9.7 bits apart on average (sd 2.9); the radius adds 3.6 sd.
RADIUS = 20
BLOCKS = 7
#: Size of the filter of item shingles, whatever the number of items: 2^24 bits are 2 MB.
FILTER_BITS = 24


def normal_words(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return (text or "").lower().split()


def shingles(words: list, k: int) -> list[bytes]:
    """All runs of k words; a shorter sequence is one shingle."""
    if len(words) < k:
        return [" ".join(words).encode("utf-8", "surrogatepass")] if words else []
    return [s.encode("utf-8", "surrogatepass") for s in map(" ".join, zip(*(words[i:] for i in range(k))))]


def weighted_similarity(a: list, b: list) -> float:
    """Weighted Jaccard similarity; a shingle weighs as often as it occurs. Two empty lists have 0."""
    p, q = Counter(a), Counter(b)
    both = sum((p & q).values())
    return both / (len(a) + len(b) - both) if both else 0.0


def simhash(h: np.ndarray) -> int:
    ones = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    return [(64 * i // blocks, 64 * (i + 1) // blocks - 64 * i // blocks) for i in range(blocks)]


def block_values(fp: int, blocks: int = BLOCKS) -> list[int]:
    return [(fp >> at) & ((1 << size) - 1) for at, size in block_bounds(blocks)]


def probes(fp: int, radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(block, value) within radius // blocks bits of a block of ``fp``.

    Of fingerprints at most ``radius`` bits apart, one block is at most that far
    apart, so every one of them has a block among these.
    """
    out = []
    for i, ((_, size), value) in enumerate(zip(block_bounds(blocks), block_values(fp, blocks))):
        for n in range(radius // blocks + 1):
            out += [(i, value ^ sum(1 << b for b in flips)) for flips in combinations(range(size), n)]
    return out


def _of_size(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of shingles together with the number of words of the item they come from."""
    h = (h ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _item_rows(batches, k: int, radius: int, blocks: int):
    """Per item: words, shingle hashes, fingerprint and probes."""
    for batch in batches:
        rows = {"item_id": [], "item_words": [], "n_words": [], "item_fp": [], "grams": [], "sized": [], "probes": []}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = normal_words(text)
            if not words:
                continue
            h = hashes(shingles(words, k))
            fp = simhash(h)
            for name, value in zip(rows, (item, " ".join(words), len(words), fp - (fp >> 63 << 64), h.view(np.int64).tolist(),
                                          _of_size(h, len(words)).view(np.int64).tolist(), [i << 32 | v for i, v in probes(fp, radius, blocks)])):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["item_id"], pa.int64()), pa.array(rows["item_words"], pa.string()), pa.array(rows["n_words"], pa.int32()),
             pa.array(rows["item_fp"], pa.int64()), pa.array(rows["grams"], pa.list_(pa.int64())),
             pa.array(rows["sized"], pa.list_(pa.int64())), pa.array(rows["probes"], pa.list_(pa.int64()))],
            names=list(rows))


def _gram_filter(items: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit map of the hashes in ``column``, of a fixed size; it may say yes wrongly, never no."""
    slot = F.shiftrightunsigned(F.col("gram"), 64 - bits)
    packed = (items.select(F.explode(column).alias("gram")).select(slot.alias("slot")).distinct()
              .groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))
    seen = np.zeros(1 << (bits - 6), dtype=np.uint64)
    got = packed.toPandas()  # at most 2^(bits - 6) rows
    seen[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return seen


def _in_filter(seen: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = h >> np.uint64(64 - bits)
    return (seen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _windows(batches, seen, sized, bits: int, sizes: list[int], k: int, similarity: float, blocks: int):
    """Windows of an item's size that could reach the similarity, with their fingerprints.

    Two lists of m shingles are that similar only if they share 2ms / (1 + s) of
    them, so windows with fewer shingles known from items of their size are left
    out; no window that can be a match is.
    """
    widths = sorted({min(k, s) for s in sizes})
    for batch in batches:
        out = {"doc_id": [], "start": [], "n_words": [], "fp": [], "window": []}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = normal_words(text)
            for width in widths:
                if len(words) < width:
                    continue
                h = hashes(shingles(words, width))
                known = np.flatnonzero(_in_filter(seen, h, bits))
                for size in sizes if len(known) else ():
                    m = size - width + 1
                    need = int(np.ceil(2 * m * similarity / (1 + similarity) - 1e-9))
                    if min(k, size) != width or len(words) < size or len(known) < need:
                        continue
                    at = known[_in_filter(sized, _of_size(h[known], size), bits)]
                    if len(at) < need:
                        continue
                    low = np.maximum(0, at[need - 1:] - m + 1)
                    high = np.minimum(at[:len(at) - need + 1], len(words) - size)
                    for start in sorted({x for a, b in zip(low.tolist(), high.tolist()) for x in range(a, b + 1)}):
                        fp = simhash(h[start:start + m])
                        for name, value in zip(out, (doc, start, size, fp - (fp >> 63 << 64), " ".join(words[start:start + size]))):
                            out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["n_words"], pa.int32()),
             pa.array(out["fp"], pa.int64()), pa.array(out["window"], pa.string())], names=list(out))


def _verify(batches, k: int, similarity: float):
    for batch in batches:
        pairs = [weighted_similarity(shingles(a.split(" "), k), shingles(b.split(" "), k))
                 for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        hit = pa.array([p >= similarity for p in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, pa.float64())],
                                         names=["window_key", "item_id", "similarity"]).filter(hit)


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, radius: int = RADIUS,
          blocks: int = BLOCKS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document for each item found in it.

    A window has as many words as the item; it is a find if the weighted Jaccard
    similarity of the shingles reaches ``similarity``. Of equal windows the first
    counts. Documents without a find have no row. Null and empty texts and items
    without a word find nothing; an item shorter than a shingle is one shingle;
    repeated rows and null ids are searched as they are, equal rows giving one.

    Windows equal in their words are compared once, however many documents hold
    them. Fingerprints meet in a join on (words, block, value), whose item side
    carries all values within radius // blocks bits. Items are told apart by a
    digest of id and words; of several items under one id, or without an id, the
    best window of any is given.
    """
    bound_batches(docs.sparkSession)
    item_rows = stored(items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        lambda it: _item_rows(it, k, radius, blocks),
        "item_id long, item_words string, n_words int, item_fp long, grams array<long>, sized array<long>, probes array<long>")
        .withColumn("item_key", F.xxhash64("item_id", "item_words")), "items")
    sizes = sorted(r[0] for r in item_rows.select("n_words").distinct().collect())  # one number per length
    share = docs.sparkSession.sparkContext.broadcast
    seen, sized = (share(_gram_filter(item_rows, column, filter_bits)) for column in ("grams", "sized"))
    windows = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _windows(it, seen.value, sized.value, filter_bits, sizes, k, similarity, blocks),
        "doc_id long, start int, n_words int, fp long, window string").withColumn("window_key", F.xxhash64("window", F.lit(1))), "windows")
    value = F.array(*(F.expr(f"shiftleft({i}L, 32) | (shiftrightunsigned(fp, {at}) & {(1 << size) - 1}L)")
                      for i, (at, size) in enumerate(block_bounds(blocks))))
    distinct = windows.groupBy("window_key", "n_words", "fp", "window").agg(F.count(F.lit(1)).alias("n"))
    left = distinct.select("window_key", "n_words", "fp", F.explode(value).alias("block"))
    right = item_rows.select("item_key", "item_fp", "n_words", F.explode("probes").alias("block"))
    near = (left.join(right, ["n_words", "block"]).where(F.bit_count(F.expr("fp ^ item_fp")) <= radius)
            .select("window_key", "item_key").distinct())
    pairs = (near.join(distinct.select("window_key", "window"), "window_key")
             .join(item_rows.select("item_key", "item_id", "item_words").distinct(), "item_key")
             .select("window_key", "item_id", "window", "item_words"))
    hits = pairs.mapInArrow(lambda it: _verify(it, k, similarity), "window_key long, item_id long, similarity double")
    best = F.min(F.struct((-F.col("similarity")).alias("worst"), "start", "n_words")).alias("best")
    return (windows.select("doc_id", "start", "n_words", "window_key").join(hits.distinct(), "window_key").groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", (-F.col("best.worst")).alias("similarity"), F.col("best.start").alias("start"),
                    F.col("best.n_words").alias("n_words")))


def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item; rows with a null id are kept only if their text is clean.

    Rows are told apart by id and text, so another text under a leaking id stays.
    """
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    found = stored(leaks(keyed, items, **options).select("doc_id").distinct(), "leaks")
    name = next(c for c in (f"_key{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    key = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    return docs.withColumn(name, key).join(found.withColumnRenamed("doc_id", name), name, "left_anti").select(*docs.columns)
