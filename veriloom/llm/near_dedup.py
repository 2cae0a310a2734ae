"""SimHash near-duplicates found with a Gray-order hierarchical index."""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, hashes, map_rows, members, stored
from veriloom.llm.components import connected_components

#: Distinct fingerprints one task may hold of a block; blocks with more are cut by a further block.
BLOCK_ROWS = 1 << 18
FANOUT = 8
#: Node pairs compared at a time.
PAIRS = 1 << 21
LEVELS = 4
#: Shingles one task may hold when candidates are compared; a document counts as UNIT_ROW shingles more.
UNIT, UNIT_ROW = 1 << 21, 256
#: Words of the wide fingerprint, and bands of min-hashes that bring wide fingerprints together.
WIDE_WORDS, BANDS, BAND_ROWS = 4, 20, 5
#: Parts a band of more than its share of rows is dealt to, if it needs no more to fit a task; rows are copied as often.
SPREAD = 16
#: Bands in which the nodes of a large component meet, round by round; a round passes on only what earlier ones left apart.
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, BANDS)))
_TURNS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 (seed 42); no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = hashes(grams, 42)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batch(cols: dict, shingle: int) -> dict:
    fp = np.array([fingerprint(t, shingle) for t in cols["text"]], dtype=np.uint64)
    return {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "fp": fp.view(np.int64)}


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) per row of ``docs``; text_key is a digest of the text, the same for null and empty."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return map_rows(narrow, _fingerprint_batch, "doc_id long, text_key long, fp long", shingle)


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in Gray order, moved so that it sorts as a signed number."""
    for n in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, n))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Four copies of each row, each turned so that another quarter of the free bits joins the shared top bits.

    Codes within a radius of 3 agree in one quarter at least, so they meet in one copy.
    """
    copies = F.explode(F.array(*(F.lit(i) for i in range(4))))
    out = (rows.withColumn("part", copies)
           .withColumn("free", F.expr("64 - used"))
           .withColumn("from", F.expr("cast(part * free div 4 as int)"))
           .withColumn("size", F.expr("cast((part + 1) * free div 4 as int) - from"))
           .withColumn("low", F.expr("case when used = 0 then -1L else shiftrightunsigned(-1L, used) end")))
    turned = F.expr("((turn & ~low) | ((shiftleft(turn & low, from) | "
                    "case when from = 0 then 0L else shiftrightunsigned(turn & low, free - from) end) & low))")
    return (out.withColumn("turn", turned).withColumn("used", F.expr("used + size"))
            .withColumn("path", F.expr(f"path + cast((part + 1) * {5 ** level} as int)"))
            .withColumn("key", F.expr("xxhash64(path, shiftrightunsigned(turn, 64 - used))"))
            .select("fp", "turn", "used", "path", "key"))


def _expand(a, b, start, stop, same_level_zero: bool):
    """All child pairs of the node pairs (a, b); of a node with itself each pair once."""
    na, nb = stop[a] - start[a], stop[b] - start[b]
    n = na * nb
    of = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x, y = start[a][of] + k // nb[of], start[b][of] + k % nb[of]
    keep = (a[of] != b[of]) | (x < y if same_level_zero else x <= y)
    return x[keep], y[keep]


def _union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives linked items the smallest label of either, in place."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def link_blocks(key: np.ndarray, code: np.ndarray, radius: int) -> np.ndarray:
    """For items sorted by (key, Gray rank): the first item linked to each by codes of the same key within ``radius``.

    ``code`` has a row of 64-bit words per item. Items are the leaves of a forest
    with one tree per key. A node keeps the bits that all its items share (mask
    and pattern). A pair of nodes is dropped when their shared bits differ in more
    than ``radius`` places and accepted as a whole when even their other bits
    cannot raise the difference above it.
    """
    n, words = code.shape
    label = np.arange(n)
    if n < 2:
        return label
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    group = np.repeat(np.arange(len(first)), size)
    # levels[l]: start and stop among the nodes below, first and last item, AND and OR of the codes
    levels = [(None, None, np.arange(n), np.arange(1, n + 1), code, code)]
    lo, hi = code, code
    while len(lo) > len(first):
        count = np.bincount(group, minlength=len(first))
        place = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
        start = np.flatnonzero(place % FANOUT == 0)
        stop = np.r_[start[1:], len(group)]
        lo, hi = np.bitwise_and.reduceat(lo, start), np.bitwise_or.reduceat(hi, start)
        group = group[start]
        levels.append((start, stop, levels[-1][2][start], levels[-1][3][stop - 1], lo, hi))
    roots = np.flatnonzero(size > 1)
    stack = [(len(levels) - 1, roots, roots)]
    step = max(1, PAIRS // (FANOUT * FANOUT * words))
    while stack:
        level, a, b = stack.pop()
        if not len(a):
            continue
        if level == 0:
            _union(label, a, b)
            continue
        if len(a) > step:
            stack += [(level, a[i:i + step], b[i:i + step]) for i in range(0, len(a), step)]
            continue
        start, stop = levels[level][:2]
        a, b = _expand(a, b, start, stop, level == 1)
        _, _, begin, end, lo, hi = levels[level - 1]
        shared = ~((lo[a] ^ hi[a]) | (lo[b] ^ hi[b]))
        apart = np.bitwise_count((lo[a] ^ lo[b]) & shared).sum(1, dtype=np.int64)
        near = apart <= radius
        a, b, apart = a[near], b[near], apart[near]
        if level > 1:
            free = 64 * words - np.bitwise_count(shared[near]).sum(1, dtype=np.int64)
            done = np.zeros(len(a), dtype=bool)
            if 4 * len(a) > len(begin):  # enough pairs to pay for finding the nodes that are linked throughout
                least, most = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
                done = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])
            whole = ~done & (apart + free <= radius)
            for p, q in zip(a[whole], b[whole]):
                _union(label, np.arange(begin[p], end[p]), np.full(end[p] - begin[p], begin[q]))
                _union(label, np.arange(begin[q], end[q]), np.full(end[q] - begin[q], begin[p]))
            a, b = a[~(whole | done)], b[~(whole | done)]
        stack.append((level - 1, a, b))
    return label


def _link_partition(batches, radius: int):
    """Edges from each item to the first item of its links; a key's rows are complete before they are compared.

    The columns are the key, the node and the words of its code.
    """
    rest = None

    def edges(part):
        label = link_blocks(part[0], np.stack(part[2:], 1).view(np.uint64), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(part[1][moved]), pa.array(part[1][label[moved]])], names=["u", "v"])

    for batch in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(part[0]):
            continue
        part = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
        other = part[0] != part[0][-1]
        cut = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
        if cut >= 1 << 15:
            yield edges([x[:cut] for x in part])
            rest = [x[cut:] for x in part]
        else:
            rest = part
    if rest is not None:
        yield edges(rest)


def links(codes: DataFrame, radius: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) that connect exactly the codes in column fp linked by chains of differences of ``radius`` or fewer.

    ``radius`` is below 4. Each code goes to its four 16-bit blocks. A block that
    holds more than ``block_rows`` codes is cut again by a quarter of its other
    bits, up to LEVELS times: nothing is dropped, and at most 2^20 codes share
    what is then fixed. Within a block the codes are sorted by Gray rank.
    """
    if not 0 <= radius < 4:
        raise ValueError("radius must be below 4")
    state = codes.select("fp", F.col("fp").alias("turn"), F.lit(0).alias("used"), F.lit(0).alias("path"))
    ready = []
    for level in range(LEVELS):
        routed = _split(state, level)
        sizes = routed.groupBy("key").count().where(F.col("count") > block_rows).select("key")
        hot = None if level == LEVELS - 1 or sizes.isEmpty() else F.broadcast(stored(sizes, "blocks"))
        ready.append(routed if hot is None else routed.join(hot, "key", "left_anti").select(*routed.columns))
        if hot is None:
            break
        state = stored(routed.join(hot, "key", "left_semi").drop("key"), "blocks")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.union(more)
    sorted_ = rows.select("key", "fp", "turn").repartition("key").sortWithinPartitions("key", gray_rank(F.col("turn")), "fp")
    return sorted_.mapInArrow(lambda it: _link_partition(it, radius), "u long, v long")


def _name_components(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every code; ``least`` is the smallest doc_id with that code, the root the smallest code linked to it."""
    roots = connected_components(edges)
    named = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(named.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_key, fp, component_id) per row of ``docs``.

    Rows whose fingerprints are linked by chains of at most ``radius`` differing
    bits are one component, named by its smallest doc_id. Null and empty texts
    have fingerprint 0 and are linked like any other. Repeated rows are all
    returned. A null doc_id keeps its row and never names a component that has
    another id. An empty table gives an empty table; further columns are ignored.
    Rows of one fingerprint are aggregated before any link is looked for.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    return rows.join(_name_components(codes, links(codes, radius)), "fp").drop("root")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted digests of the distinct shingles of a text; a text of fewer words is one shingle."""
    tokens = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if len(tokens) < shingle:
        return hashes([b" ".join(tokens)])
    return np.unique(hashes(map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))))


def wide_fingerprint(h: np.ndarray, words: int = WIDE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A SimHash of ``words`` 64-bit words over a set of shingles, and the keys of the bands of their min-hashes."""
    ones = np.zeros((words, 64), dtype=np.int64)
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 1 << 12):
        part = h[i:i + (1 << 12)]
        for w in range(words):
            mixed = (part ^ _TURNS[w]) * _TURNS[w + words]
            mixed ^= mixed >> np.uint64(29)
            ones[w] += np.unpackbits((mixed * _TURNS[w]).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        folded = part ^ (part >> np.uint64(32))
        least = np.minimum(least, (folded[:, None] * _TURNS[None, :]).min(0))
    code = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")
    bands = [xxhash.xxh64_intdigest(least[b * BAND_ROWS:(b + 1) * BAND_ROWS].tobytes(), b) for b in range(BANDS)]
    return code, np.array(bands, dtype=np.uint64)


def _set_key(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def _wide_batch(cols: dict, shingle: int) -> dict:
    out = {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "fp": [], "grams": [], "bands": [], **{f"f{w}": [] for w in range(WIDE_WORDS)}}
    for text in cols["text"]:
        h = shingle_set(text, shingle)
        code, bands = wide_fingerprint(h)
        out["fp"].append(_set_key(h))
        out["grams"].append(len(h))
        out["bands"].append(bands.view(np.int64).tolist())
        for w, value in enumerate(code.view(np.int64).tolist()):
            out[f"f{w}"].append(value)
    return out


def bit_differs(both: int, a: int, b: int) -> float:
    """Probability that a SimHash bit differs for two sets with ``both`` shingles in common and a and b of their own."""
    x, y, z = np.ogrid[:both + 1, :a + 1, :b + 1]
    of = [np.array([comb(n, k) / 2 ** n for k in range(n + 1)]) for n in (both, a, b)]
    return float((np.einsum("i,j,k->ijk", *of) * ((2 * (x + y) > both + a) != (2 * (x + z) > both + b))).sum())


@cache
def radius_for(similarity: float, bits: int) -> int:
    """Differing bits of two shingle sets of at least this Jaccard similarity: the most likely number plus 4 standard deviations.

    Of large sets a bit differs as the angle between them says, of small ones more often: 3 in 16 for sets of 4 and 5 shingles.
    """
    small = (bit_differs(n, a, own - a) for n in range(1, 33) for own in range(1, n + 1) if n / (n + own) >= similarity for a in range(own + 1))
    p = max([float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), *small])
    return int(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def link_sets(code: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int, label: np.ndarray | None = None) -> np.ndarray:
    """The first item linked to each by chains of sets of at least this Jaccard similarity, with codes within ``radius``.

    Sets are compared in the order of their codes' differences, and only as long
    as they are not linked yet; ``label`` tells what is linked beforehand.
    """
    label = np.arange(len(sets)) if label is None else label.copy()
    size = np.array([len(s) for s in sets])
    for i in range(1, len(sets)):
        apart = np.bitwise_count(code[:i] ^ code[i]).sum(1, dtype=np.int64)
        able = np.flatnonzero((apart <= radius) & (label[:i] != label[i]) & (np.minimum(size[:i], size[i]) / np.maximum(size[:i], size[i]) >= similarity))
        for j in able[np.argsort(apart[able], kind="stable")]:
            if label[i] == label[j]:
                continue
            few, many = (sets[i], sets[j]) if size[i] < size[j] else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            both = int((many[at] == few).sum())
            if both / (size[i] + size[j] - both) >= similarity:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def _confirm_partition(batches, similarity: float, radius: int, shingle: int):
    """Edges of ``link_sets`` for each unit; the columns are the unit, the node, what it is linked to so far, its text and the words of its code."""
    unit, rows = None, {}

    def edges():
        nodes = list(rows)
        first = {group: i for i, (group, *_) in reversed(list(enumerate(rows.values())))}
        before = np.array([first[group] for group, *_ in rows.values()])
        if len(first) < 2:
            return []
        code = np.array([r[2:] for r in rows.values()], dtype=np.int64).view(np.uint64)
        label = link_sets(code, [shingle_set(r[1], shingle) for r in rows.values()], similarity, radius, before)
        return [(nodes[i], nodes[label[i]]) for i in np.flatnonzero(label != before)]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != unit:
                found += edges() if len(rows) > 1 else []
                unit, rows = row[0], {}
            rows[row[1]] = row[2:]
        yield batch_of(found)
    if len(rows) > 1:
        yield batch_of(edges())


def _dealt(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``items`` whose key is in ``sizes`` (key, parts); a key of several parts becomes one key for each pair of its parts."""
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return (items.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("key", F.when(F.col("parts") == 1, F.col("key"))
                        .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))).drop("own", "other", "parts"))


def _confirmed(docs: DataFrame, codes: DataFrame, candidates: DataFrame, shingle: int, similarity: float, unit: int) -> DataFrame:
    """Edges (u, v) that connect what chains of candidates with this similarity of their shingle sets connect.

    A component of candidates that is no larger than ``unit`` is compared in one
    task. The nodes of a larger one meet again in their bands, a few bands at a
    time; a band whose nodes are all linked by then is left out, and one that is
    larger is dealt to pairs of its parts. One text of each node with candidates
    is read and moved, no other.
    """
    names = [f"f{w}" for w in range(WIDE_WORDS)]
    roots = connected_components(candidates).withColumnRenamed("node", "fp")
    nodes = stored(codes.drop("bands", "least").join(roots, "fp").withColumn("weight", F.col("grams") + UNIT_ROW).select("fp", "row_key", "root", "weight", *names), "candidates")
    wanted = members(nodes, "row_key", nodes.count())
    texts = docs.where(wanted("row_key")).groupBy("row_key").agg(F.first("text").alias("text"))  # rows that are repeated in id and text count once
    radius = radius_for(similarity, 64 * WIDE_WORDS)

    def compared(units: DataFrame) -> DataFrame:
        return (units.join(texts, "row_key").select("unit", "fp", "group", "text", *names).repartition("unit").sortWithinPartitions("unit", "fp")
                .mapInArrow(lambda it: _confirm_partition(it, similarity, radius, shingle), "u long, v long"))

    large = stored(nodes.groupBy("root").agg(F.sum("weight").alias("all")).where(F.col("all") > unit).select("root"), "large")
    if large.isEmpty():
        return compared(nodes.select(F.col("root").alias("unit"), "fp", "row_key", F.col("fp").alias("group"), *names))
    edges = stored(compared(nodes.join(large, "root", "left_anti").select(F.col("root").alias("unit"), "fp", "row_key", F.col("fp").alias("group"), *names)), "links")
    spread = stored(nodes.join(large, "root", "left_semi").join(codes.select("fp", "bands"), "fp"), "large_nodes")
    for bands in ROUNDS:
        linked = connected_components(edges).select(F.col("node").alias("fp"), F.col("root").alias("group"))
        at = F.explode(F.array(*(F.element_at("bands", b + 1) for b in bands)))
        banded = spread.join(linked, "fp", "left").select("fp", "row_key", "weight", F.coalesce("group", "fp").alias("group"), at.alias("key"), *names)
        sizes = (banded.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.ceil(F.sum("weight") / unit).cast("int").alias("parts"))
                 .where("least <> most").select("key", "parts"))
        found = compared(_dealt(banded, sizes).withColumnRenamed("key", "unit"))
        edges = stored(edges.union(found), "links")
    return edges


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block_rows: int = BLOCK_ROWS, unit: int = UNIT) -> DataFrame:
    """(doc_id, text_key, root, component_id) per row of ``docs``, for documents linked by chains of similar shingle sets.

    The root tells components apart, also those that have the same smallest doc_id.

    A pair is linked if the Jaccard similarity of its distinct shingles is at
    least ``similarity``; this is counted, not estimated. SimHashes of 256 bits
    only find the candidates, within a radius of four standard deviations (three
    bits of 64 are less than most pairs of similarity 0.8 differ by), and the
    blocks that bring them together are bands of min-hashes (BANDS of BAND_ROWS;
    at 0.8 a pair has one in common with probability 0.9996). Within a block the
    Gray-order index does the rest as in ``links``. Bands are counted as bare
    numbers; only nodes that share one bring their SimHash to it. A block with more than
    ``block_rows`` codes is dealt to pairs of its parts, a smaller one that is
    above a task's mean to at most SPREAD parts. Nulls, empty texts,
    repeated rows and empty tables are treated as in ``near_duplicates``. Equal
    shingle sets are one node before any is compared.
    """
    bound_batches(docs.sparkSession)
    names = [f"f{w}" for w in range(WIDE_WORDS)]
    narrow = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = stored(map_rows(narrow, _wide_batch, "doc_id long, text_key long, fp long, grams long, bands array<long>, "
                           + ", ".join(f"{n} long" for n in names), shingle), "fingerprints")
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("one"),
                                          *(F.min(n).alias(n) for n in ("grams", *names)), F.min("bands").alias("bands"))
                   .withColumn("row_key", _row_key("one.doc_id", "one.text_key")).drop("one"), "codes")
    items = codes.select("fp", F.explode("bands").alias("key"))
    counts = stored(items.groupBy("key").count().where("count > 1"), "bands")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mean = max(64, (counts.agg(F.sum("count")).first()[0] or 0) // tasks)
    parts = F.greatest(F.ceil(F.col("count") / block_rows), F.least(F.lit(SPREAD), F.ceil(F.col("count") / mean))).cast("int")
    radius = radius_for(similarity, 64 * WIDE_WORDS)
    met = _dealt(items, counts.select("key", parts.alias("parts"))).join(codes.select("fp", *names), "fp")
    candidates = (met.select("key", "fp", *names).repartition("key").sortWithinPartitions("key", gray_rank(F.col(names[0])), *names)
                  .mapInArrow(lambda it: _link_partition(it, radius), "u long, v long"))
    keyed = narrow.select("text", _row_key("doc_id", "text_key").alias("row_key"))
    edges = _confirmed(keyed, codes, candidates, shingle, similarity, unit)
    return rows.select("doc_id", "text_key", "fp").join(_name_components(codes.select("fp", "least"), edges), "fp")


def _row_key(doc_id: str, text_key: str) -> Column:
    """One number for an id, which may be null, and a text."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text_key))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: a row of the smallest doc_id (null last).

    Of several texts of the component under that id the one with the smallest
    digest stays, of repeated rows any one, since they are equal in id and text.
    Components are told apart by their root, so texts that are not similar do
    not replace each other under one id or without an id.
    """
    found = stored(similar_documents(docs, shingle, similarity).select("root", "component_id", "fp", "doc_id", "text_key"), "similar")
    here = F.struct("text_key", "fp")
    classes = found.groupBy("root").agg(
        F.first("component_id").alias("_id"), F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), here))["text_key"].alias("_key"))
    classes = stored(classes.withColumn("row_key", _row_key("_id", "_key")), "kept")
    # a row of its own component that is there once stays where it is; all others meet the rows that are kept
    counted = found.groupBy("doc_id", "text_key").count().withColumn("row_key", _row_key("doc_id", "text_key"))
    open_ = stored(counted.join(classes.select("row_key", F.lit(True).alias("kept")), "row_key", "left").where("kept is null or count > 1").select("row_key"), "open")
    maybe = members(open_, "row_key", open_.count())
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    keyed = keyed.withColumn("maybe", maybe(_row_key("id", "key")))
    once = W.partitionBy("_id", "_key").orderBy("_key")
    joined = (keyed.where("maybe").withColumn("row_key", _row_key("id", "key")).join(classes, "row_key")
              .where(F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))))
    decided = joined.withColumn("n", F.row_number().over(once)).where("n = 1")
    return keyed.where("not maybe").select("row.*").unionByName(decided.select("row.*"))
