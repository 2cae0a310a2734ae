import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import bestfit as B


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, B.END_ID] for e in t.encode_batch(texts, add_special_tokens=False)]


def packed_counts(counts, length):
    """Sequences as lists of (offset, piece length), by placing every single piece."""
    blocks = B.plan(counts, length)
    out: dict = {}
    for n, k in counts.items():
        at = B.place(blocks, np.full(k, n), np.arange(k))
        for s, o in zip(at["sequence_id"], at["offset"]):
            out.setdefault(s, []).append((o, n))
    return out


def check(sequences, counts, length):
    assert Counter(n for parts in sequences.values() for _, n in parts) == Counter(counts)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length


def slow_fill(counts, gap, cap):
    """The longest single, else any pair, else any triple of lengths up to cap that adds up to the gap, by trying all."""
    have = [n for n in range(1, cap + 1) if counts[n]]
    for k in (1, 2, 3):
        for combo in ([(x,) for x in have] if k == 1 else [(x, y) for x in have for y in have] if k == 2 else [(x, y, z) for x in have for y in have for z in have]):
            if sum(combo) == gap and all(counts[n] >= c for n, c in Counter(combo).items()):
                return k
    return 0


def test_index_finds_a_filling_whenever_there_is_one():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = np.zeros(25, dtype=np.int64)
        for n in rng.integers(1, 24, 6):
            counts[n] += rng.integers(1, 4)
        sums = B.Sums(counts)
        for cap in range(23, 0, -1):
            for gap in range(1, 24):
                found = [bool(f(gap, cap)) for f in (sums.single, sums.pair, sums.triple)]
                want = slow_fill(counts, gap, cap)
                assert (found.index(True) + 1 if any(found) else 0) == want, (counts, gap, cap)
                for f in (sums.single, sums.pair, sums.triple):
                    if combo := f(gap, cap):
                        assert sum(combo) == gap and max(combo) <= cap
                        assert all(counts[n] >= c for n, c in Counter(combo).items())


def test_exact_patterns_are_full_and_leave_no_filling():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = np.bincount(rng.integers(1, 40, 60), minlength=41)
        left = counts.copy()
        patterns = B.exact_patterns(left, 40)
        assert all(sum(n * k for n, k in p.parts) == 40 and p.room == 0 and p.count > 0 for p in patterns)
        used = np.zeros(41, dtype=np.int64)
        for p in patterns:
            for n, k in p.parts:
                used[n] += k * p.count
        assert (used + left == counts).all()
        for a in range(39, 0, -1):  # no combination of up to four pieces that are left fills a sequence
            if left[a]:
                left[a] -= 1
                assert not slow_fill(left, 40 - a, a)
                left[a] += 1


def slow_best_fit(counts, length):
    rooms = []
    for n in range(length, 0, -1):
        for _ in range(counts[n]):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(length - n)
    return sorted(rooms)


def test_best_fit_in_groups_equals_piece_by_piece():
    rng = np.random.default_rng(5)
    for _ in range(50):
        counts = np.bincount(rng.integers(1, rng.integers(3, 50), rng.integers(1, 200)), minlength=51)
        patterns = B.best_fit(counts, 50)
        assert sorted(r for p in patterns for r in [p.room] * p.count) == slow_best_fit(counts, 50)


@pytest.mark.parametrize("counts", [{}, {1: 1}, {1024: 3}, {512: 5}, {1: 5000}, {700: 10, 324: 3, 100: 9, 24: 9, 200: 2, 124: 1},
                                    {n: 1 for n in range(1, 1025)}, {341: 7, 342: 2, 1: 3}])
def test_plans_place_every_piece_once(counts):
    check(packed_counts(counts, 1024), counts, 1024)


def test_few_sequences():
    rng = np.random.default_rng(6)
    counts = dict(Counter(rng.integers(1, 1025, 20000).tolist()))
    sequences = packed_counts(counts, 1024)
    check(sequences, counts, 1024)
    assert len(sequences) <= -(-sum(n * k for n, k in counts.items()) // 1024) * 1.01


TEXTS = ["", "Hello  world\n\n\tand <|endoftext|> more", "naïve çà ü ñ 漢字 🙂 é", "a" * 3000, " " * 500 + "x", "word " * 5000, "<|endoftext|>" * 3, "word " * 1023, "word " * 1022]


def test_documents_are_cut_from_their_end_and_keep_every_id(spark):
    docs = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(50, None, "x", 1), (None, "no id", "x", 1), (3, TEXTS[3], "x", 1)] * 2
    packed = B.pack(spark.createDataFrame(docs, "doc_id long, text string, part string, number int").repartition(4))
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    want = Counter()
    for d, ids in zip(docs, library_ids([d[1] or "" for d in docs])):
        for i, (at, n) in enumerate(B.cuts(len(ids), 1024)):
            assert n == 1024 or i == 0
            want[(d[0], i, at, n, np.array(ids[at:at + n], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    check(by, Counter(r["length"] for r in rows), 1024)
    crc = B.pack(spark.createDataFrame(docs[:3], "doc_id long, text string, part string, number int"), F.crc32("ids").alias("c"))
    assert {r["c"] for r in crc.collect()} == {zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in library_ids(TEXTS[:3])}


def test_empty_table(spark):
    assert B.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
