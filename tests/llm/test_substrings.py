import hashlib
import re

import numpy as np
import pytest

from veriloom.llm import substrings as S


def slow(docs, window):
    first, words = {}, []
    order = sorted((r for r in docs), key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        key = (doc is None, doc or 0)
        words.append((doc, text, w))
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), (*key, p))
    out = []
    for doc, _, w in words:
        gone = np.zeros(len(w), dtype=bool)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (doc is None, doc or 0, p):
                gone[p:p + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(rng.choice(["a", "b"], rng.integers(0, 90), p=[0.9, 0.1]))) for i in range(120)]
    docs += [(200 + i, " ".join(rng.choice(["x", "y", "z"], 7)) + " " + passage + " " + " ".join(rng.choice(["x", "y"], 6))) for i in range(80)]
    return docs + [(300, None), (301, ""), (302, "q r " * 40), (303, "q r\n" * 40), (303, "q r\n" * 40), (303, "another text here"), (None, passage)]


@pytest.mark.parametrize("frequent, flush", [(1e-5, 1 << 15), (1.0, 1 << 15), (1e-5, 8), (1.0, 8)])
def test_removed_words_match_brute_force(spark, monkeypatch, frequent, flush):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "FLUSH", flush)
    monkeypatch.setattr(S, "LAYOUT_SAMPLE", 1)
    docs = corpus(3)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, doc int, marks int").repartition(5)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in S.remove_repeats(df).collect()]
    assert sorted(got, key=str) == slow(docs, 20)
    assert sum(g[2] for g in got) > 1000


def test_repeats_are_maximal_runs(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame([(1, text), (2, "a " + text + " b"), (3, "short")], "doc_id long, text string")).collect()}
    assert [tuple(x) for x in rows[2]["repeats"]] == [(1, 51)] and rows[2]["kept"] == "a b"
    assert rows[1]["repeats"] == [] and rows[3]["kept"] == "short"
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(0)
    for _ in range(50):
        common = [f"{x}".encode() for x in rng.integers(0, 4, 40)]
        sides = [[f"{x}".encode() for x in rng.integers(5, 9, rng.integers(0, 30))] for _ in range(2)]
        found = []
        for side in sides:
            seeds, first, digests = S.anchors(side + common)
            size = np.diff(np.r_[first, len(digests)])
            found.append({(int(s), int(d)) for s, d in zip(np.repeat(seeds, size), digests)})
        assert len(found[0] & found[1]) >= len({tuple(common[i:i + 20]) for i in range(21)})


def test_least_is_the_last_of_equals():
    x = np.array([5, 3, 3, 9, 3, 7, 1, 1], dtype=np.uint64) << np.uint64(24)
    for width in range(1, 6):
        want = [max(i + j for j in range(width) if x[i + j] == x[i:i + width].min()) for i in range(len(x) - width + 1)]
        assert S._last_least(x, width).tolist() == want
