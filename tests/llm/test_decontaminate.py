import numpy as np

from veriloom.llm import decontaminate as D


def slow(docs, items, k=5, similarity=0.8):
    best = {}
    for doc, text in docs:
        words = D.normal_words(text)
        for item, wanted in items:
            target = D.normal_words(wanted)
            for at in range(len(words) - len(target) + 1 if target else 0):
                v = D.weighted_similarity(D.shingles(words[at:at + len(target)], k), D.shingles(target, k))
                if v >= similarity and v > best.get((doc, item), (0, 0))[0]:
                    best[doc, item] = (v, at)
    return best


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([1, 3, 4, 5, 6, 20, 40, 40, 60])] + [(20, None), (21, ""), (None, "a b c d e f g h")]
    docs = []
    for d in range(60):
        text = rng.choice(words, rng.integers(0, 120)).tolist()
        if d % 3:
            passage = items[rng.integers(5, 9)][1].split()
            for _ in range(rng.integers(0, 3)):  # edits at the rim keep the similarity near the threshold
                passage[rng.integers(0, 3)] = "other"
            text += [p.upper() for p in passage] + rng.choice(words, 5).tolist()
        docs.append((d, ("\n" if d % 2 else "  ").join(text)))
    docs += [(100, None), (101, ""), (102, "x " * 30_000), (103, docs[1][1]), (103, docs[1][1]), (None, docs[1][1])]
    schema = "doc_id long, text string, window string"
    got = D.leaks(spark.createDataFrame([(*d, "extra") for d in docs], schema), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slow(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in got} == want
    assert len(got) == len(want) > 40


def test_probes_reach_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for i in rng.permutation(64)[:rng.integers(0, D.RADIUS + 1)].tolist():
            b ^= 1 << i
        assert set(D.probes(a)) & set(enumerate(D.block_values(b)))


def test_drop_leaking_keeps_clean_rows_and_columns(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a " + item + " b", 1), (2, "clean", 2), (2, item, 3), (None, item, 4), (None, None, 5), (2, "clean", 6)],
                                 "doc_id long, text string, _key0 int")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = D.drop_leaking(docs, items)
    assert out.columns == docs.columns
    assert sorted(r["_key0"] for r in out.collect()) == [2, 5, 6]
    assert D.drop_leaking(docs, items.limit(0)).count() == 6
    assert D.leaks(docs.limit(0), items).count() == 0


def test_items_without_an_id_are_found(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    docs = [(1, f"x {a} y"), (2, f"{b} z"), (3, "clean"), (4, f"{a} {b}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, b), (5, b), (5, b)], "item_id long, text string")
    got = sorted((r["doc_id"], str(r["item_id"]), r["start"]) for r in D.leaks(df, items).collect())
    assert got == [(1, "None", 1), (2, "5", 0), (2, "None", 0), (4, "5", 20), (4, "None", 0)]
    assert [r["doc_id"] for r in D.drop_leaking(df, items).collect()] == [3]
