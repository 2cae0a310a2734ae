import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veriloom.llm import near_dedup as N
from veriloom.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_majority_of_the_shingle_hashes(spark):
    for text in ("", None, "One", "two words", "A b c a b c a b c", "ÄÖ é x\ty\nz  w", "w " * 50_000):
        assert N.fingerprint(text) == slow_fingerprint(text)
    # Spark's own hash of a string is the same function
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def slow_labels(codes, radius):
    label = list(range(len(codes)))
    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("block_rows", [1 << 18, 20])
def test_links_connect_what_chains_of_three_bits_connect(spark, block_rows):
    rng = np.random.default_rng(5)
    codes = set()
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(60):
            code = base
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                code ^= 1 << b
            codes.add(code)
    codes = sorted(codes | {0, (1 << 64) - 1, (1 << 64) - 8})
    label = slow_labels(codes, 3)
    signed = [c - (c >> 63 << 64) for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(N.links(df, 3, block_rows)).collect()}
    found = [roots.get(c, c) for c in signed]
    assert len(set(zip(label, found))) == len(set(label)) == len(set(found))


def test_components_of_chains_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(1, 2), (2, 3), (3, 1), (5, 5), (2, 1)] + [(50, x) for x in range(51, 70)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 1: 1, 2: 1, 3: 1, **{x: 50 for x in range(50, 70)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


ROWS = [(4, "the same text of five words", "x"), (2, "the same text of five words", "y"), (2, "the same text of five words", "y"),
        (9, None, "z"), (8, "", "z"), (7, "something else entirely here now", None), (None, "the same text of five words", "n")]
SCHEMA = "doc_id long, text string, fp string"


def test_near_duplicates_of_nulls_ties_and_repeated_rows(spark):
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert got == [("2", 2), ("2", 2), ("4", 2), ("7", 7), ("8", 8), ("9", 8), ("None", 2)]
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_keeps_one_row_with_all_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("n", F.lit(3))
    out = N.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["fp"]) for r in out.collect()) == [(2, "y"), (7, None), (8, "z")]
    only_null = spark.createDataFrame([(None, "alone and without an id", "a"), (None, "alone and without an id", "b")], SCHEMA)
    assert N.keep_one(only_null).count() == 1
    assert N.keep_one(df.limit(0)).count() == 0


def test_similar_documents_are_found_and_others_left(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    docs, pairs = [], []
    for i in range(60):
        text = rng.choice(words, 60 + 10 * i).tolist()
        near = list(text)
        for at in range(len(text) // 2, len(text) // 2 + max(1, len(text) // 60)):  # changes beside each other leave a similarity above 0.8
            near[at] = "changed"
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
        grams = [{tuple(t[j:j + 5]) for j in range(len(t) - 4)} for t in (text, near)]
        assert len(grams[0] & grams[1]) / len(grams[0] | grams[1]) >= 0.8
        pairs.append((2 * i, 2 * i + 1))
    for block_rows in (1 << 18, 1):
        got = {r["doc_id"]: r["component_id"] for r in N.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=block_rows).collect()}
        assert got == {d: a for a, b in pairs for d in (a, b)}


@pytest.mark.parametrize("unit", [N.UNIT, 1500])
def test_documents_are_linked_by_chains_of_similarity_point_eight_only(spark, unit):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for i in range(40):
        text = rng.choice(words, 8).tolist()
        docs += [text, [*text, "more"]]  # 4 and 5 shingles: exactly 0.8
    for n in range(8, 60):  # shared starts: similarities from below 0.6 to above 0.8
        text = rng.choice(words, 104).tolist()
        docs += [text, [*text[:104 - n // 2], *rng.choice(words, n // 2).tolist()]]
    text = rng.choice(words, 64).tolist()
    docs += [text[i:i + 44] for i in range(0, 21, 4)]  # a chain
    grams = [{tuple(t[j:j + 5]) for j in range(len(t) - 4)} for t in docs]
    want = list(range(len(docs)))
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    assert len(set(want)) < len(docs) - 60 and any(0.65 < len(a & b) / len(a | b) < 0.8 for a, b in zip(grams[80::2], grams[81::2]))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.similar_documents(df, unit=unit).collect()}
    assert [got[i] for i in range(len(docs))] == want


def test_keep_one_keeps_texts_that_are_not_similar_under_one_id(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "some other words that stand here"), (2, "alpha beta gamma delta epsilon zeta"),
            (None, "without an id but with words"), (None, "also without one and not alike")]
    assert sorted(map(str, N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(
        f"Row(doc_id={i}, text={t!r})" for k, (i, t) in enumerate(rows) if k != 2)


def test_members_pass_the_map_and_few_others_do(spark):
    from veriloom.llm.common import members

    keys = spark.range(0, 20_000, 2).select((F.col("id") * 7 - 3).alias("k"))
    inside = members(keys, "k", 10_000)
    assert keys.where(inside("k")).count() == 10_000
    others = spark.range(20_000).select((F.col("id") + 1_000_000).alias("k")).where(inside("k")).count()
    assert 0 < others < 2_000
    assert spark.range(9).where(members(keys.limit(0), "k", 0)("id")).count() == 0


def test_keep_one_keeps_repeated_and_unrepeated_rows_once(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 1000, texts[i]) for i in range(0, 300, 3)] + [(i, texts[i]) for i in range(0, 300, 5)] * 2
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(300))
