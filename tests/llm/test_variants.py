import random
import re
import zlib
from collections import Counter

from veriloom.llm import variants as V


def brute_vocabulary(docs, min_chars=6, min_count=5):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_chars and n >= min_count}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(others), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_variants_equal_all_pairs(spark):
    rng = random.Random(5)
    words = {}
    for _ in range(700):  # few letters and lengths, so edits of repeated letters and ties are frequent
        words["".join(rng.choice("aabé") for _ in range(rng.randint(2, 7)))] = rng.choice([1, 2, 5, 5, 25, 26, 125, 3000])
    want = brute_variants(words)
    assert any(v[0] and v[1] != v[0] for v in want.values())  # chains
    made = V.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(made) == want


def test_words_of_any_length(spark, monkeypatch):
    rng = random.Random(6)
    words = {}
    for size in [4, 5, 6, 62, 63, 64, 65, 66, 3000]:
        stem = "".join(rng.choice("aab") for _ in range(size))
        for _ in range(12):
            at = rng.randrange(size)
            words[stem[:at] + rng.choice(["", "b", "éa", "c", stem[at]]) + stem[at + 1:]] = rng.choice([5, 7, 60])
    want = brute_variants(words)
    assert sum(v[3] > 0 for v in want.values()) > 50
    table = spark.createDataFrame([(w, n, 3, 1) for w, n in words.items()], "word string, n long, rank int, root int")
    assert got(V.variants(table)) == want
    monkeypatch.setattr(V, "PLAIN_CHARS", 5)
    monkeypatch.setattr(V, "HELD_WORDS", 7)
    assert got(V.variants(table)) == want


def test_long_chains_reach_their_root(spark):
    words = {"a" * 6 + "b" * i: 5 ** (12 - i) for i in range(12)}
    made = got(V.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert made == brute_variants(words)
    assert {v[1] for v in made.values()} == {"a" * 6}


def test_vocabulary_and_variants_of_texts(spark):
    rng = random.Random(9)
    base = ["Energie", "energies", "energia", "Énergie", "énergie", "letters", "letter", "lettres", "better", "short", "x" * 40]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", " 7", "\n"]) for _ in range(rng.choice([1, 30, 60])))) for i in range(400)]
    docs += [(3, docs[3][1]), (None, "letters letters"), (900, None), (901, ""), (902, "energie" * 60_000), (903, "Letters " * 30_000)]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string").repartition(5)
    want = brute_vocabulary(docs)
    assert {r["word"]: r["n"] for r in V.vocabulary(df).collect()} == want
    assert len(want) > len({b.lower() for b in base})  # damaged ones are there
    assert got(V.variants(V.vocabulary(df))) == brute_variants(want)


def test_counts_pass_on_before_a_task_holds_too_many(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD_WORDS", 3)
    docs = [(i, "alphabet betting gammas deltas epsilon zetaeta " * 3) for i in range(20)]
    assert {r["word"]: r["n"] for r in V.vocabulary(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute_vocabulary(docs)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert V.variants(V.vocabulary(empty)).count() == 0
    assert got(V.variants(spark.createDataFrame([("lonely", 5)], "word string, n long"))) == {"lonely": (None, "lonely", 5, 0, None)}
