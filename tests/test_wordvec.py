"""Word vectors in pieces: every word has one, related words are near, and copies of a table need no more of a task."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriloom.operators import text as X
from veriloom.operators import wordvec as V
from veriloom.session import shared_dir

SIZE = 20


@pytest.fixture(scope="module")
def texts(spark):
    """Texts about fruit and texts about tools; each also has a word of its own."""
    topics = ["apple pear plum fig melon grape".split(), "hammer saw drill wrench chisel plane".split()]
    rng = np.random.default_rng(1)
    rows = [(i, [*rng.choice(topics[i % 2], 40).tolist(), f"only{i}"]) for i in range(400)] + [(400, []), (401, None), (402, ["never", "apple"])]
    return spark.createDataFrame(rows, "id long, tok array<string>")


def _near(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("passes", [1, 2])
def test_words_of_one_topic_are_nearer_than_others(texts, passes):
    model = X.fit_word2vec(texts, "tok", size=SIZE, parts=4, max_iter=passes)
    found = {r["word"]: np.array(r["v"]) for r in model.vectors.collect()}
    assert len(found) == 12 and all(len(v) == SIZE and np.isfinite(v).all() for v in found.values())  # words that occur once have none
    assert _near(found["apple"], found["plum"]) > _near(found["apple"], found["saw"]) + 0.3
    assert _near(found["hammer"], found["drill"]) > _near(found["hammer"], found["fig"]) + 0.3


def test_a_rare_word_has_a_vector_and_the_fit_repeats(texts):
    model = X.fit_word2vec(texts, "tok", size=SIZE, min_count=1, parts=4)
    assert model.vectors.count() == 12 + 400 + 1
    again = X.fit_word2vec(texts, "tok", size=SIZE, min_count=1, parts=4)
    one, two = ({r["word"]: r["v"] for r in m.vectors.collect()} for m in (model, again))
    assert set(one) == set(two) and all(np.allclose(one[w], two[w], atol=1e-5) for w in one)


def test_a_text_has_the_mean_of_its_words(spark, texts):
    model = X.fit_word2vec(texts, "tok", size=SIZE, parts=4)
    known = {r["word"]: np.array(r["v"]) for r in model.vectors.collect()}
    out = {r["id"]: r["w2v"].toArray() for r in model.transform(texts, "tok").collect()}
    assert len(out) == 403 and not out[400].any() and not out[401].any()
    for r in texts.where("id in (0, 7, 402)").collect():
        want = sum((known[w] for w in r["tok"] if w in known), np.zeros(SIZE)) / len(r["tok"])
        assert np.allclose(out[r["id"]], want, atol=1e-5)


def test_a_table_without_tokens(spark):
    empty = spark.createDataFrame([(1, [])], "id long, tok array<string>")
    model = X.fit_word2vec(empty, "tok", size=SIZE)
    assert model.vectors.count() == 0
    assert [r["w2v"].toArray().any() for r in model.transform(empty, "tok").collect()] == [False]
    assert model.transform(empty.limit(0), "tok").count() == 0


def test_a_task_holds_the_words_of_its_piece_only(spark, monkeypatch):
    """Ten thousand words in pieces of 2000 tokens: no group gets more words than its piece has tokens."""
    monkeypatch.setattr(V, "PIECE_TOKENS", 2000)
    wide = spark.range(1000).select(F.expr("transform(sequence(0, 19), i -> concat('w', cast((id * 20 + i) % 10000 as string)))").alias("tok"))
    pieces = V.dealt(wide.withColumn("_row", F.monotonically_increasing_id()), "tok")
    sizes = [r["n"] for r in V.words_of(pieces).groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 4000
    assert X.fit_word2vec(wide, "tok", size=SIZE).vectors.count() == 10000


def test_the_text_preprocessor_keeps_its_vectors_as_a_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, "apples and plums ripen slowly" if i % 2 else "hammers and drills work quickly") for i in range(60)] + [(60, None)], "id long, text string")
    fitted = X.TextPreprocessor("id", "text", w2v_size=SIZE, topics=2, lda_iter=2).fit(docs)
    fitted.save(spark, str(tmp_path))
    loaded = X.FittedTextPreprocessor.load(spark, str(tmp_path))
    known = {r["word"]: np.array(r["v"]) for r in loaded.word2vec.vectors.collect()}
    assert {"apples", "plums", "hammers"} <= set(known)
    out = {r["id"]: r for r in loaded.transform(docs).collect()}
    assert len(out) == 61 and not any(out[60][f"w2v_dim_{i}"] for i in range(SIZE))
    words = docs.where("id = 1").select(X.tokens("text")).first()[0]
    assert np.allclose([out[1][f"w2v_dim_{i}"] for i in range(SIZE)], sum(known[w] for w in words) / len(words), atol=1e-5)


def test_lemmas_are_replaced_a_whole_column_at_a_time(spark):
    """Null tokens stay, null texts become empty, parts of a column are read at their place."""
    column = pa.array([["x"], ["cats", None], None, [], ["bird", "cats"]], pa.list_(pa.string()))
    forms, lemmas = pa.array(["cats"]), pa.array(["cat"])
    want = [["x"], ["cat", None], [], [], ["bird", "cat"]]
    assert X._replaced(column, forms, lemmas).to_pylist() == want
    assert X._replaced(column.slice(1, 4), forms, lemmas).to_pylist() == want[1:]
    assert X._replaced(column, pa.array([], pa.string()), pa.array([], pa.string())).to_pylist()[1] == ["cats", None]


def test_the_text_preprocessor_cleans_each_text_once_to_fit_and_once_to_use(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good word{i % 3} claim{i % 5} paid") for i in range(40)] + [(40, None)], "id long, text string")
    calls, tokens = [], X.tokens
    monkeypatch.setattr(X, "tokens", lambda *a, **k: calls.append(1) or tokens(*a, **k))
    fitted = X.TextPreprocessor("id", "text", w2v_size=4, topics=2, lda_iter=2).fit(docs)
    assert fitted.transform(docs).count() == 41 and len(calls) == 2


def test_waves_give_the_same_vectors_and_leave_no_sums_behind(spark, texts, monkeypatch):
    """Eight pieces in one wave or in three: the vectors are the same, and what a wave left on disk is gone."""
    def left():
        return {p for name in ("sums", "known", "rows", "packed") for p in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/{name}-*")}

    one = {r["word"]: np.array(r["v"]) for r in X.fit_word2vec(texts, "tok", size=SIZE, parts=8, max_iter=2).vectors.collect()}
    before, stored, waves = left(), V.stored, []
    monkeypatch.setattr(V, "WAVE_PIECES", 3)
    monkeypatch.setattr(V, "WAVE_PER_CORE", 0)
    monkeypatch.setattr(V, "stored", lambda df, name, *by: waves.append(name) or stored(df, name, *by))
    model = X.fit_word2vec(texts, "tok", size=SIZE, parts=8, max_iter=2)
    three = {r["word"]: np.array(r["v"]) for r in model.vectors.collect()}
    assert waves.count("sums") == 6 and left() == before
    assert set(one) == set(three) and all(np.allclose(one[w], three[w], atol=1e-4) for w in one)
    out = {r["id"]: r["w2v"].toArray() for r in model.transform(texts, "tok").collect()}
    assert len(out) == 403 and out[0].any() and not out[400].any()


def test_each_piece_of_a_wave_has_a_task_of_its_own(spark):
    for n in (1, 7, 24):
        keys = V._keys(spark, n)
        made = spark.createDataFrame([(k,) for k in keys], "k long").repartition(n, "k").select(F.spark_partition_id().alias("p"))
        assert made.distinct().count() == n == len(set(keys))


def test_repeats_are_added_in_either_way(monkeypatch):
    rng = np.random.default_rng(0)
    ids, rows = rng.integers(0, 5, 40), rng.normal(size=(40, 3)).astype(np.float32)
    want = [rows[ids == i].sum(axis=0) for i in range(5)]
    for repeats in (0, 100):
        monkeypatch.setattr(V, "REPEATS", repeats)
        at, sums = V._sums_by(ids, rows)
        assert at.tolist() == [0, 1, 2, 3, 4] and np.allclose(sums, want, atol=1e-5)
    assert [len(x) for x in V._sums_by(ids[:0], rows[:0])] == [0, 0]


def test_word_vectors_are_made_before_there_are_features_to_move(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good word{i % 3} claim{i % 5} paid") for i in range(40)], "id long, text string")
    moved, transform = [], V.WordVectors.transform
    monkeypatch.setattr(V.WordVectors, "transform", lambda self, df, *a: moved.append(df.columns) or transform(self, df, *a))
    out = X.TextPreprocessor("id", "text", w2v_size=4, topics=2, lda_iter=2).fit(docs).transform(docs)
    assert moved == [["id", "text", "tok"]]
    assert out.columns[:3] == ["id", "tfidf", "text_length"] and out.columns[-2:] == ["topic_0", "topic_1"] and "w2v_dim_3" in out.columns


def test_words_are_counted_without_a_pattern(spark):
    texts = ["", " ", "a", " a\tb\u00a0c  d\u3000", "x\x1cy\x85z\u2028", "\u200b one", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").orderBy("id").select(X.word_count("t")).collect()]
    assert got == [0, 0, 1, 4, 3, 2, None]
