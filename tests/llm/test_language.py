import numpy as np

from veriloom.llm import language as L


def test_kernel_counts_shared_n_grams():
    texts = ["abc abd", "ABC, abd!", "xyz"]
    rows = np.stack([L.presence(t) for t in texts]).astype(np.float32)
    marks = rows / np.sqrt(rows.sum(1))[:, None]
    k = L.kernel(rows, marks)
    assert np.allclose(np.diag(k), 1) and np.isclose(k[0, 1], 1)

    def grams(t):
        t = f" {t} "
        return {t[i:i + n] for n in range(1, L.ORDERS + 1) for i in range(len(t) - n + 1)}

    a, b = grams("abc abd"), grams("xyz")
    assert np.isclose(k[0, 2], len(a & b) / np.sqrt(len(a) * len(b)), atol=1e-6)


def test_texts_without_a_letter_are_unknown():
    assert all(L.presence(t) is None for t in (None, "", " ", "12 !?", "🙂\U0001F600", "_"))
    assert all(L.presence(t) is not None for t in ("a", "ß", "漢", "\U00020000", "1a", "x" * 300_000))


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(None, None, None), (2001, "", "en"), (2002, "123", "en"), (2003, "the and of this", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(more)
    rows = {r["doc_id"]: r for r in L.identify(both).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in want if rows[d]["held_out"]]
    assert np.mean([rows[d]["lang_pred"] == want[d] for d in held]) > 0.98 and len(held) > 100
    assert all(rows[d]["lang_pred"] == "und" and rows[d]["score"] == 0 for d in (None, 2001, 2002))
    assert rows[2003]["lang_pred"] == "en" and 0 < rows[2003]["score"] <= 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.identify(docs).collect()] == [("und", 0.0)] * 2
    assert L.identify(docs.limit(0)).count() == 0
