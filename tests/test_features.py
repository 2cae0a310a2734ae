"""Cleaning, encoding, features and text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from veriloom.operators import features as E
from veriloom.operators import prep as R
from veriloom.operators import text as X


@pytest.mark.parametrize("leaf", [1, 8])
def test_knn_imputation_equals_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    n = 240
    x, y = rng.integers(0, 12, n), np.where(np.arange(n) % 10 == 0, 90 + np.arange(n) % 7, rng.integers(0, 9, n))
    t = [None if i % 6 == 1 else float(i * i % 101) for i in range(n)]
    df = spark.createDataFrame([(i, int(x[i]), int(y[i]), t[i]) for i in range(n)], "id int, x int, y int, t double")
    got = {r["id"]: r["t"] for r in R.knn_impute(df, "t", ["x", "y"], "id", k=5, leaf=leaf).collect()}
    assert len(got) == n
    for i in range(n):
        if t[i] is None:
            near = sorted((math.hypot(x[i] - x[j], y[i] - y[j]), j) for j in range(n) if t[j] is not None)[:5]
            assert got[i] == pytest.approx(np.mean([t[j] for _, j in near])), i
        else:
            assert got[i] == t[i]


def test_knn_with_fewer_donors_than_k(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 5.0, 10.0), (3, 900.0, 20.0)], "id int, x double, t double")
    assert {r["id"]: r["t"] for r in R.knn_impute(df, "t", ["x"], "id").collect()}[1] == 15.0


def brute_knn(rows, k):
    """Each row to fill against all donors, over the features known in both."""
    donors = [r for r in rows if r[-1] is not None]
    out = {}
    for key, *x, t in rows:
        near = []
        for other, *y, v in donors:
            both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
            if both:
                near.append((sum((a - b) ** 2 for a, b in both) * (len(x) / len(both)), other, v))
        values = [v for *_, v in sorted(near)[:k]] or [d[-1] for d in donors]
        if t is not None or not donors:
            out[key] = t
        elif isinstance(donors[0][-1], str):
            out[key] = min(values, key=lambda v: (-values.count(v), v))
        else:
            out[key] = pytest.approx(np.mean(values))
    return out


@pytest.mark.parametrize("features", [1, 2, 3])
def test_knn_with_unknown_features_outliers_and_text(spark, features):
    rng = np.random.default_rng(features)
    rows = []
    for i in range(300):
        x = [None if rng.random() < 0.15 else float(v) for v in (rng.integers(0, 9, features) if i % 2 else rng.normal(0, 1, features))]
        rows.append((i, *x, None if i % 5 == 0 else float(rng.integers(0, 50))))
    rows += [(900, *[1e9] * features, 3.0), (901, *[1e9] * features, None), (902, *[-4e7] * features, None), (903, *[float("nan")] * features, None), (904, *[None] * features, None)]
    known = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    names = [f"f{i}" for i in range(features)]
    df = spark.createDataFrame(rows, "id int, " + "".join(f"{c} double, " for c in names) + "t double")
    got = R.knn_impute(df, "t", names, "id", k=4)
    assert got.columns == df.columns
    assert {r["id"]: r["t"] for r in got.collect()} == brute_knn(known, 4)
    words = [(*r[:-1], None if r[-1] is None else "abc"[int(r[-1]) % 3]) for r in known]
    df = spark.createDataFrame(words, "id int, " + "".join(f"{c} double, " for c in names) + "t string")
    assert {r["id"]: r["t"] for r in R.knn_impute(df, "t", names, "id", k=4).collect()} == brute_knn(words, 4)
    none = df.withColumn("t", F.lit(None).cast("string"))
    assert R.knn_impute(none, "t", names, "id").where("t is not null").count() == 0 and R.knn_impute(df.limit(0), "t", names, "id").count() == 0


def test_knn_meets_few_donors_beside_an_outlier(spark):
    from veriloom.operators import knn

    rng = np.random.default_rng(2)
    x = rng.random((4000, 2))
    rows = [(i, float(a), float(b), None if i % 10 == 0 else 1.0) for i, (a, b) in enumerate(x)] + [(9000, 1e9, 1e9, 5.0), (9001, 9e8, 0.0, None)]
    points = spark.createDataFrame([(0, [(i, t)], a, b) for i, a, b, t in rows if t is not None], "g long, donors array<struct<id int, t double>>, x0 double, x1 double")
    queries = spark.createDataFrame([(str(i), 0, 1.0, a, b) for i, a, b, t in rows if t is None], "query string, g long, weight double, q0 double, q1 double")
    met = knn._Pyramid(points, 2, knn.LEAF).search(queries, 5).groupBy("query").count().agg(F.sum("count"), F.max("count")).first()
    assert met[0] <= 12 * 5 * 401 and met[1] <= 40 * 5, met  # all pairs would be 1,444,000


def test_imputer_strategies_and_mode_ties(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None), (8.0, "a"), (8.0, "b")], "x double, s string")
    fit = R.fit_imputer(df, {"x": "median", "s": "mode"})
    assert (None, None) not in rows(R.apply_imputer(df, fit, ["x", "s"]))
    assert dict(rows(fit)) == {"x": "5.5", "s": "a"}


def test_forward_fill_crosses_pieces(spark, pieces):
    df = spark.range(500).select("id", F.lit("one").alias("k"), F.when(F.col("id") == 3, 7.0).alias("v"))
    out = R.forward_fill(df, ["k"], ["id"], ["v"])
    assert out.where("v = 7.0").count() == 497 and out.where("id < 3 and v is null").count() == 3


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 0), (3, "c", 1), (4, "b", 0)], "id int, c string, y int")
    new = spark.createDataFrame([(9, "c"), (10, "zzz"), (11, None)], "id int, c string")
    assert rows(R.label_encode(new, "c", R.fit_labels(df, "c"), "id", "code").select("id", "code"), "id") == [(9, 2), (10, 0), (11, 0)]
    assert rows(R.target_encode(new, "c", R.fit_targets(df, "c", "y"), "id", "e").select("id", "e"), "id") == [(9, 1.0), (10, 0.5), (11, 0.5)]
    hot = R.one_hot(new, "c", R.categories(df, "c", 10))
    assert hot.columns == ["id", "c_b", "c_c"] and rows(hot, "id")[1] == (10, 0.0, 0.0)
    assert R.categories(df, "c", 2) is None


def test_scalers_handle_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    for method in ("standard", "minmax", "robust"):
        out = R.apply_scaler(df, R.fit_scaler(df, ["x", "c"], method), ["x", "c"])
        assert {r["c"] for r in out.collect()} == {0.0}
    std = R.fit_scaler(df, ["x"], "standard").first()["scale"]
    assert std == pytest.approx(np.std([1, 2, 4]))


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1000.0,), (1000.01,), (1e9,), (-1.0,), (None,)], "a double")
    got = [r[1] for r in rows(R.bucketize(df, {"b": ("a", R.AMOUNT_BINS)}))]
    assert got == [None, "small", "medium", "very_large", None, None]


def test_weekday_is_zero_on_monday(spark):
    df = spark.sql("select date '2024-01-01' as d")
    r = R.date_parts(df, ["d"], "2024-01-11").first()
    assert (r["d_weekday"], r["d_is_weekend"], r["d_days_since"]) == (0, False, 10)


def test_preprocessor_round_trip(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").alias("key"), F.when(F.col("id") % 4 != 0, F.col("id") * 10.0).alias("amount"), F.lit(1).alias("same"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("kind"), F.lit("2024-01-01").cast("date").alias("day"),
        (F.col("id") % 2).cast("int").alias("y"))
    fitted = R.Preprocessor("key", "2024-02-01", label="y", bins={"band": ("amount", R.AMOUNT_BINS)}).fit(df)
    fitted.save(spark, str(tmp_path))
    a, b = fitted.transform(df), R.FittedPreprocessor.load(spark, str(tmp_path)).transform(df)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0
    assert "same" not in a.columns and "kind_y" in a.columns and a.select(F.avg("amount")).first()[0] == pytest.approx(0, abs=1e-9)


def test_dedupe_columns_and_constants(spark):
    df = spark.range(3).selectExpr("id as a", "1 as one", "id * 2 as a")
    assert R.dedupe_columns(df).columns == ["a", "one"]
    assert R.drop_constant(R.dedupe_columns(df)).columns == ["a"]


def test_recent_count_half_open_interval(spark, pieces):
    df = spark.sql("""select * from values (1, 'c', timestamp_ntz'2024-01-01'), (2, 'c', timestamp_ntz'2024-01-31'), (3, 'c', timestamp_ntz'2024-01-30 23:59:59'),
      (4, 'd', timestamp_ntz'2024-01-31'), (5, 'c', timestamp_ntz'2024-01-31') t(id, k, ts)""")
    got = dict(rows(E.recent_count(df, "k", "ts", "id").select("id", "recent_claims_count")))
    assert got == {1: 1, 3: 2, 2: 3, 5: 3, 4: 1}


def test_percentile_rank_and_ratio(spark, pieces):
    df = spark.createDataFrame([(1, 10, 0), (2, 20, 2), (3, 20, 4), (4, None, 1)], "id int, claim_amount int, customer_age int")
    pct = dict(rows(E.percentile_rank(df, "claim_amount", "id").select("id", "claim_amount_percentile")))
    assert pct[1] == pytest.approx(1 / 3) and pct[2] == pct[3] == pytest.approx(2.5 / 3) and pct[4] is None
    assert E.ratios(df).where("id = 1").first()["claim_amount_to_customer_age_ratio"] == pytest.approx(10 / 1e-6)


def test_anova_matches_hand_computation(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 2.0), (1, 4.0), (1, 6.0)], "y int, x double")
    # group means 2 and 4, grand mean 3: between 6 / 1, within (2 + 8) / 4
    assert E.anova_f(df, ["x"], "y").first()["score"] == pytest.approx(2.4)


def test_mutual_information_of_a_copy_is_the_entropy(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), (F.col("id") % 2).cast("double").alias("x"), ((F.col("id") / 2).cast("int") % 2).cast("double").alias("z"))
    mi = dict(rows(E.mutual_information(df, ["x", "z"], "y")))
    assert mi["x"] == pytest.approx(math.log(2)) and mi["z"] == pytest.approx(0, abs=1e-9)


# ------------------------------------------------------------------ text

def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("r")).first()[0]


def test_contractions_keep_their_order(spark):
    assert one(spark, X.expand_contractions("t"), "can't won't don't Can't we'll I'm") == "cannot will not do not Ca not we will I am"


def test_cleaning(spark):
    assert one(spark, X.clean("t"), "  The driver WON'T pay: a 20% hit!\n on the  car ") == "driver wont pay 20 hit car"
    assert one(spark, X.clean("t", drop_digits=True), "The total is 1234 euros now") == "total euros"
    limits = {"min_chars": 10, "max_chars": 5000}
    assert one(spark, X.clean("t", **limits), "too short") == "" and one(spark, X.clean("t", **limits), "word " * 1200) == ""
    assert one(spark, X.clean("t"), "too short") == "short" and len(one(spark, X.clean("t"), "word " * 1200)) == 5999
    assert one(spark, X.clean("t"), None) == ""


def test_text_features(spark):
    text = "Severe injury at 10:30 pm on 01/02/2024. Paid $1,200.50! Call 555-123-4567, plate ABC-1234?"
    r = X.features(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "t").orderBy("id").collect()
    assert (r[0]["text_length"], r[0]["word_count"], r[0]["sentence_count"]) == (len(text), len(text.split()), 4)
    assert r[0]["capital_letters_count"] == sum(c.isupper() for c in text) and r[0]["digit_count"] == sum(c.isdigit() for c in text)
    assert (r[0]["severity_indicators_mentions"], r[0]["medical_terms_mentions"]) == (1, 1)
    assert (r[0]["times_mentioned"], r[0]["dates_mentioned"], r[0]["phone_numbers"], r[0]["license_plates"]) == (1, 1, 1, 1)
    assert r[1]["text_length"] == 0 and r[1]["sentiment_neutral"] == 1.0


def test_sentiment(spark):
    r = X.sentiment(spark.createDataFrame([("a good, great but bad day",)], "t string"), "t").first()
    assert (r["sentiment_compound"], r["sentiment_negative"], r["sentiment_neutral"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(0.5))


def test_tfidf_weights(spark):
    df = spark.createDataFrame([(1, "apple banana apple"), (2, "apple cherry"), (3, "banana cherry banana")], "id int, t string")
    counts = X.term_counts(df, "id", "t", ngrams=(1,))
    vocabulary = X.fit_vocabulary(counts, "id", min_df=1, max_df=1.0)
    assert {r["term"]: r["idf"] for r in vocabulary.collect()} == {t: pytest.approx(math.log(4 / 3) + 1) for t in ("apple", "banana", "cherry")}
    w = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(counts, vocabulary, "id").collect()}
    assert w[1, "apple"] == pytest.approx(2 / math.sqrt(5)) and w[2, "cherry"] == pytest.approx(1 / math.sqrt(2))


def test_vectors_in_the_row_equal_joined_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"word{chr(97 + i)}" for i in range(12)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)] + [(90, None), (91, "")], "id int, t string").repartition(3)
    counts = X.term_counts(df, "id", "t")
    want = X.fit_vocabulary(counts, "id", 100, documents=df)
    monkeypatch.setattr(X, "HELD_TERMS", 5)
    learnt = X.learn_vocabulary(df, "t", 100)
    assert rows(learnt.select("term", "df", "total", "idf"), "term") == rows(want.select("term", "df", "total", "idf"), "term")
    vectors = X.term_vectors(df, "t", learnt)
    assert "Exchange hashpartitioning" not in vectors._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["term"]): (r["tf"], r["weight"]) for r in vectors.select("id", F.inline("terms")).collect()}
    tf = {(r["id"], r["term"]): r["tf"] for r in X.count_vectors(counts, want).collect()}
    weight = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(counts, want, "id").collect()}
    assert got == {k: (tf[k], pytest.approx(weight[k])) for k in tf}
    assert X.learn_vocabulary(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_only_terms_of_frequent_words_are_counted_beyond_words(spark, monkeypatch, most):
    monkeypatch.setattr(X, "MAX_NUMBERED", most)
    whole, asked = X._all_terms, []
    monkeypatch.setattr(X, "_all_terms", lambda toks, sizes: asked.append(list(sizes)) or whole(toks, sizes))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [f"w{int(w)}" for w in rng.zipf(1.6, rng.integers(0, 40)).clip(0, 90)]) for i in range(80)], "id int, tok array<string>").repartition(3)
    counts = df.select("id", F.explode(X._ngrams(F.col("tok"), (1, 2))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    for size in (8, 40, 5000):
        want = X.fit_vocabulary(counts, "id", size, documents=df)
        learnt = X.learn_vocabulary(df, "tok", size)
        assert rows(learnt.select("term", "df", "total", "idf"), "term") == rows(want.select("term", "df", "total", "idf"), "term")
    assert ([1, 2] in asked) == (most == 3)


def test_words_with_spaces_are_terms_as_any_other(spark):
    df = spark.createDataFrame([(1, ["a b", "c"]), (2, ["a", "b", "a b"]), (3, None), (4, ["a", "b", "c"])], "id int, tok array<string>").coalesce(1)
    learnt = X.learn_vocabulary(df, "tok", 100, max_df=1.0)
    assert {r["term"]: (r["df"], r["total"]) for r in learnt.collect()} == {"a b": (3, 4), "a": (2, 2), "b": (2, 2), "c": (2, 2)}
    got = {r["id"]: {t["term"]: t["tf"] for t in r["terms"]} for r in X.term_vectors(df, "tok", learnt).collect()}
    assert got == {1: {"a b": 1, "c": 1}, 2: {"a": 1, "b": 1, "a b": 2}, 3: {}, 4: {"a": 1, "b": 1, "c": 1, "a b": 1}}


def test_topics_are_fitted_on_stored_counts_of_the_most_used_words(spark, monkeypatch):
    kept, names = X.stored, []
    monkeypatch.setattr(X, "stored", lambda df, name: names.append((name, df.columns)) or kept(df, name))
    df = spark.createDataFrame([(i, ["b", "a", "d"] if i % 2 else ["c", "c", "b", "once" * (i == 0)]) for i in range(20)] + [(20, None)], "id int, tok array<string>")
    model = X.fit_topics(df, "tok", topics=2, terms=2, max_iter=2)
    assert model.stages[0].vocabulary == ["c", "a"]  # b is in too many rows, d is as frequent as a
    assert ("counts", ["_counts"]) in names
    shares = model.transform(df.where("tok is not null")).select(F.aggregate(X.vector_to_array("topics"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares.collect())


def test_tokens_split_at_all_white_space_without_a_pass_for_runs(spark):
    df = spark.createDataFrame([("\u3000 Can't\t\tstop,  the\x0b12big\u2003 a red.car \n",)], "t string")
    assert df.select(X.tokens("t")).first()[0] == df.select(X.tokens("t", min_chars=0)).first()[0] == ["ca", "stop", "12big", "redcar"]
    assert "regexp_replace" not in df.select(X.tokens("t"))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_lemmas_keep_token_order(spark, monkeypatch, limit):
    monkeypatch.setattr("veriloom.functions.skew.MAX_BROADCAST_BYTES", limit)
    df = spark.createDataFrame([(1, ["cars", "hit", "cars"]), (2, []), (3, None), (4, ["cars", None])], "id int, tok array<string>")
    lemmas = spark.createDataFrame([("cars", "car"), ("hit", None)], "form string, lemma string")
    out = X.lemmatize(df, "id", "tok", lemmas)
    assert dict(rows(out)) == {1: ["car", "hit", "car"], 2: [], 3: [], 4: ["car", None]}
    assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (limit < 0)


def test_feature_stage_keeps_the_statistics_of_its_fit(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from veriloom.operators.stages import OUTPUTS, FeatureStage

    fitted_on = spark.createDataFrame([(float(i), 45) for i in range(101)] + [(None, 45), (float("nan"), 45)], "claim_amount double, age int")
    new = spark.createDataFrame([(1, 96.0, 45), (2, 500.0, 90), (3, None, 0)], "id int, claim_amount double, age int")
    model = Pipeline(stages=[FeatureStage(age="age")]).fit(fitted_on)
    assert model.stages[0].getOrDefault("statistics") == {"lo": 0.0, "hi": 100.0, "mean": 50.0, "p80": 80.0, "p95": 95.0}
    model.write().save(str(tmp_path / "stage"))
    loaded = PipelineModel.load(str(tmp_path / "stage"))
    out = loaded.transform(new)
    assert set(OUTPUTS) | {"claim_amount_to_age_ratio", "claim_amount_x_age"} <= set(out.columns)
    assert rows(out.select("id", *OUTPUTS), "id") == [(1, pytest.approx(0.48), 1.0, 1, 46.0), (2, pytest.approx(3.0), 1.0, 1, 450.0), (3, None, 0.0, 0, None)]
    assert rows(model.transform(new).select("id", *OUTPUTS), "id")[1] == rows(out.select("id", *OUTPUTS), "id")[1]
    alone = loaded.transform(new.where("id = 1"))  # the answer does not depend on what is scored with it
    assert alone.first()["composite_risk_score"] == pytest.approx(0.48)
    empty = FeatureStage(age="age").fit(fitted_on.limit(0)).transform(new)
    assert rows(empty.select("id", "fraud_risk_score", "above_usual"), "id")[0] == (1, 0.0, None)


@pytest.mark.parametrize("selection", ["f", "mi"])
def test_interactions_and_selection_are_fitted_saved_and_applied(spark, tmp_path, selection):
    """The label is the sign of a product that only the interaction shows; unseen rows get the same columns."""
    rows_ = [(i, float(i % 9 - 4), float((i * 7) % 11 - 5), float((i * 5) % 13), 0.0, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows_, "id int, a double, b double, noise double, flat double, c string").withColumn("y", (F.col("a") * F.col("b") > 0).cast("int"))
    fitted = R.Preprocessor("id", "2024-01-01", label="y", interactions=[("a", "b"), ("a", "flat")], select=2, selection=selection).fit(df)
    fitted.save(spark, str(tmp_path / "p"))
    loaded = R.FittedPreprocessor.load(spark, str(tmp_path / "p"))
    assert fitted.plan["interactions"] == [["a", "b"]]  # flat is constant and dropped
    best = loaded.importance().orderBy(F.desc("importance")).first()
    assert best["feature"] == "a_x_b" and best["selected"] and loaded.importance().where("selected").count() == 2
    out = loaded.transform(df.limit(50))
    assert out.columns[:2] == ["id", "y"] and len(out.columns) == 4 and "a_x_b" in out.columns and out.count() == 50


def test_modes_of_all_columns_in_one_scan(spark):
    data = [(10, "b", 2.0, None), (9, "a", float("nan"), None), (9, "b", 2.0, None), (10, "a", None, None), (None, None, 1.5, None)]
    df = spark.createDataFrame(data, "i int, s string, x double, z string")
    assert {r["feature"]: r["value"] for r in R.modes(df, ["i", "s", "x", "z"]).collect()} == {"i": "9", "s": "a", "x": "2.0", "z": None}
    assert R.modes(df, ["i", "s", "x", "z"])._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(filter") == 1


def test_categories_beyond_the_bound_are_refused(spark):
    df = spark.range(30).withColumn("c", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="more than 20"):
        R.categories(df, "c", bound=20)
    assert len(R.categories(df, "c", bound=30)) == 30 and R.categories(df, "c", 5) is None


def test_correlations_over_rows_that_know_both(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1.0, (300, 3))
    x[:, 2] = x[:, 0] * 2 + rng.normal(0, 0.5, 300)
    known = rng.random((300, 3)) > 0.2
    data = [(*[float(v) if k else (None if i % 2 else float("nan")) for v, k in zip(row, ok)], 7.0, None) for i, (row, ok) in enumerate(zip(x, known))]
    df = spark.createDataFrame(data, "a double, b double, c double, same double, none double").repartition(6)
    got = {(r["feature_1"], r["feature_2"]): r["corr"] for r in E.correlations(df, df.columns).collect()}
    assert len(got) == 10
    for i, j, pair in ((0, 1, ("a", "b")), (0, 2, ("a", "c")), (1, 2, ("b", "c"))):
        both = known[:, i] & known[:, j]
        assert got[pair] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert {v for k, v in got.items() if "same" in k or "none" in k} == {None}
    assert {r["feature"] for r in E.correlated_features(df, df.columns, 0.9).collect()} == {"c"}
    assert E.correlations(df.limit(0), df.columns).count() == 0
