"""Ordered results, skewed joins and tail probabilities."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions import ordered as O
from veriloom.functions import skew, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows have one key, some have none; values are tied."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 31 == 1, None).otherwise(
            F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        (F.col("id") * 7919 % 50).alias("t"), (F.col("id") * 104729 % 211).cast("double").alias("v")).repartition(8)


def same(df, a, b):
    return df.where(~F.col(a).eqNullSafe(F.col(b))).count() == 0


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_plain_window(skewed, pieces, keys):
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    some = F.when(F.col("id") % 5 == 0, F.col("v"))
    out = O.running(skewed, keys, ["t", "id"], sums={"s": F.col("v"), "rn": F.lit(1)}, lasts={"l": some}, totals={"n": F.lit(1)})
    out = out.withColumns({"s2": F.sum("v").over(w), "rn2": F.row_number().over(w).cast("bigint"), "l2": F.last(some, True).over(w)})
    assert out.count() == 3000
    assert same(out, "s", "s2") and same(out, "rn", "rn2") and same(out, "l", "l2")
    total = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("a"), F.max("n").alias("b"))
    if keys:
        total = total.where(F.col("k").isNotNull())
    assert total.where("a <> c or b <> c").count() == 0


def test_many_pieces_really_cut_the_hot_key(skewed, spark, pieces):
    cut = O.cut_by_range(skewed, ["k", "t", "id"])
    n = cut.where("k = 'hot'").select(O.PIECE).distinct().count()
    assert n == 1 if pieces == "one_piece" else n > 1


@pytest.mark.parametrize("block", [1, 40, 100000])
def test_row_frames_and_lags(skewed, pieces, block):
    w = W.partitionBy("k").orderBy("t", "id")
    a = O.row_frame(skewed, ["k"], ["t", "id"], 9, {"m": F.sum("v")}, block=block).withColumn("m2", F.sum("v").over(w.rowsBetween(-9, 0)))
    assert a.count() == 3000 and same(a, "m", "m2")
    b = O.lagged(skewed, ["k"], ["t", "id"], "v", [1, 4], block=block).withColumns({"x": F.lag("v", 1).over(w), "y": F.lag("v", 4).over(w)})
    assert b.count() == 3000 and same(b, "v_lag1", "x") and same(b, "v_lag4", "y")


def test_quantiles_match_numpy(skewed, pieces):
    got = {r["feature"]: r for r in O.quantiles(skewed, ["v", "t"], {"a": 0.05, "b": 0.5, "c": 0.93}, distinct=True).collect()}
    pdf = skewed.toPandas()
    for f in ("v", "t"):
        assert np.allclose([got[f][x] for x in "abc"], np.quantile(pdf[f], [0.05, 0.5, 0.93]))
        assert got[f]["n"] == 3000 and got[f]["distinct_values"] == pdf[f].nunique()
    by = {r["k"]: r["b"] for r in O.quantiles(skewed, ["v"], {"b": 0.5}, ["k"]).collect()}
    for k, g in pdf.dropna().groupby("k"):
        assert by[k] == pytest.approx(g["v"].median())


def test_sketched_quantiles_are_near(skewed):
    r = O.quantiles(skewed, ["v"], {"b": 0.5}, accuracy=1000).first()
    assert abs(r["b"] - np.quantile(skewed.toPandas()["v"], 0.5)) <= 2 and r["n"] == 3000


def test_average_ranks(spark, pieces):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (40.0,), (None,)], "x double")
    assert {r["x"]: r["avg_rank"] for r in O.average_ranks(df, "x").collect()} == {10.0: 1.0, 20.0: 2.5, 40.0: 4.0}


@pytest.mark.parametrize("weight", [None, "n"])
@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_lookup_join_equals_join(skewed, monkeypatch, weight, how, limit):
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", limit)
    table = skewed.where("k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    plain = skewed.join(table, "k", how)
    out = skew.lookup_join(skewed, table, ["k"], "id", weight=weight, how=how).select(*plain.columns)
    assert out.exceptAll(plain).count() == 0 and out.count() == plain.count()


def test_salted_path_equals_broadcast_path(skewed, monkeypatch):
    table = skewed.groupBy("k").agg(F.max("v").alias("top"))
    a = skew.lookup_join(skewed, table, ["k"], "id")
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", -1)
    b = skew.lookup_join(skewed, table, ["k"], "id").select(*a.columns)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


@pytest.mark.parametrize("got, want", [
    (stats.t_sf2(2.776, 4), 0.05), (stats.t_sf2(2.228, 10), 0.05), (stats.chi2_sf(3.841, 1), 0.05), (stats.chi2_sf(18.307, 10), 0.05),
    (stats.f_sf(4.965, 1, 10), 0.05), (stats.f_sf(3.098, 3, 20), 0.05), (stats.normal_sf(1.6449), 0.05), (stats.kolmogorov_sf(1.3581), 0.05),
    (stats.kolmogorov_sf(1.6276), 0.01), (stats.t_quantile(0.975, 4), 2.7764), (stats.t_quantile(0.025, 10), -2.2281), (stats.kolmogorov_sf(0.5), 0.9639)])
def test_tail_probabilities_match_tables(got, want):
    assert got == pytest.approx(want, abs=2e-4)


def test_brackets_are_cut_until_they_hold_few_rows(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(2500, 0.25), rng.integers(0, 5, 2500), [np.nan] * 3])
    df = spark.createDataFrame([(float(v), float(-v) if i % 3 else None) for i, v in enumerate(x)], "a double, b double")
    probs = {f"p{i}": i / 20 for i in range(21)}
    monkeypatch.setattr(O, "BRACKETS", 100)
    for accuracy, rows in ((10_000, 200_000), (50, 0), (7, 0)):
        monkeypatch.setattr(O, "BRACKET_ACCURACY", accuracy)
        monkeypatch.setattr(O, "BRACKET_ROWS", rows)
        got = {r["feature"]: r for r in O.quantiles(df, ["a", "b"], probs).collect()}
        for c in "ab":
            known = np.array([r[c] for r in df.collect() if r[c] is not None and r[c] == r[c]])
            assert got[c]["n"] == len(known)
            assert np.allclose([got[c][p] for p in probs], np.quantile(known, list(probs.values())), rtol=0, atol=1e-12)
    empty = O.quantiles(df.where("a > 100"), ["a"], probs)
    assert empty.count() == 0


def test_small_lookups_leave_the_rows_where_they_are(spark, skewed):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        table = skewed.groupBy("k").agg(F.max("v").alias("top"))
        text = skew.lookup_join(skewed, table, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_patterns_find_in_java_what_they_find_in_re2(spark):
    import duckdb
    from veriloom.functions import lexicon as L
    from veriloom.operators import governance as G
    from veriloom.operators import text as X

    texts = ["euxréeau 243.12", "é 555-123-4567é", "ab\x0b1234 ab\t1234", "ſab 123 Ka-4567", "5:30\x0bpm 5:30 pm", "on 1/2/2024ü", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    counts, masked = X.entity_counts(df, "text").orderBy("id").collect(), G.anonymize(df, "text").orderBy("id").collect()
    for row, mask, text in zip(counts, masked, texts):
        for name, pattern in L.ENTITIES.items():
            assert row[name] == duckdb.execute("select len(regexp_extract_all(?, ?))", [text, f"(?i){pattern}"]).fetchone()[0], (name, text)
        want = text
        for pattern, by in G.MASKS:
            want = duckdb.execute("select regexp_replace(?, ?, ?, 'g')", [want, f"(?i){pattern}", by]).fetchone()[0]
        assert mask["text"] == want
