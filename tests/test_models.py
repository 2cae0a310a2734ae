"""Evaluation, comparison, drift and monitoring."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from veriloom.operators import compare as C
from veriloom.operators import drift as D
from veriloom.operators import evaluate as V
from veriloom.operators import governance as G
from veriloom.operators import modelling as M
from veriloom.operators import monitor as N
from veriloom.operators import search as S

SCORES = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.3), (0, 0.3), (1, 0.2), (0, 0.1)]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame([(i, y, p, int(p >= 0.5), "ab"[i % 2]) for i, (y, p) in enumerate(SCORES)],
                                 "key int, y_true int, p double, y_pred int, g string")


def test_confusion_and_basic_metrics(preds):
    c = V.confusion(preds)
    assert tuple(c.first()) == (2, 3, 1, 2, 8)
    m = V.basic_metrics(c).first()
    assert m["accuracy"] == 5 / 8 and m["precision_positive"] == pytest.approx(2 / 3) and m["recall_positive"] == 0.5
    assert m["matthews_corrcoef"] == pytest.approx((2 * 3 - 1 * 2) / math.sqrt(3 * 4 * 4 * 5))
    assert m["cohen_kappa"] == pytest.approx((5 / 8 - 0.5) / 0.5)
    assert V.confusion_matrix(preds).agg(F.sum("n")).first()[0] == 8


def test_zero_denominators_give_zero(spark):
    df = spark.createDataFrame([(0, 0)], "y_true int, y_pred int")
    r = V.confusion_rates(V.confusion(df)).first()
    assert (r["sensitivity"], r["specificity"], r["positive_predictive_value"]) == (0.0, 1.0, 0.0)


def test_auc_counts_ties_half(preds, pieces):
    pos, neg = [p for y, p in SCORES if y], [p for y, p in SCORES if not y]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    assert V.roc_auc(preds).first()[0] == pytest.approx(want)
    steps = V.score_steps(preds)
    roc = rows(V.roc_curve(steps), F.desc("threshold"))
    assert roc[0] == (0.9, 0.0, 0.25) and roc[-1][1:] == (1.0, 1.0)
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip([(1, 0.0, 0.0), *roc], roc))
    assert area == pytest.approx(want)
    assert V.youden_threshold(steps).first()["optimal_threshold"] == 0.4


def test_pr_summary(preds, pieces):
    r = V.pr_summary(V.score_steps(preds)).first()
    assert r["average_precision"] == pytest.approx(0.25 * 1 + 0.25 * 2 / 3 + 0.25 * 3 / 4 + 0.25 * 4 / 7)
    assert r["best_f1_threshold"] == 0.4


def test_calibration(preds):
    bins = {r["bin"]: (r["n"], r["fraction_positive"]) for r in V.calibration_bins(preds).collect()}
    assert bins == {0: (1, 0.0), 1: (1, 1.0), 2: (2, 0.0), 3: (1, 1.0), 7: (2, 0.5), 8: (1, 1.0)}
    r = V.calibration_errors(V.calibration_bins(preds)).first()
    assert r["expected_calibration_error"] == pytest.approx((0.1 + 0.8 + 0.3 + 0.6 + 0.3 + 0.1) / 6) and r["maximum_calibration_error"] == pytest.approx(0.8)


def test_costs_and_fairness(preds):
    r = V.business_costs(V.confusion(preds)).first()
    assert r["total_cost"] == 3 * 5000 + 5500 + 2 * 25000 + 2 * 18000 and r["baseline_cost"] == 4 * 5000 + 4 * 25000
    f = V.fairness(V.fairness_groups(preds, ["g"])).first()
    acc = [np.mean([y == (p >= 0.5) for i, (y, p) in enumerate(SCORES) if i % 2 == k]) for k in (0, 1)]
    assert f["accuracy_disparity"] == pytest.approx(abs(acc[0] - acc[1]))


@pytest.fixture(scope="module")
def cv(spark):
    a, b, c = [0.80, 0.82, 0.78, 0.81, 0.79], [0.75, 0.80, 0.79, 0.76, 0.74], [0.70, 0.71, 0.69, 0.72, 0.70]
    data = [(m, "accuracy", i, s) for m, v in (("a", a), ("b", b), ("c", c)) for i, s in enumerate(v)]
    return spark.createDataFrame(data, "model string, metric string, fold int, score double")


def test_paired_tests(cv):
    t = {(r["model_1"], r["model_2"]): r for r in C.paired_ttest(cv).collect()}
    d = np.array([0.05, 0.02, -0.01, 0.05, 0.05])
    want = d.mean() / (d.std(ddof=1) / math.sqrt(5))
    assert t["a", "b"]["t_statistic"] == pytest.approx(want) and 0.05 < t["a", "b"]["p_value"] < 0.06 and t["a", "b"]["winner"] == "a"
    assert t["a", "c"]["significant"]
    ci = {(r["model_1"], r["model_2"]): r for r in C.confidence_interval(cv).collect()}["a", "b"]
    assert ci["ci_lower"] == pytest.approx(d.mean() - 2.776445 * d.std(ddof=1) / math.sqrt(5), abs=1e-6)
    w = {(r["model_1"], r["model_2"]): r["statistic"] for r in C.wilcoxon(cv).collect()}
    assert w["a", "b"] == 1.0 and w["a", "c"] == 0.0
    f = C.friedman(cv).first()
    assert f["statistic"] == pytest.approx(12 / (5 * 3 * 4) * (14 ** 2 + 11 ** 2 + 5 ** 2) - 3 * 5 * 4) and f["p_value"] == pytest.approx(math.exp(-f["statistic"] / 2))


def test_rankings(spark):
    m = spark.createDataFrame([("x", "accuracy", 0.9), ("x", "roc_auc", 0.6), ("y", "accuracy", 0.8), ("y", "roc_auc", 0.9)], "model string, metric string, value double")
    r = {x["model"]: x for x in C.weighted_ranking(m).collect()}
    assert r["y"]["rank"] == 1 and r["x"]["score"] == pytest.approx((0.9 * 0.15 + 0.6 * 0.25) / 2)
    best = C.select_best(C.weighted_ranking(m), m).first()
    assert (best["recommended_model"], best["status"], best["confidence"]) == ("y", "success", 0.5)


def test_drift_of_equal_sets_is_zero(spark, pieces):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("v"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"), F.lit("some words here").alias("t"))
    assert D.ks(df, df, ["v"]).first()["ks_statistic"] == 0.0 and D.ks(df, df, ["v"]).first()["p_value"] == 1.0
    assert D.psi_numeric(df, df, ["v"]).first()["psi"] == 0.0
    sides = D.category_sides(df, df, ["c"])
    assert D.psi_categorical(sides).first()["psi"] == 0.0 and D.chi2(sides).first()["chi2_statistic"] == 0.0 and D.category_changes(sides).count() == 0
    assert D.text_divergence(df, df, "t").first()["js_divergence"] == pytest.approx(0.0)


def test_drift_of_shifted_sets(spark, pieces):
    ref = spark.range(400).select(F.col("id").cast("double").alias("v"), F.lit("red blue").alias("t"))
    new = spark.range(400).select((F.col("id") + 200).cast("double").alias("v"), F.lit("red green").alias("t"))
    assert D.ks(ref, new, ["v"]).first()["ks_statistic"] == pytest.approx(0.5)
    hr, edges = np.histogram(np.arange(400.0), bins=20)
    hn, _ = np.histogram(np.arange(200.0, 600.0), bins=edges)
    p, q = np.where(hr == 0, 1e-10, hr / 400), np.where(hn == 0, 1e-10, hn / 400)
    assert D.psi_numeric(ref, new, ["v"]).first()["psi"] == pytest.approx(float(((q - p) * np.log(q / p)).sum()))
    a, b = D.text_divergence(ref, new, "t").first()[1], D.text_divergence(new, ref, "t").first()[1]
    assert a == pytest.approx(b) and 0.3 < a < 0.4
    rep = {r["feature"]: r for r in D.report(ref, new, ["v"], text=["t"]).collect()}
    assert rep["v"]["drift_detected"] and rep["t"]["drift_detected"]
    assert {r["error"] for r in D.report(ref, new.limit(50), ["v"]).collect()} == {"insufficient samples"}


def test_feature_types(spark):
    df = spark.range(100).select("id", F.concat(F.lit("c"), F.col("id") % 4).alias("cat"), F.concat(F.lit("u"), "id").alias("uniq"), F.repeat(F.lit("x"), 30).alias("long"))
    assert dict(rows(D.feature_types(df).select("feature", "type"))) == {"id": "numerical", "cat": "categorical", "uniq": "text", "long": "text"}


def test_trend_and_degradation(spark):
    t0 = datetime(2024, 1, 1)
    hist = spark.createDataFrame([("m", "accuracy", t0 + timedelta(days=i), 0.9 - 0.02 * i) for i in range(6)], "model string, metric string, ts timestamp_ntz, value double")
    r = N.trend(hist, "2024-01-07", 7).first()
    assert r["slope"] == pytest.approx(-0.02) and r["trend_direction"] == "declining" and r["trend_strength"] == "strong" and r["p_value"] < 1e-6
    base = N.baseline(hist.where(F.col("ts") == F.lit(t0)))
    cur = spark.createDataFrame([("m", "accuracy", 0.8)], "model string, metric string, value double")
    d = N.degradation(cur, base).first()
    assert d["overall_degradation"] == pytest.approx(1 / 9) and d["severity"] == "critical"
    status = N.monitoring_status(hist.select("model").distinct(), base, cur, N.degradation(cur, base), N.trend(hist, "2024-01-07", 7))
    assert [r["action"] for r in N.recommendations(status).orderBy("position").collect()] == ["immediate_investigation", "retrain_model", "monitor_trend", "check_data_drift"]


def test_sustained_and_cooldown(spark, pieces):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t0 + timedelta(minutes=5 * i), i, 0.5 if i == 4 else 0.9) for i in range(10)], "k string, ts timestamp_ntz, id int, v double")
    got = [(r["rows"], r["minutes"]) for r in N.sustained(df, "k", "ts", "id", F.col("v") > 0.8, 15).orderBy("started").collect()]
    assert got == [(4, 15.0), (5, 20.0)]
    sent = [r["sent_at"] for r in N.cooldown(df, ["k"], "ts", 0.25, 5).orderBy("sent_at").collect()]
    assert sent == [t0 + timedelta(minutes=m) for m in (0, 15, 30, 45)]
    later = N.cooldown(df, ["k"], "ts", 0.25, 5, spark.createDataFrame([("k", t0 - timedelta(minutes=5))], "k string, sent_at timestamp_ntz"))
    assert [r["sent_at"] for r in later.orderBy("sent_at").collect()] == [t0 + timedelta(minutes=m) for m in (10, 25, 40)]


def test_cooldown_of_long_and_many_keys_equals_the_greedy_choice(spark, pieces):
    rng = np.random.default_rng(7)
    t0, raised = datetime(2024, 1, 1), []
    for k, n in (("long", 3000), ("short", 3), (None, 40), ("gaps", 200)):
        minutes = np.sort(rng.integers(0, 40_000 if k == "gaps" else 5 * n, n))
        raised += [(k, "x", t0 + timedelta(minutes=int(m))) for m in minutes]
    want, last = [], {}
    for k, _, t in sorted(raised, key=lambda r: (str(r[0]), r[2])):
        slot = t0 + timedelta(minutes=int((t - t0).total_seconds() // 60) // 5 * 5)
        if k not in last or slot >= last[k] + timedelta(minutes=30):
            last[k] = slot
            want.append((k, slot))
    got = N.cooldown(spark.createDataFrame(raised, "k string, name string, ts timestamp_ntz"), ["k", "name"], "ts", 0.5, 5)
    assert got.columns == ["k", "name", "raised", "sent_at"]
    found = got.collect()
    assert sorted(((r["k"], r["sent_at"]) for r in found), key=str) == sorted(want, key=str)
    assert {r["k"]: r["raised"] for r in found} == {"long": 3000, "short": 3, None: 40, "gaps": 200}


def test_slots_of_one_key_are_spread_over_tasks(spark, pieces):
    slots = spark.range(100_000).select(F.lit("one").alias("_k"), (F.col("id") * 60_000_000).alias("_slot"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    due = N._next_due(slots, 3_600_000_000)
    held = due.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) >= 6 and max(r["count"] for r in held) < 40_000
    assert due.where(F.col("_next") - F.col("_slot") != 3_600_000_000).count() == 0 and due.count() == 100_000 - 60


def test_splits(spark, pieces):
    df = spark.range(103).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").alias("ts"))
    parts = {(r["y"], r["part"]): r["count"] for r in M.stratified_split(df, "key", "y").groupBy("y", "part").count().collect()}
    assert parts == {(0, "test"): 14, (0, "train"): 54, (1, "test"): 7, (1, "train"): 28}
    sizes = [r["count"] for r in M.time_blocks(df, "ts", "key", 5).groupBy("block").count().collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 1
    folds = M.stratified_folds(df, "key", "y", 5).groupBy("y", "fold").count()
    assert folds.groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).where("d > 1").count() == 0


def test_registry(spark):
    reg = spark.createDataFrame([(1, "Archived"), (2, "Archived"), (3, "Production"), (4, "Staging")], "version int, stage string")
    assert dict(rows(M.promote(reg, 4))) == {1: "Archived", 2: "Archived", 3: "Archived", 4: "Production"}
    assert dict(rows(M.rollback(reg))) == {1: "Archived", 2: "Production", 3: "Archived", 4: "Staging"}
    first = reg.where("version = 3")
    assert dict(rows(M.rollback(first))) == {3: "Production"}


def test_training_scores_and_repeats(spark):
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") * 7 % 11).cast("double").alias("z"),
                                 (F.col("id") % 10 > 4).cast("double").alias("label"))
    model = M.train_forest(df, ["x", "z"], "label", trees=5, depth=4)
    out = M.score(model, df)
    assert out.where((F.col("label") == 1) != (F.col("predicted_risk") == "high")).count() == 0
    assert out.where("confidence < 0.5 or abs(p_high + p_low - 1) > 1e-9").count() == 0
    again = M.score(M.train_forest(df, ["x", "z"], "label", trees=5, depth=4), df)
    assert out.select("key", "p_high").exceptAll(again.select("key", "p_high")).count() == 0
    imp = M.feature_importance(model, ["x", "z"], spark).first()
    assert imp["feature"] == "x"


def test_governance(spark):
    df = spark.createDataFrame([(1, "call 555-123-4567, pay $1,200 on 01/02/2024 at 10:30"), (2, "nothing")], "id int, t string")
    assert G.anonymize(df, "t").where("id = 1").first()["t"] == "call [PHONE], pay [AMOUNT] on [DATE] at [TIME]"
    who = spark.createDataFrame([(1,)], "s int")
    assert rows(G.erase(df, "id", who).select("id")) == [(2,)] and G.export_subject({"t": (df, "id")}, who).count() == 1
    p = G.pseudonymize(df, ["id"], "salt")
    assert p.select("id").distinct().count() == 2 and len(p.first()["id"]) == 64


def test_models_are_stored_promoted_and_rolled_back(spark, tmp_path):
    from veriloom.operators.registry import ModelRegistry

    data = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(200)], "id int, x double, z double, y double")
    registry = ModelRegistry(spark, str(tmp_path))
    with pytest.raises(ValueError, match="production"):
        registry.load("risk")
    good, poor = M.train_logistic(data, ["x"], "y"), M.train_logistic(data, ["z"], "y")
    assert [registry.register("risk", m, "d1", {"auc": a}) for m, a in ((good, 1.0), (poor, 0.5))] == [1, 2]
    assert rows(registry.versions("risk").select("version", "stage", "metrics"), "version") == [(1, "Staging", '{"auc": 1.0}'), (2, "Staging", '{"auc": 0.5}')]
    registry.promote("risk", 1, "d2")
    registry.promote("risk", 2, "d3")
    assert rows(registry.versions("risk").select("version", "stage"), "version") == [(1, "Archived"), (2, "Production")]

    def answers(version=None):
        out = registry.score("risk", data, version)
        assert {r[0] for r in out.select("model_version").distinct().collect()} == {version or registry.load("risk")[0]}
        return rows(out.select("id", "prediction"), "id")

    want = {v: rows(m.transform(data).select("id", "prediction"), "id") for v, m in ((1, good), (2, poor))}
    assert want[1] != want[2] and answers() == want[2] and answers(1) == want[1]
    assert registry.rollback("risk", "d4") == 1 and answers() == want[1]
    with pytest.raises(ValueError, match="earlier"):
        registry.rollback("risk", "d5")
    with pytest.raises(ValueError, match="version 9"):
        registry.promote("risk", 9, "d6")
    registry.promote("risk", 2, "d7")
    assert rows(registry.history("risk").select("action", "version"), "number") == [
        ("register", 1), ("register", 2), ("promote", 1), ("promote", 2), ("rollback", 1), ("promote", 2)]
    # a writer that was lost before its entry was complete leaves a claim; others go on behind it
    (tmp_path / "risk" / "log" / "0000000006.claim").touch()
    assert registry.register("risk", good, "d8") == 3 and registry.history("risk").agg(F.max("number")).first()[0] == 7
    # the same number cannot be taken twice
    assert not registry._claim("risk", 7, {"action": "archive", "version": 1})
    assert registry.archive("risk", 3, "d9") == 3 and registry.history("other").count() == 0


def test_search_draws_the_same_and_inside_the_ranges():
    drawn = [S.draw(c) for c in range(200)]
    assert drawn == [S.draw(c) for c in range(200)] and drawn != [S.draw(c, seed=1) for c in range(200)]
    for axis, (_, low, high) in S.SPACE.items():
        values = [d[axis] for d in drawn]
        assert low <= min(values) < low + 0.2 * (high - low) and high - 0.4 * (high - low) < max(values) <= high
    assert {d["depth"] for d in drawn} == set(range(3, 11))


def test_halving_finds_the_planted_region_and_stops_losers(spark):
    """The label is the sign of a product, which trees of depth one cannot see: the winner is deeper."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(a * b > 0)) for i, (a, b) in enumerate(x)], "id int, a double, b double, y double")
    space = {**S.SPACE, "depth": ("int", 1, 4), "columns": ("even", 1.0, 1.0)}
    depths = [S.draw(c, space)["depth"] for c in range(6)]
    assert 1 in depths and max(depths) > 1
    out = S.halving_search(df, ["a", "b"], "y", "id", candidates=6, rounds=2, folds=2, space=space).collect()
    by_rung = {r: [x for x in out if x["rung"] == r] for r in (0, 1, 2)}
    assert [len(by_rung[r]) for r in (0, 1, 2)] == [6, 2, 1] and [by_rung[r][0]["rounds"] for r in (0, 1, 2)] == [2, 6, 18]
    for r in (0, 1):
        kept, gone = ([x["auc"] for x in by_rung[r] if x["kept"] == k] for k in (True, False))
        assert min(kept) >= max(gone) and {x["candidate"] for x in by_rung[r] if x["kept"]} == {x["candidate"] for x in by_rung[r + 1]}
    winner = by_rung[2][0]
    assert winner["depth"] > 1 and winner["auc"] > 0.9
    assert all(x["auc"] < winner["auc"] for x in by_rung[0] if x["depth"] == 1)
    with pytest.raises(ValueError):
        S.halving_search(df, ["a", "b"], "y", "id", factor=1)


def test_report_rows_for_features_without_values_and_several_kinds(spark):
    """Nulls and NaN are no values, a column may be asked for as two types, each text column has its own words."""
    ref = spark.createDataFrame([(float(i % 7), "ab"[i % 2], "same words here", None, None) for i in range(200)], "x double, c string, t string, u string, z double")
    new = spark.createDataFrame([(float("nan") if i % 2 else 3.0, "abc"[i % 3], "other", None, None) for i in range(200)], "x double, c string, t string, u string, z double")
    got = {(r["feature"], r["feature_type"]): r for r in D.report(ref, new, ["x", "z"], ["c"], ["t", "u", "c"]).collect()}
    assert len(got) == 6
    for key in (("z", "numerical"), ("u", "text")):
        assert got[key]["error"] == "insufficient samples" and got[key]["drift_score"] == 0.0 and not got[key]["drift_detected"]
    assert got["c", "categorical"]["drift_detected"] and got["t", "text"]["drift_detected"] and got["x", "numerical"]["drift_detected"]
    alone = D.ks(ref, new, ["x"]).join(D.psi_numeric(ref, new, ["x"]), "feature").join(D.moments(ref, new, ["x"]), "feature").first()
    both = D.numeric_details(D.histograms(ref, new, ["x", "z"], ["c"], ["t"])).first()
    assert {k: both[k] for k in ("n_ref", "n_new", "ks_statistic", "p_value", "psi")} == {k: alone[k] for k in ("n_ref", "n_new", "ks_statistic", "p_value", "psi")}
    js = D.text_divergence(ref, new, "t").first()["js_divergence"] / D.JS_LIMIT
    assert got["t", "text"]["drift_score"] == pytest.approx(max(js, D.text_length_shift(ref, new, "t").first()["length_shift"] / D.LENGTH_LIMIT))


def test_security_rules(spark):
    at = datetime(2024, 1, 1)
    events = [(i, at + timedelta(seconds=40 * i), "u", "x", i < 7, 0, False) for i in range(9)]  # seven failures within five minutes
    events += [(20, at, "v", "y", True, 10_001, False), (21, at, None, "y", True, 10_000, True), (22, at, "w", None, None, None, None)]
    events += [(100 + i, at + timedelta(milliseconds=i), "z", "many", False, 1, False) for i in range(1002)]
    df = spark.createDataFrame(events, "id int, ts timestamp, user string, ip string, bad boolean, n int, admin boolean")
    got = {(r["rule"], r["id"], r["observed"]) for r in N.security_alerts(df, "id", "ts", "user", "ip", F.col("bad"), F.col("n"), F.col("admin")).collect()}
    assert got == {("Unauthorized Access Attempt", 5, 6), ("Unauthorized Access Attempt", 6, 7), ("Suspicious API Usage", 1100, 1001),
                   ("Suspicious API Usage", 1101, 1002), ("Data Breach Indicator", 20, 10_001), ("Privilege Escalation", 21, 1)}


def test_drift_by_period_equals_each_period_alone(spark):
    rng = np.random.default_rng(8)
    ref = spark.createDataFrame([(float(x), str(c)) for x, c in zip(rng.normal(0, 1, 2000), rng.choice(["a", "b", "c"], 2000))], "x double, c string")
    data = [(d, float(x), str(c)) for d in range(4) for x, c in zip(rng.normal(d / 2, 1, 300), rng.choice(["a", "b", "z"][:2 + (d > 1)], 300))]
    new = spark.createDataFrame(data + [(0, None, None), (1, float("nan"), "a"), (9, 0.1, "b"), (8, None, None)], "d int, x double, c string")
    got = {(r["period"], r["feature"]): r for r in D.psi_by_period(ref, new, F.col("d"), ["x"], ["c"]).collect()}
    assert set(got) == {(d, f) for d in (0, 1, 2, 3, 9) for f in ("x", "c")}
    for d in (0, 1, 2, 3, 9):
        part = new.where(F.col("d") == d)
        want = D.psi_numeric(ref, part, ["x"]).first()["psi"], D.psi_categorical(D.category_sides(ref, part, ["c"])).first()["psi"]
        assert (got[d, "x"]["psi"], got[d, "c"]["psi"]) == pytest.approx(want)
    assert not got[9, "x"]["drift_detected"] and got[9, "x"]["psi"] > 0.2 and got[3, "x"]["drift_detected"] and got[3, "c"]["drift_detected"]
    counts = {r["period"]: r["features_with_drift"] for r in D.features_with_drift(D.psi_by_period(ref, new, F.col("d"), ["x"], ["c"])).collect()}
    assert counts == {d: sum(r["drift_detected"] for (e, _), r in got.items() if e == d) for d in (0, 1, 2, 3, 9)} and counts[3] == 2
    assert D.psi_by_period(ref, new.limit(0), F.col("d"), ["x"], ["c"]).count() == 0


def test_models_score_in_a_session_that_has_observed_a_metric(spark):
    """A training summary holds the session, which no task can take once it keeps observations."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    df = spark.range(40).select("id", (F.col("id") / 10.0).alias("x"), (F.col("id") >= 20).cast("double").alias("label"))
    for model in (M.train_logistic(df, ["x"], "label"), M.train_forest(df, ["x"], "label", trees=3, depth=3),
                  M.train_network(df, ["x"], "label", hidden=(4,), rounds=5)):
        assert M.score(model, df).count() == 40
        assert M.score(model, df).where("p_high between 0 and 1").count() == 40


def _claims(spark):
    return spark.range(400).select("id", (F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"),
                                   (F.col("id") % 37 > 18).cast("double").alias("label"))


def _accuracy(scored):
    hit = (F.col("predicted_risk") == F.when(F.col("label") == 1, "high").otherwise("low")).cast("double")
    return scored.agg(F.avg(hit).alias("value")).select(F.lit("accuracy").alias("metric"), "value")


def test_permuted_features_share_one_numbering_and_one_base_score(spark, monkeypatch):
    df, numbered = _claims(spark), []
    model = M.train_logistic(df, ["x", "z"], "label", rounds=5)
    number = M.row_numbers
    monkeypatch.setattr(M, "row_numbers", lambda *a: numbered.append(a[0].columns) or number(*a))
    out = M.permutation_importance(model, df, ["x", "z"], "id", _accuracy)
    assert len(numbered) == 3
    drops = {r["feature"]: r["drop"] for r in out.collect()}
    assert drops["x"] > 0.2 and abs(drops["z"]) < 0.1
    # the drop of a feature is that of its own shuffled values
    a = number(df.withColumn("_h", M.hashed("id")), [], ["_h", "id"], "_rn").drop("_h", "x")
    b = number(df.select("id", "x").withColumn("_h", M.hashed("id", "x")), [], ["_h", "id"], "_rn").select("_rn", "x")
    want = _accuracy(M.score(model, df)).first()["value"] - _accuracy(M.score(model, a.join(b, "_rn"))).first()["value"]
    assert drops["x"] == pytest.approx(want)


def test_cross_validation_draws_its_folds_once(spark, monkeypatch):
    drawn, kept = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: drawn.append(name) or kept(df, name))
    df = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 4)) for i in range(200)], "id int, x double, label double")
    out = M.cross_validate(df, lambda d: M.train_logistic(d, ["x"], "label", rounds=5), lambda s: s.agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("n")),
                           "id", "label", folds=4, repeats=2)
    got = {(r["repeat"], r["fold"], r["part"]): r["score"] for r in out.collect()}
    assert got == {(r, f, p): n for r in range(2) for f in range(4) for p, n in (("train", 150.0), ("test", 50.0))}
    assert drawn == ["folds", "folds"]
