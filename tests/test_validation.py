"""Schema rules and data quality on the small samples."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from veriloom.operators import quality as Q
from veriloom.operators import schema as S

CLAIMS = "claim_id string, claim_amount double, claim_type string, customer_id string, customer_age int, policy_duration int, region string, claim_date string, risk_level string"


@pytest.fixture(scope="module")
def valid(spark):
    return spark.createDataFrame([("C1", 1500.0, "auto", "P1", 30, 12, "north", "2024-01-15", "low"),
                                  ("C2", 2500.0, "home", "P2", 45, 24, "south", "2024-01-16", "high")], CLAIMS)


@pytest.fixture(scope="module")
def faulty(spark):
    return spark.createDataFrame([
        ("C001", 1500.0, 30, "Valid claim", "north"), ("C002", -500.0, 200, "", "south"), ("C003", 50000.0, 35, "A" * 2000, "EAST"),
        ("C002", 2500.0, 45, "Normal claim", "west"), ("C004", None, 25, None, "unknown")],
        "claim_id string, claim_amount double, customer_age int, claim_description string, region string")


def test_valid_sample_has_no_violation(valid):
    assert S.validation_report(valid, S.CLAIMS_SCHEMA).where("not is_valid").count() == 0


def test_violations_are_counted_per_rule(valid):
    bad = valid.withColumns({"claim_amount": F.lit(-1.0), "claim_type": F.lit("boat"), "customer_age": F.lit(130), "claim_date": F.lit("soon"),
                             "region": F.lit(None).cast("string"), "extra": F.lit(1)}).drop("customer_id")
    report = {r["field"]: r for r in S.validation_report(bad, S.CLAIMS_SCHEMA).collect()}
    assert {f for f, r in report.items() if not r["is_valid"]} == {"claim_amount", "claim_type", "customer_age", "claim_date", "region", "customer_id"}
    assert report["customer_id"]["errors"] == "missing" and report["extra"]["warning"] == "unexpected"
    assert report["claim_amount"]["errors"] == "min" and report["claim_amount"]["n_bad"] == 2


def test_pattern_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("C1x",), ("xC1",), (None,)], "c string")
    assert S.rule_counts(df, [S.FieldRule("c", pattern=r"C\d", nullable=True)]).first()["n_bad"] == 1


def test_schema_round_trip(tmp_path):
    path = str(tmp_path / "schema.yaml")
    S.export_schema(S.CLAIMS_SCHEMA, path)
    assert S.load_schema(path) == S.CLAIMS_SCHEMA
    struct = S.to_struct(S.CLAIMS_SCHEMA)
    assert struct["claim_amount"].metadata["min_value"] == 0 and struct["customer_age"].dataType.simpleString() == "bigint"
    assert S.schema_summary(S.CLAIMS_SCHEMA)["optional"] == ["claim_description", "customer_segment", "risk_level"]


def test_request_rules(spark):
    cols = ("claim_id string, claim_amount double, claimant_age int, policy_duration_months int, previous_claims int, region string, claim_type string, "
            "day_of_week string, claim_description string, policy_premium double, deductible_amount double")
    df = spark.createDataFrame([("C1", 10.0, 40, 1, 0, "North", "Auto", "Mon", "  a long enough text ", None, 0.0),
                                (" ", 0.0, 121, -1, -1, "north", "Boat", "Someday", " short ", 0.0, -1.0)], cols)
    good, bad = S.split_quarantine(df, S.request_rules())
    assert good.count() == 1
    assert bad.first()["violations"] == list(S.request_rules())


def test_json_validation(spark):
    df = spark.createDataFrame([('{"k": 5}',), ('{"k": null}',), ("{oops",)], "j string")
    out = S.parse_json(df, "j", [S.FieldRule("k", "integer")])
    assert [(r["k"], r["_corrupt"]) for r in out.collect()] == [(5, None), (None, None), (None, "{oops")]


def test_quality_sample_scores_80(faulty):
    found = {(r["issue"], r["feature"]): (r["severity"], r["affected"]) for r in Q.issues(faulty).collect()}
    assert found == {("missing", "claim_amount"): ("high", 1), ("missing", "claim_description"): ("high", 1),
                     ("duplicate_ids", "claim_id"): ("critical", 1), ("negative_values", "claim_amount"): ("high", 1)}
    report = Q.report(faulty, "sample").collect()
    assert len(report) == 4 and {r["quality_score"] for r in report} == {80.0}


def test_assessment_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    data = [(i, i % 40, float(i % 7) if i % 3 else None, "x") for i in range(400)] + [(1000, 5, 1e6, None)] * 2
    df = spark.createDataFrame(data, "claim_id long, customer_age int, amount double, note string").repartition(4)
    found, total = Q.assess(df.mapInArrow(count, df.schema))
    got = {(r["issue"], r["feature"]): r["affected"] for r in found.collect()}
    assert (total, seen.value) == (402, 402)
    assert got[("duplicate_rows", None)] == 1 and got[("duplicate_ids", "claim_id")] == 1 and got[("missing", "amount")] == 134
    assert Q.score(found, F.lit(total)).first()["total_issues"] == len(got)


def test_assessment_of_nothing(spark):
    found, total = Q.assess(spark.createDataFrame([], "claim_id long, x double, t string"))
    assert total == 0 and found.count() == 0


def test_text_profile_takes_the_smallest_of_the_most_frequent(spark):
    long = "x" * 40
    data = [(long + "b", f"u{i}" if i else "é", long + str(i % 4), None) for i in range(12)] + [(long + "a", "z", "rare", None)] * 12 + [(None, None, None, None)]
    df = spark.createDataFrame(data, "a string, b string, c string, d string").repartition(5)
    got = {r["feature"]: r for r in Q.profile_text(df).collect()}
    want = {}
    for i, c in enumerate("abc"):
        values = [r[i] for r in data if r[i] is not None]
        top = max(values.count(v) for v in set(values))
        want[c] = (len(values), len(set(values)), min(v for v in set(values) if values.count(v) == top), top, min(map(len, values)), max(map(len, values)))
    assert {c: (r["non_null"], r["distinct_values"], r["most_frequent"], r["frequency"], r["min_length"], r["max_length"]) for c, r in got.items()} == want
    assert want["a"][2] == long + "a"
    once = Q.profile_text(df.where("b <> 'z'").select("b")).first()
    assert (once["frequency"], once["most_frequent"]) == (1, "u1")
    counts = {(r["feature"], r["value"]): r["n"] for r in Q.category_counts(df, limit=6).collect()}
    assert counts[("a", long + "a")] == 12 and counts[("b", "(6 or more values)")] == 13 and counts[("c", "rare")] == 12 and len(counts) == 8
    assert Q.category_counts(df.limit(0)).count() == 0 and Q.profile_text(df.limit(0)).count() == 0


def test_duplicate_rows_by_digest(spark):
    data = [("ab", "c", None), ("a", "bc", None), (None, "abc", b"c"), ("abc", None, b"c"), ("a", "bc", None), ("-", None, None), (None, "-", None)]
    r = Q.duplicate_rows(spark.createDataFrame(data, "a string, b string, c binary")).first()
    assert (r["rows"], r["duplicates"]) == (7, 1)


def test_report_without_issues_keeps_one_row(spark):
    r = Q.report(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "clean").collect()
    assert len(r) == 1 and r[0]["severity"] is None and r[0]["quality_score"] == 100.0


def test_recommendations(faulty):
    found = Q.issues(faulty)
    got = [r[0] for r in Q.recommendations(found, F.lit(45.0)).collect()]
    assert len(got) == 5 and set(Q.SCORE_MESSAGES.values()) <= set(got)


def test_nan_counts_as_missing_and_outliers_ignore_it(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (float("nan"),), (None,)], "x double")
    assert Q.missing_counts(df).first()["missing"] == 2
    o = Q.outliers(df).first()
    assert (o["n"], o["outliers"]) == (21, 1)
    assert Q.outliers(df.limit(5)).count() == 0


def test_numeric_text(spark):
    df = spark.createDataFrame([("1",), ("-2.5e3",), (".5",), ("1d",), ("nan",), (None,)], "t string")
    r = Q.numeric_text(df).first()
    assert (r["n"], r["numeric"], r["should_be_numeric"]) == (5, 3, False)


def test_source_consistency(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "w"), (4, "q")], "k int, v string")
    assert dict(rows(Q.source_consistency(a, b, ["k"], ["v"]))) == {"only_in_first": 1, "only_in_second": 1, "differs_v": 1}
