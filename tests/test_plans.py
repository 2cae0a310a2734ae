"""Physical plans of row-level operators: what must and must not be in them."""

import pytest
from pyspark.sql import functions as F

from veriloom.operators import drift as D
from veriloom.operators import features as E
from veriloom.operators import monitor as N
from veriloom.operators import prep as R
from veriloom.plans import profiles as P

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def claims(spark):
    return P.claims(spark, SF, "claim_id", "customer_id", "claim_amount", "claim_date")


def test_filters_and_columns_reach_the_scan(spark):
    df = P.claims(spark, SF, "claim_id", "claim_date", "claim_status").where("claim_status = 'O'")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in text
    assert "o_totalprice" not in text and "customer" not in text


def test_rank_limits_apply_before_the_shuffle(spark, claims):
    for df in (R.drop_duplicates(claims, ["customer_id"], ["claim_id"]), N.request_stats(P.requests(spark, SF))):
        text = plan(df)
        assert "WindowGroupLimit" in text and ", Partial" in text


def test_ordered_operators_never_gather_the_rows(spark, claims, pieces):
    for df in (E.rolling_mean(claims, "claim_amount", ["claim_date", "claim_id"]),
               E.lag_features(claims, "customer_id", ["claim_date", "claim_id"], "claim_amount", [1]),
               R.forward_fill(claims, ["customer_id"], ["claim_date", "claim_id"], ["claim_amount"])):
        text = plan(df)
        rows = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
        # only the carry table, one row per piece, may be gathered
        assert len(rows) <= (1 if pieces == "many_pieces" else 0), text
        assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("build", [
    lambda s, c: E.recent_count(c, "customer_id", "claim_date", "claim_id"),
    lambda s, c: E.percentile_rank(c, "claim_amount", "claim_id"),
    lambda s, c: E.add_customer_aggregates(c.withColumn("kind", F.lit("a")), "customer_id", "claim_amount", "claim_date", "kind", "claim_id"),
    lambda s, c: R.target_encode(c, "customer_id", R.fit_targets(c, "customer_id", "claim_amount"), "claim_id", "code"),
    lambda s, c: R.cap_outliers(c, ["claim_amount"], R.outlier_bounds(c, ["claim_amount"]))])
def test_no_cross_joins(spark, claims, build):
    text = plan(build(spark, claims))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_drift_report_reads_each_side_once(spark):
    ev = P.events(spark, SF)
    ref, new = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    text = plan(D.histograms(ref, new, ["value"], ["event_type"], ["props"]))
    assert text.count("FileScan parquet") == 2 and text.count("Exchange hashpartitioning") == 1
    assert "events.parquet" not in plan(D.report(ref, new, ["value"], ["event_type"], ["props"]))
