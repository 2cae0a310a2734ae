"""Cases that once crashed, lost rows or changed values."""

from decimal import Decimal

import pytest

from veriloom.operators import drift as D
from veriloom.operators import features as E
from veriloom.operators import prep as R
from veriloom.operators import quality as Q
from veriloom.operators import schema as S
from veriloom.operators import text as X


def test_imputing_keeps_large_whole_numbers_and_decimals(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, Decimal("1.10"), 1), (None, None, None), (big, Decimal("1.10"), 2)], "a long, b decimal(10,2), c int")
    out = R.apply_imputer(df, R.fit_imputer(df, {"a": "mode", "b": "mean", "c": "mean"}), ["a", "b", "c"])
    assert [t for _, t in out.dtypes] == ["bigint", "decimal(10,2)", "double"]
    assert sorted(map(tuple, out.collect())) == [(big, Decimal("1.10"), 1.0), (big, Decimal("1.10"), 1.5), (big, Decimal("1.10"), 2.0)]


def test_more_categories_than_the_limit(spark):
    df = spark.createDataFrame([(i, f"v{i:02d}") for i in range(12)], "id long, c string")
    codes = {r["id"]: r["c"] for r in R.encode_categories(df, "c", "id").collect()}
    assert codes == {i: i for i in range(12)}
    assert len(R.one_hot(df, "c", R.categories(df, "c"), drop_first=False).columns) == 13


def test_drift_of_constant_and_empty_columns(spark):
    ref = spark.createDataFrame([(1.0, "a", float("nan"))] * 200, "x double, c string, n double")
    new = spark.createDataFrame([(2.0, None, 1.0)] * 100 + [(1.0, None, 1.0)] * 100, "x double, c string, n double")
    psi = {r["feature"]: r["psi"] for r in D.psi_numeric(ref, new, ["x"]).collect()}
    assert psi["x"] is not None and psi["x"] > 0.1
    assert D.ks(ref, ref, ["n"]).count() == 0  # NaN is no value
    sides = D.category_sides(ref, new, ["c"])
    assert [r["psi"] for r in D.psi_categorical(sides).collect()] == [None]
    assert D.chi2(sides).count() == 1
    assert D.report(ref, new, ["x"], ["c"]).count() == 2


def test_equal_amounts_have_no_amount_risk(spark):
    df = spark.createDataFrame([(5.0, 45), (5.0, 45), (None, 45)], "amount double, age int")
    got = [r["composite_risk_score"] for r in E.composite_risk(df, "amount", "age").collect()]
    assert got == [0.0, 0.0, None]


def test_components_keep_rows_with_nulls(spark):
    cols = [f"x{i}" for i in range(12)]
    rows = [tuple(None if (i + j) % 10 == 0 else float((i * 7 + j * 3) % 11) for j in range(12)) for i in range(50)]
    out = E.principal_components(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols)
    assert out.count() == 50 and out.columns[:12] == cols and "pca_0" in out.columns
    assert sum(r["x0"] is None for r in out.collect()) == 5


def test_a_gate_without_its_metric_fails(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("b", None), ("other", 3.0)], "metric string, value double")
    got = {r["metric"]: (r["limit"], r["passed"]) for r in S.threshold_gate(metrics, {"a": ("<=", 1), "b": (">", 0), "c": (">", 0)}).collect()}
    assert got == {"a": (1.0, True), "b": (0.0, False), "c": (0.0, False)}


def test_columns_of_many_values_are_named(spark):
    df = spark.createDataFrame([(f"v{i}", "x") for i in range(5)], "many string, few string")
    assert sorted(map(tuple, Q.category_counts(df, limit=3).collect())) == [("few", "x", 5), ("many", "(3 or more values)", 5)]


@pytest.mark.parametrize("limits, kept", [({}, [True, True]), ({"min_chars": 10, "max_chars": 5000}, [False, False]), ({"max_chars": 5000}, [True, False])])
def test_texts_are_cut_only_on_demand(spark, limits, kept):
    df = spark.createDataFrame([("short", 0), ("words " * 2000, 1)], "t string, i int")
    got = [len(r["c"]) > 0 for r in df.select("i", X.clean("t", **limits).alias("c")).orderBy("i").collect()]
    assert got == kept


def test_the_preprocessor_works_its_input_out_once(spark):
    """Steps read what was written; the joins behind an input, and what they send to the driver, are not repeated for each."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(50).selectExpr("id", "cast(id % 7 as double) as x", "concat('t', id % 3) as t", "cast(id % 2 as int) as y")
    fitted = R.Preprocessor("id", "2001-01-01", label="y", outliers="cap").fit(df.mapInArrow(count, df.schema))
    assert seen.value == 50
    assert fitted.transform(df).count() == 50
