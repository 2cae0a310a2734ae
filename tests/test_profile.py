"""Profiles merged from parts."""

import pytest
from pyspark.sql import functions as F

from veriloom.operators import profile as P

SCHEMA = "i int, d double, s string, a array<int>, `x.y` long, t timestamp, b binary"
ROWS = ([(k % 50, float(k) * 1e3 + 1e9, f"v{k % 7}" + "x" * (k % 5), [k % 3], k, None, None) for k in range(600)]
        + [(None, float("nan"), None, None, None, None, b"z"), (1, -0.0, "", [], 0, None, None), (1, 0.0, "", [], 0, None, None)])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def stored_profile(spark, path, parts):
    store = P.ProfileStore(spark, str(path))
    for name, part in parts.items():
        store.add(name, part)
    return store


def test_parts_merge_to_the_profile_of_the_whole(spark, df, tmp_path):
    whole = stored_profile(spark, tmp_path / "whole", {"all": df})
    cut = {f"p{n}": df.where(c) for n, c in enumerate(("`x.y` < 100", "`x.y` >= 100 and `x.y` < 101", "`x.y` >= 101", "`x.y` is null", "false"))}
    parts = stored_profile(spark, tmp_path / "parts", cut)
    parts.add("p0", cut["p0"])  # a part written again counts once
    a, b = ({r["feature"]: r.asDict() for r in s.profile().collect()} for s in (whole, parts))
    assert set(a) == set(b) == set(df.columns)
    for feature, row in a.items():
        for name, value in row.items():
            if name in ("mean", "std", "distinct_estimate") and value is not None:
                assert b[feature][name] == pytest.approx(value, rel=0.01 if name == "distinct_estimate" else 1e-12), (feature, name)
            elif not name.startswith("q"):
                assert b[feature][name] == value, (feature, name)
    assert whole.duplicates().first() == parts.duplicates().first() and parts.duplicates().first()["duplicate_rows"] == 1
    d, s, t = b["d"], b["s"], b["t"]
    numbers = [r[1] for r in ROWS if r[1] == r[1]]
    mean = sum(numbers) / len(numbers)
    assert d["mean"] == pytest.approx(mean) and d["std"] == pytest.approx((sum((x - mean) ** 2 for x in numbers) / (len(numbers) - 1)) ** 0.5)
    assert (d["missing"], d["distinct_values"], d["once"]) == (1, 601, 600)  # NaN is missing, -0.0 is 0.0
    assert (s["missing"], s["distinct_values"], s["min_length"]) == (1, 36, 0) and b["a"]["distinct_values"] == 4
    assert (t["missing"], t["distinct_values"], t["q50"], t["mean"]) == (603, 0, None, None)
    for q in (0.25, 0.5, 0.75):
        below = sum(x <= d[f"q{int(100 * q)}"] for x in numbers) / len(numbers)
        assert abs(below - q) < 0.02
    assert abs(d["distinct_estimate"] - 601) < 60


def test_no_text_is_a_shuffle_key(spark, df):
    text = P.value_counts(df)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(keys) == 1 and "hashpartitioning(feature" in keys[0] and "digest" in keys[0]
    assert P.value_counts(df.limit(0)).count() == 0
    empty = P.summaries(df.limit(0)).where(F.col("rows") == 0)
    assert empty.count() == len(df.columns)
