"""Data-quality checks. Checks of one table share as few passes as possible."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.columns import is_number_text, missing, numeric_columns, ratio, string_columns, to_long
from veriloom.functions.ordered import quantiles
from veriloom.operators.profile import row_digest
from veriloom.session import Scratch, materialize, stored

# Thresholds, weights and messages of the assessment.
MISSING_LIMIT = 0.15
DUPLICATE_LIMIT = 0.05
ZERO_LIMIT = 0.50
TEXT_MIN, TEXT_MAX = 5, 1000
MAX_CATEGORIES = 100
NEVER_NEGATIVE = ("amount", "age", "duration", "count", "quantity")
WEIGHTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}
MESSAGES = {
    "missing_data": "Implement missing data handling strategies (imputation, removal, or flagging)",
    "duplicates": "Establish data deduplication processes and unique constraint validations",
    "outliers": "Investigate outlier patterns and implement outlier detection in data pipeline",
    "inconsistency": "Review data collection processes and implement business rule validations",
    "format": "Standardize data formats and implement data type validations",
}
SCORE_MESSAGES = {
    70: "Consider comprehensive data cleaning before model training",
    50: "Review data sources and collection processes - significant quality issues detected",
}

#: Characters by which the most frequent values of a text column are narrowed down before they are compared whole.
PREFIX = 32


def _long(df: DataFrame, columns: Sequence[str], measures: dict[str, "callable"]) -> DataFrame:
    """One aggregate over ``df``; one output row per column with the given measures and ``rows``."""
    return _unfold(df.agg(*_aggregates(columns, measures)), columns, measures)


def _aggregates(columns: Sequence[str], measures: dict[str, "callable"]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"),
            *[fn(c).alias(f"a{i}_{m}") for i, c in enumerate(columns) for m, fn in measures.items()]]


def _unfold(row: DataFrame, columns: Sequence[str], measures: dict[str, "callable"]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"a{i}_{m}").alias(m) for m in measures])
                     for i, c in enumerate(columns)])
    return row.select(F.inline(rows), "rows")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, missing, rows, pct."""
    columns = list(columns or df.columns)
    counts = _long(df, columns, {"missing": lambda c: F.count_if(missing(df, c))})
    return counts.withColumn("pct", ratio(F.col("missing"), F.col("rows")) * 100)


def _missing_issue(pct: Column, limit: float) -> Column:
    return F.when(pct > limit * 100, F.when(pct > 50, "critical").otherwise("high"))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None, limit: float = MISSING_LIMIT) -> DataFrame:
    return missing_counts(df, columns).withColumn("severity", _missing_issue(F.col("pct"), limit))


def missing_summary(df: DataFrame) -> DataFrame:
    m = missing_counts(df)
    return m.agg(F.count_if(F.col("missing") > 0).alias("fields_with_missing"),
                 F.sum("missing").alias("total_missing"), F.avg("pct").alias("average_pct"))


def duplicate_rows(df: DataFrame, limit: float = DUPLICATE_LIMIT) -> DataFrame:
    """Rows beyond the first of each distinct row; nulls are equal, and NaN counts as null.

    Rows are told apart by 128-bit digests, so no value is a shuffle key.
    """
    return _duplicate_digests(df.select(row_digest(df).alias("_row")), limit)


def _duplicate_digests(digests: DataFrame, limit: float) -> DataFrame:
    groups = digests.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    pct = ratio(F.col("duplicates"), F.col("rows")) * 100
    return (groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                       F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
            .withColumn("pct", pct)
            .withColumn("severity", F.when(F.col("duplicates") > 0,
                                           F.when(pct > limit * 100, "high").otherwise("medium"))))


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "id" in c.lower()]


def duplicate_ids(df: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """feature, rows, duplicates per id column; null counts as one value."""
    ids = list(ids if ids is not None else id_columns(df))
    long = to_long(df, [], ids, as_type="string")
    return (long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("feature").agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates")))


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5, min_values: int = 10) -> DataFrame:
    """feature, q1, q3, lower, upper, n; features with too few values are left out."""
    q = quantiles(df, columns, {"q1": 0.25, "q3": 0.75}).where(F.col("n") >= min_values)
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})


def zscore_bounds(df: DataFrame, columns: Sequence[str], limit: float = 3.0, min_values: int = 10) -> DataFrame:
    """The values at which |z| reaches the limit, with the population deviation."""
    s = _long(df, columns, {"n": lambda c: F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))),
                            "mean": lambda c: F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))),
                            "sd": lambda c: F.stddev_pop(F.nanvl(F.col(c).cast("double"), F.lit(None)))})
    s = s.where(F.col("n") >= min_values)
    return s.withColumns({"lower": F.col("mean") - limit * F.col("sd"), "upper": F.col("mean") + limit * F.col("sd")})


def bounds_lookup(bounds: DataFrame) -> Column:
    """Bounds by feature as one scalar sub-query (one entry per column)."""
    entry = F.struct(F.col("feature"), F.struct("lower", "upper"))
    return bounds.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "IQR",
             k: float = 1.5) -> DataFrame:
    """feature, n, lower, upper, outliers, pct, severity."""
    columns = list(columns or numeric_columns(df))
    bounds = zscore_bounds(df, columns) if method == "zscore" else iqr_bounds(df, columns, k)
    look = bounds_lookup(bounds)
    counts = _long(df, columns, {
        "n": lambda c: F.count_if(~missing(df, c)),
        "lower": lambda c: F.max(look[c]["lower"]),
        "upper": lambda c: F.max(look[c]["upper"]),
        "outliers": lambda c: F.count_if(~missing(df, c) & ((F.col(c) < look[c]["lower"]) | (F.col(c) > look[c]["upper"])))})
    pct = ratio(F.col("outliers"), F.col("n")) * 100
    return (counts.where(F.col("lower").isNotNull()).drop("rows").withColumn("pct", pct)
            .withColumn("severity", F.when(pct > 10, F.when(pct > 20, "high").otherwise("medium"))))


def numeric_text(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.8) -> DataFrame:
    """String columns most of whose values are numbers."""
    columns = list(columns or string_columns(df))
    c = _long(df, columns, {"n": F.count, "numeric": lambda x: F.count_if(is_number_text(F.col(x)))})
    return c.drop("rows").withColumn("should_be_numeric", F.col("numeric") > limit * F.col("n"))


def invalid_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns named like dates with values that do not parse."""
    if columns is None:
        columns = [c for c in string_columns(df) if "date" in c.lower() or "time" in c.lower()]
    bad = {"n": F.count, "invalid": lambda x: F.count_if(F.col(x).isNotNull() & F.try_to_timestamp(F.col(x)).isNull())}
    return _long(df, list(columns), bad).drop("rows")


def type_distribution(df: DataFrame) -> DataFrame:
    """Number of columns per type and the values they hold."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    kind = F.create_map(*[F.lit(x) for kv in kinds for x in kv])
    return (_long(df, df.columns, {"n": F.count}).groupBy(kind[F.col("feature")].alias("data_type"))
            .agg(F.count(F.lit(1)).alias("columns"), F.sum("n").alias("non_null")))


def negative_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if any(w in c.lower() for w in NEVER_NEGATIVE)]


def negatives(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or negative_columns(df))
    return _long(df, columns, {"affected": lambda c: F.count_if(F.col(c) < 0)})


def zeros(df: DataFrame, columns: Sequence[str] | None = None, limit: float = ZERO_LIMIT) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    z = _long(df, columns, {"affected": lambda c: F.count_if(F.col(c) == 0)})
    share = ratio(F.col("affected"), F.col("rows"))
    return z.withColumns({"share": share, "excessive": share > limit})


def consistency_severity(affected: Column, rows: Column) -> Column:
    return F.when(affected > rows * 0.1, "high").otherwise("medium")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))

    def value(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None))
    base = _long(df, columns, {
        "non_null": lambda c: F.count(value(c)), "nulls": lambda c: F.count_if(value(c).isNull()),
        "mean": lambda c: F.avg(value(c)), "std": lambda c: F.stddev_samp(value(c)),
        "min": lambda c: F.min(value(c)), "max": lambda c: F.max(value(c)),
        "zeros": lambda c: F.count_if(F.col(c) == 0), "negatives": lambda c: F.count_if(F.col(c) < 0)})
    q = quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, distinct=True).drop("n")
    return (base.join(q, "feature", "left")
            .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)).cast("long"))
            .withColumn("cardinality", ratio(F.col("distinct_values"), F.col("rows"))))


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) of string columns."""
    return (to_long(df, [], columns, as_type="string").where(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


def _text_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, digest, prefix) of the string columns, a row per value."""
    long = to_long(df, [], columns, as_type="string").where(F.col("value").isNotNull())
    return long.withColumns({"digest": F.unhex(F.md5("value")), "prefix": F.substring("value", 1, PREFIX)})


def profile_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lengths, distinct values and the most frequent value (the smallest one among ties).

    Values are counted by 128-bit digests, so no text is a shuffle key. Of the
    values that occur most often those with the smallest beginning are looked
    up in the data again, and each task gives out the smallest of them.
    """
    rows = _text_rows(df, list(columns or string_columns(df)))
    hist = stored(rows.groupBy("feature", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.length("value")).alias("len"), F.first("prefix").alias("prefix")), "texts")
    stats = hist.groupBy("feature").agg(
        F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"),
        (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.min("len").alias("min_length"), F.max("len").alias("max_length"), F.max("n").alias("frequency"))
    # from here on a row per column, but for ``tied``
    first = materialize(hist.join(F.broadcast(stats.select("feature", "frequency")), "feature").where(F.col("n") == F.col("frequency"))
                        .groupBy("feature", "frequency").agg(F.min("prefix").alias("prefix")))
    tied = hist.join(F.broadcast(first), ["feature", "prefix"]).where((F.col("n") == F.col("frequency")) & (F.col("frequency") > 1))
    found = rows.join(F.broadcast(first), ["feature", "prefix"])
    # if nothing occurs twice, all values tie and there is nothing to join
    repeated = found.where(F.col("frequency") > 1).join(tied.select("feature", "digest"), ["feature", "digest"], "left_semi")
    smallest = (found.where(F.col("frequency") == 1).select("feature", "value").unionAll(repeated.select("feature", "value"))
                .groupBy("feature").agg(F.min("value").alias("most_frequent")))
    return stats.join(F.broadcast(smallest), "feature").select(*stats.columns[:-1], "most_frequent", "frequency")


def category_counts(df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_CATEGORIES) -> DataFrame:
    """Value counts of the columns with fewer than ``limit`` values; each other column has one row with the number of its values.

    Digests tell how many values a column has; only columns with few of them are grouped by value.
    """
    names = list(columns or string_columns(df))
    sizes = materialize(_text_rows(df, names).groupBy("feature", "digest").agg(F.count(F.lit(1)))
                        .groupBy("feature").agg(F.count(F.lit(1)).alias("_d")))
    few = {r["feature"] for r in sizes.where(F.col("_d") < limit).collect()}  # names of columns
    many = sizes.where(F.col("_d") >= limit).select("feature", F.lit(f"({limit} or more values)").alias("value"), F.col("_d").alias("n"))
    return text_counts(df, [c for c in names if c in few]).unionAll(many) if few else many


def dataset_stats(df: DataFrame) -> DataFrame:
    filled = reduce(lambda a, b: a + b, [F.when(missing(df, c), 0).otherwise(1) for c in df.columns])
    n = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(n).alias("columns"),
                  (ratio(F.sum(filled), F.count(F.lit(1)) * n) * 100).alias("completeness"))


def _issue(severity, category: str, name: str, affected) -> list[Column]:
    return [severity.alias("severity"), F.lit(category).alias("category"), F.lit(name).alias("issue"),
            F.col("feature"), affected.cast("long").alias("affected")]


def issues(df: DataFrame, ids: Sequence[str] | None = None, method: str = "IQR") -> DataFrame:
    """All issues found: severity, category, issue, feature, affected."""
    return assess(df, ids, method)[0]


def assess(df: DataFrame, ids: Sequence[str] | None = None, method: str = "IQR") -> tuple[DataFrame, int]:
    """The issues of ``df`` (a few rows per column, stored) and its number of rows.

    ``df`` is read once. That pass writes the numbers, the ids and a digest of
    each row, and counts all that single rows show as observed metrics on the
    way. Duplicates and outliers then read the columns they need of the written
    table, which is deleted in the end. An empty table has no issues.
    """
    scratch = Scratch()
    try:
        with scratch:
            found, rows = _assess(df, list(ids if ids is not None else id_columns(df)), method)
            found = materialize(found)
    finally:
        scratch.remove(df.sparkSession)
    return found, rows


def _assess(df: DataFrame, ids: list[str], method: str) -> tuple[DataFrame, int]:
    numbers, texts = numeric_columns(df), string_columns(df)
    dates = [c for c in texts if "date" in c.lower() or "time" in c.lower()]
    measures = {
        "missing": lambda c: F.count_if(missing(df, c)),
        "negative": lambda c: F.count_if(F.col(c) < 0) if c in numbers else F.lit(0),
        "zero": lambda c: F.count_if(F.col(c) == 0) if c in numbers else F.lit(0),
        "filled": F.count,
        "numeric": lambda c: F.count_if(is_number_text(F.col(c))) if c in texts else F.lit(0),
        "undated": lambda c: F.count_if(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull())
                   if c in dates else F.lit(0),
    }
    never = F.col("feature").isin(negative_columns(df)) if negative_columns(df) else F.lit(False)
    counted = Observation()
    narrow = stored(df.observe(counted, *_aggregates(df.columns, measures)).select(
        row_digest(df).alias("_row"), *[c for c in df.columns if c in numbers or c in ids]), "assess")
    row = counted.get
    kinds = ", ".join(f"{name} long" for name in row)
    seen = _unfold(df.sparkSession.createDataFrame([tuple(row.values())], kinds), df.columns, measures)  # a number per column and check
    pct = ratio(F.col("missing"), F.col("rows")) * 100
    none = F.lit(None).cast("string")

    def found(name: str, category: str, severity: Column, affected: Column) -> Column:
        return F.struct(severity.alias("severity"), F.lit(category).alias("category"), F.lit(name).alias("issue"),
                        F.col("feature").alias("feature"), affected.cast("long").alias("affected"))
    one_pass = seen.select(F.explode(F.array(
        found("missing", "missing_data", _missing_issue(pct, MISSING_LIMIT), F.col("missing")),
        found("negative_values", "inconsistency",
              F.when(never & (F.col("negative") > 0), consistency_severity(F.col("negative"), F.col("rows"))), F.col("negative")),
        found("excessive_zeros", "inconsistency",
              F.when(F.col("zero") > F.col("rows") * ZERO_LIMIT, consistency_severity(F.col("zero"), F.col("rows"))), F.col("zero")),
        found("should_be_numeric", "format",
              F.when((F.col("filled") > 0) & (F.col("numeric") > 0.8 * F.col("filled")), "medium"), F.lit(0)),
        found("invalid_date_format", "format", F.when(F.col("undated") > 0, "medium"), F.lit(0)))).alias("i")).select("i.*")
    dup = _duplicate_digests(narrow.select("_row"), DUPLICATE_LIMIT).select(
        F.col("severity"), F.lit("duplicates").alias("category"), F.lit("duplicate_rows").alias("issue"),
        none.alias("feature"), F.col("duplicates").cast("long").alias("affected"))
    parts = [one_pass, dup]
    if ids:
        parts.append(duplicate_ids(narrow, ids).select(
            *_issue(F.when(F.col("duplicates") > 0, "critical"), "duplicates", "duplicate_ids", F.col("duplicates"))))
    if numbers:
        parts.append(outliers(narrow, numbers, method).select(
            *_issue(F.col("severity"), "outliers", "outliers", F.col("outliers"))))
    return reduce(DataFrame.unionByName, parts).where(F.col("severity").isNotNull()), row["rows"]


def score(found: DataFrame, total: Column) -> DataFrame:
    """100 minus the weighted, scaled deductions of the issues, kept within 0..100.

    ``total`` is the number of records as a column or scalar sub-query.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    share = F.least(ratio(F.col("affected") * 2, F.col("_n")), F.lit(1.0))
    deduction = F.coalesce(weight[F.col("severity")], F.lit(2)) * share
    lost = found.withColumn("_n", total).agg(F.coalesce(F.sum(deduction), F.lit(0.0)).alias("lost"),
                                             F.count(F.lit(1)).alias("total_issues"))
    return lost.select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("lost"))).alias("quality_score"),
                       "total_issues")


def recommendations(found: DataFrame, quality_score: Column) -> DataFrame:
    """One message per issue category present, and more for low scores."""
    message = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    by_category = found.select("category").distinct().select(message[F.col("category")].alias("recommendation"))
    low = [F.struct(F.lit(limit).alias("below"), F.lit(text).alias("recommendation"))
           for limit, text in SCORE_MESSAGES.items()]
    by_score = (found.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*low)).alias("r"))
                .where(quality_score < F.col("r.below")).select("r.recommendation"))
    return by_category.unionByName(by_score)


def report(df: DataFrame, name: str, ids: Sequence[str] | None = None) -> DataFrame:
    """Issues of a data set, each with the set's record count and overall score.

    A data set without issues gives one row with a null severity.
    """
    found, rows = assess(df, ids)
    total = F.lit(rows).cast("long")
    overall = score(found, total).select("quality_score").scalar()
    nothing = found.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema])
    return found.unionByName(nothing).select(
        F.lit(name).alias("dataset"), "severity", "category", "issue", "feature", "affected",
        total.alias("total_records"), overall.alias("quality_score"))


def source_consistency(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys on one side only and, per column, keys whose values differ."""
    key = list(key)
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checks = {"only_in_first": F.col("_b").isNull(), "only_in_second": F.col("_a").isNull(),
              **{f"differs_{c}": both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns}}
    joined = left.join(right, key, "full")
    return (joined.agg(*[F.count_if(cond).alias(n) for n, cond in checks.items()])
            .unpivot([], list(checks), "check", "n"))


def text_bounds(df: DataFrame, columns: Sequence[str], low: int = TEXT_MIN, high: int = TEXT_MAX) -> DataFrame:
    return _long(df, columns, {"too_short": lambda c: F.count_if(F.length(c) < low),
                               "too_long": lambda c: F.count_if(F.length(c) > high)})
