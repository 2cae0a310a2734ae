"""Feature engineering on tabular columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions.columns import at_least_one, micros, numeric_columns, ratio, right_closed_bin, to_long
from veriloom.functions.ordered import average_ranks, lagged, quantiles, row_frame, running
from veriloom.functions.skew import lookup_join

INF = float("inf")
# Column pairs, bins and limits of the engineered features.
RATIOS = (("claim_amount", "customer_age"), ("claim_amount", "policy_duration"), ("customer_age", "policy_duration"),
          ("text_length", "word_count"), ("sentiment_positive", "sentiment_negative"))
PRODUCTS = (("claim_amount", "customer_age"), ("claim_amount", "policy_duration"), ("customer_age", "policy_duration"),
            ("sentiment_compound", "text_length"))
BINS = {
    "claim_amount_bin": ("claim_amount", ((0, 500, 2000, 10000, 50000, INF), ("very_low", "low", "medium", "high", "very_high"))),
    "age_bin": ("customer_age", ((0, 25, 35, 50, 65, 100), ("young", "adult", "middle", "senior", "elderly"))),
    "policy_duration_bin": ("policy_duration", ((0, 6, 12, 24, 60, INF), ("new", "short", "medium", "long", "very_long"))),
}
ROLLING_ROWS = 30
DAY_MICROS = 86_400_000_000
CORRELATION_LIMIT = 0.95
VARIANCE_LIMIT = 0.01


def _present(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def ratios(df: DataFrame, pairs: Sequence[tuple[str, str]] = RATIOS) -> DataFrame:
    """a / b, with 1e-6 in place of a zero denominator."""
    def safe(b: str) -> Column:
        return F.when(F.col(b) == 0, F.lit(1e-6)).otherwise(F.col(b).cast("double"))
    return df.withColumns({f"{a}_to_{b}_ratio": F.col(a).cast("double") / safe(b) for a, b in pairs if _present(df, a, b)})


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]] = PRODUCTS, add: Sequence[tuple[str, str]] = ()) -> DataFrame:
    out = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if _present(df, a, b)}
    out.update({f"{a}_plus_{b}": F.col(a) + F.col(b) for a, b in add if _present(df, a, b)})
    return df.withColumns(out)


def polynomial(df: DataFrame, columns: Sequence[str], squares: bool = False) -> DataFrame:
    """Degree-2 products of distinct columns, with ``squares`` also of a column with itself."""
    pick = combinations_with_replacement if squares else combinations
    names = {(a, b): f"poly_{a}^2" if a == b else f"poly_{a} {b}" for a, b in pick(columns, 2)}
    return df.withColumns({n: F.col(a).cast("double") * F.col(b) for (a, b), n in names.items()})


def binning(df: DataFrame, bins: dict = BINS, outside: str | None = None) -> DataFrame:
    """Right-closed bins; values outside get null or the label ``outside``."""
    def label(c: str, spec: tuple) -> Column:
        b = right_closed_bin(F.col(c), *spec)
        return b if outside is None else F.coalesce(b, F.lit(outside))
    return df.withColumns({new: label(c, spec) for new, (c, spec) in bins.items() if c in df.columns})


def composite_risk(df: DataFrame, amount: str | None = None, age: str | None = None, duration: str | None = None,
                   negative: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Mean of the available components. ``stats`` (min, max of amount) defaults to those of ``df``."""
    parts = []
    if amount:
        stats = stats or df.agg(F.min(amount).alias("lo"), F.max(amount).alias("hi"))
        s = stats.select(F.struct("lo", "hi")).scalar()
        scaled = ratio(F.col(amount) - s["lo"], s["hi"] - s["lo"], None)
        parts.append(F.when(F.col(amount).isNotNull() & (s["hi"] == s["lo"]), 0.0).otherwise(scaled))
    if age:
        parts.append(F.abs(F.col(age) - 45) / F.lit(45.0).cast("double"))
    if duration:
        parts.append(F.lit(1.0) / (1 + F.col(duration) / F.lit(12.0).cast("double")))
    if negative:
        parts.append(F.col(negative))
    return df.withColumn("composite_risk_score", reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts))))


def quantile_of(df: DataFrame, column: str, p: float) -> Column:
    """One exact quantile as a scalar sub-query."""
    return quantiles(df, [column], {"q": p}).select("q").scalar()


def fraud_score(df: DataFrame, amount: str | None = None, negative: str | None = None, damage: str | None = None,
                p95: Column | None = None) -> DataFrame:
    """Mean of the available indicators; a null value indicates nothing."""
    marks = []
    if amount:
        p95 = p95 if p95 is not None else quantile_of(df, amount, 0.95)
        marks.append(F.col(amount) > p95)
    if negative:
        marks.append(F.col(negative) > 0.5)
    if damage:
        marks.append(F.col(damage) > 2)
    total = reduce(lambda a, b: a + b, [_flag(m) for m in marks])
    return df.withColumn("fraud_risk_score", total / F.lit(float(len(marks))))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def fraud_flags(df: DataFrame, amount: str, ts: str, keyword_mentions: str | None = None,
                text_length: str | None = None, p80: Column | None = None) -> DataFrame:
    out = {"round_number_claim": _flag(F.col(amount) % 100 == 0), "very_round_claim": _flag(F.col(amount) % 1000 == 0),
           "weekend_claim": _flag(F.weekday(ts) >= 5), "late_night_claim": _flag(F.hour(ts) >= 22)}
    if keyword_mentions:
        out["fraud_keywords_present"] = _flag(F.col(keyword_mentions) > 0)
    if text_length:
        p80 = p80 if p80 is not None else quantile_of(df, amount, 0.8)
        out["short_desc_high_claim"] = _flag((F.col(text_length) < 50) & (F.col(amount) > p80))
    return df.withColumns(out)


def severity_flags(df: DataFrame, medical: str = "medical_terms_mentions", severity: str = "severity_indicators_mentions",
                   persons: str = "person_mentions") -> DataFrame:
    rules = {"high_medical_severity": (medical, 2), "high_damage_severity": (severity, 1), "multi_party_claim": (persons, 3)}
    return df.withColumns({n: _flag(F.col(c) >= at_least) for n, (c, at_least) in rules.items() if c in df.columns})


def rolling_mean(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), rows: int = ROLLING_ROWS,
                 name: str | None = None) -> DataFrame:
    """Mean of the last ``rows`` rows, current one included; fewer at the start."""
    return row_frame(df, keys, order, rows - 1, {name or f"{value}_rolling_mean": F.avg(value)})


def recent_count(df: DataFrame, key: str, ts: str, row_key: str, span: int = 30 * DAY_MICROS,
                 name: str = "recent_claims_count") -> DataFrame:
    """Rows of the same key in (t - span, t], those at t included; ``span`` in microseconds.

    Each row counts +1 from its own time and -1 from ``span`` later, so the count
    at a time is a running sum of at most two entries per distinct (key, time).
    """
    own = df.where(F.col(ts).isNotNull()).groupBy(key, micros(F.col(ts)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    ends = own.select(key, (F.col("_t") + span).alias("_t"), (-F.col("_n")).alias("_d"), F.lit(0).cast("long").alias("_n"))
    steps = own.select(key, "_t", F.col("_n").alias("_d"), "_n").unionAll(ends)
    merged = steps.groupBy(key, "_t").agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))
    counts = running(merged, [key], ["_t"], sums={name: F.col("_d")}).where(F.col("_n") > 0).select(key, "_t", "_n", name)
    rows = df.withColumn("_t", micros(F.col(ts)))
    return lookup_join(rows, counts, [key, "_t"], row_key, weight="_n").drop("_t", "_n")


def percentile_rank(df: DataFrame, column: str, row_key: str, name: str | None = None) -> DataFrame:
    """Mean rank among ties divided by the number of values."""
    ranks = average_ranks(df, column)
    total = df.agg(F.count(column)).scalar()
    table = ranks.select(column, F.col("n").alias("_n"), (F.col("avg_rank") / total).alias(name or f"{column}_percentile"))
    return lookup_join(df, table, [column], row_key, weight="_n").drop("_n")


def quantile_outlier(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    q = quantiles(df, columns, {"lower": low, "upper": high})
    look = q.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower", "upper"))))).scalar()
    return df.withColumns({f"{c}_is_outlier": _flag((F.col(c) < look[c]["lower"]) | (F.col(c) > look[c]["upper"])) for c in columns})


def clean_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite, NaN and null become 0."""
    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INF), 0.0).otherwise(x)
    return df.withColumns({c: clean(c) for c in (columns or numeric_columns(df))})


def previous_count(df: DataFrame, key: str, order: Sequence[str], name: str = "previous_claims") -> DataFrame:
    """Rows of the same key before this one."""
    out = running(df, [key], order, sums={name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)


def claim_frequency(df: DataFrame, previous: str, duration: str) -> DataFrame:
    rate = F.col(previous) / at_least_one(F.col(duration)) * 12
    return df.withColumns({"claims_per_year": rate, "is_frequent_claimant": _flag(rate > 2)})


def coverage_ratio(df: DataFrame, amount: str, coverage: str, p90: Column | None = None) -> DataFrame:
    p90 = p90 if p90 is not None else quantile_of(df, amount, 0.9)
    return df.withColumns({"claim_to_coverage_ratio": ratio(F.col(amount), F.col(coverage), None),
                           "high_value_claim": _flag(F.col(amount) > p90)})


def policy_age(df: DataFrame, ts: str, start: str, lapsed: str | None = None) -> DataFrame:
    days = F.datediff(F.col(ts).cast("date"), F.col(start).cast("date"))
    out = {"days_since_policy_start": days, "early_claim_indicator": _flag(days < 30)}
    if lapsed:
        out["policy_lapse_history"] = F.coalesce(F.col(lapsed), F.lit(0))
    return df.withColumns(out)


def customer_aggregates(df: DataFrame, key: str, amount: str, ts: str, kind: str) -> DataFrame:
    """Per key: sum, mean, std, count of amount, first and last date, counts per kind as a map."""
    main = df.groupBy(key).agg(
        F.sum(amount).alias(f"{amount}_sum"), F.avg(amount).alias(f"{amount}_mean"), F.stddev_samp(amount).alias(f"{amount}_std"),
        F.count(amount).alias(f"{amount}_count"), F.min(ts).alias(f"{ts}_min"), F.max(ts).alias(f"{ts}_max"),
        F.count(F.lit(1)).alias("_rows"))
    kinds = df.where(F.col(kind).isNotNull()).groupBy(key, kind).agg(F.count(F.lit(1)).alias("_n"))
    # one entry per distinct kind, however many rows the key has
    maps = kinds.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias(f"{kind}_counts"))
    return main.join(maps, key, "left")


def add_customer_aggregates(df: DataFrame, key: str, amount: str, ts: str, kind: str, row_key: str) -> DataFrame:
    return lookup_join(df, customer_aggregates(df, key, amount, ts, kind), [key], row_key, weight="_rows").drop("_rows")


def location_aggregates(df: DataFrame, key: str, amount: str, risk: str, high: str = "high") -> DataFrame:
    return df.groupBy(key).agg(F.avg(amount).alias("location_avg_amount"),
                               F.avg(F.when(F.col(risk) == high, 1.0).otherwise(0.0)).alias("location_risk_rate"),
                               F.count(F.lit(1)).alias("_rows"))


def add_location_aggregates(df: DataFrame, key: str, amount: str, risk: str, row_key: str) -> DataFrame:
    return lookup_join(df, location_aggregates(df, key, amount, risk), [key], row_key, weight="_rows").drop("_rows")


def lag_features(df: DataFrame, key: str, order: Sequence[str], value: str, offsets: Sequence[int]) -> DataFrame:
    return lagged(df, [key], order, value, offsets)


def seasonal_trend(df: DataFrame, ts: str, amount: str) -> DataFrame:
    """Claims and amounts per calendar month, with the season."""
    month = F.month("month")
    season = (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
              .when(month.isin(6, 7, 8), "summer").otherwise("autumn"))
    return (df.groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("month"))
            .agg(F.count(F.lit(1)).alias("claims"), F.sum(amount).alias("total"), F.avg(amount).alias("mean"))
            .withColumn("season", season))


def combine(structured: DataFrame, text: DataFrame, key: str) -> DataFrame:
    return structured.join(text, key, "inner")


# ------------------------------------------------------------------ feature selection

def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, score: one-way ANOVA F from per-class count, mean and variance."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    by_class = df.groupBy(label).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
                     for i, f in enumerate(features)])
    c = by_class.select(label, F.inline(rows)).where(F.col("n") > 0)
    s = c.groupBy("feature").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m"))).alias("sum"), F.collect_list(F.struct("n", "m")).alias("classes"))
    grand = F.col("sum") / F.col("total")
    between = F.aggregate("classes", F.lit(0.0), lambda acc, x: acc + x["n"] * F.pow(x["m"] - grand, F.lit(2.0)))
    score = ratio(between / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k")), None)
    return s.select("feature", score.alias("score"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """feature, score in nats, over equal-frequency bins."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    q = quantiles(df, features, probs)
    edges = F.broadcast(q.select("feature", *probs))  # one row per feature
    long = to_long(df, [label], features).where(F.col("value").isNotNull()).join(edges, "feature")
    place = reduce(lambda a, b: a + b, [_flag(F.col("value") > F.col(e)) for e in probs])
    cells = long.groupBy("feature", label, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = {"_t": ["feature"], "_x": ["feature", "bin"], "_y": ["feature", label]}
    joint = cells.withColumns({n: F.sum("n").over(W.partitionBy(*k)) for n, k in by.items()})
    term = F.col("n") / F.col("_t") * F.log(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))
    return joint.groupBy("feature").agg(F.sum(term).alias("score"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def select_intersect(score_tables: Sequence[DataFrame], n_features: int, share: float = 0.8) -> DataFrame:
    """Features among the int(share n) best of every table."""
    k = min(int(n_features * share), n_features)
    chosen = [top_features(t, k).select("feature") for t in score_tables]
    return reduce(DataFrame.intersect, chosen)


def importance(scores: dict[str, DataFrame]) -> DataFrame:
    parts = [t.select("feature", F.lit(m).alias("method"), F.col("score").alias("importance")) for m, t in scores.items()]
    return reduce(DataFrame.unionAll, parts)


def _gram_batches(batches, at: list[float]):
    """Sums of one task over the rows that know both columns of a pair, as five square matrices in one row."""
    p, total = len(at), None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - at
        known = ~np.isnan(x)
        x, known = np.where(known, x, 0.0), known.astype(float)
        part = np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        row, col = np.triu_indices(p, 1)
        n, s, q, xy = total
        columns = [row, col, n[row, col], s[row, col], s[col, row], q[row, col], q[col, row], xy[row, col]]
        names = ["i", "j", "n", "sx", "sy", "xx", "yy", "xy"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names=names)


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All pairs of the listed columns (not of rows), each over the rows that know both; null for a constant column.

    Every task makes one Gram matrix of its rows, shifted by the columns' means,
    and sends a row per pair, so the expressions do not grow with the number of
    pairs. NaN and infinite values count as unknown; an empty table has no pairs.
    """
    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    columns = df.select(*[value(c).alias(f"x{i}") for i, c in enumerate(features)])
    means = [m or 0.0 for m in columns.agg(*[F.avg(c) for c in columns.columns]).first()]
    sums = (columns.mapInArrow(lambda it: _gram_batches(it, means), "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "sx", "sy", "xx", "yy", "xy")))
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")]))
    n = F.nullif(F.col("n"), F.lit(0.0))
    dx = F.col("xx") - F.col("sx") * F.col("sx") / n
    dy = F.col("yy") - F.col("sy") * F.col("sy") / n
    # what rounding leaves of a constant column is no variance
    varies = (dx > F.lit(1e-13) * F.col("xx")) & (dy > F.lit(1e-13) * F.col("yy"))
    corr = F.when(varies, (F.col("xy") - F.col("sx") * F.col("sy") / n) / F.sqrt(dx * dy))
    names = F.array(*[F.lit(c) for c in features])
    return sums.select(names[F.col("i")].alias("feature_1"), names[F.col("j")].alias("feature_2"), corr.alias("corr"))


def correlated_features(df: DataFrame, features: Sequence[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Features to drop: those too correlated with an earlier one."""
    return (correlations(df, features).where(F.abs("corr") > limit)
            .groupBy(F.col("feature_2").alias("feature")).agg(F.max(F.abs("corr")).alias("max_corr")))


def low_variance(df: DataFrame, features: Sequence[str], limit: float = VARIANCE_LIMIT) -> DataFrame:
    v = df.agg(*[F.var_samp(c).alias(c) for c in features]).unpivot([], list(features), "feature", "variance")
    return v.withColumn("drop", F.col("variance") <= limit)


def principal_components(df: DataFrame, columns: Sequence[str], share: float = 0.95, min_columns: int = 10) -> DataFrame:
    """Adds pca_0.. up to the explained share; too few columns are left as they are.

    Null, NaN and infinite values count as 0, so every row is kept.
    """
    if len(columns) <= min_columns:
        return df
    inputs = {f"_in{i}": c for i, c in enumerate(columns)}
    clean = clean_infinite(df.withColumns({n: F.col(c) for n, c in inputs.items()}), list(inputs))
    vec = VectorAssembler(inputCols=list(inputs), outputCol="_v", handleInvalid="error").transform(clean)
    model = PCA(k=len(columns), inputCol="_v", outputCol="_p").fit(vec)
    total, k = 0.0, 0
    while total < share and k < len(columns):
        total += model.explainedVariance[k]
        k += 1
    arr = vector_to_array("_p")
    return model.transform(vec).select(*df.columns, *[arr[i].alias(f"pca_{i}") for i in range(k)])
