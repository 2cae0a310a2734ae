"""Drift between a reference and a new data set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import stats
from veriloom.functions.columns import ratio, string_columns, to_long
from veriloom.functions.ordered import quantiles, quantiles_of_counts, running
from veriloom.operators.quality import _long
from veriloom.operators.text import word_frequencies
from veriloom.functions.lexicon import SPACE
from veriloom.session import stored

# Thresholds of the tests and of the severities.
P_LIMIT, PSI_LIMIT, JS_LIMIT, LENGTH_LIMIT = 0.05, 0.2, 0.1, 0.2
WARNING, CRITICAL, MIN_SAMPLES = 0.1, 0.3, 100
BINS, EPS, TOP_WORDS = 20, 1e-10, 100
NEW_CATEGORY_PENALTY = 0.1


# ------------------------------------------------------------------ reference

def feature_types(df: DataFrame) -> DataFrame:
    """feature, type. Strings are text if long on average or mostly distinct, else categorical; the rest is numerical."""
    strings = string_columns(df)
    parts = []
    if strings:
        s = _long(df, strings, {"avg_length": lambda c: F.avg(F.length(F.coalesce(c, F.lit("nan")))),
                                "distinct": lambda c: F.count_distinct(F.md5(F.col(c)))})
        text = (F.col("avg_length") > 20) | (ratio(F.col("distinct"), F.col("rows")) > 0.5)
        parts.append(s.select("feature", F.when(text, "text").otherwise("categorical").alias("type"), "rows"))
    others = [c for c in df.columns if c not in strings]
    if others:
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("numerical").alias("type")) for c in others])
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(rows), "rows"))
    return reduce(DataFrame.unionByName, parts)


def numeric_reference(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """One row per feature: mean, std, median, q25, q75, min, max and the bin edges."""
    s = _long(df, columns, {"mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "min": lambda c: F.min(F.col(c).cast("double")),
                            "max": lambda c: F.max(F.col(c).cast("double"))})
    q = quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n")
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("min") + i * (F.col("max") - F.col("min")) / bins)
    return s.drop("rows").join(q, "feature").withColumn("edges", edges)


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, n, share."""
    counts = (to_long(df, [], columns, as_type="string").where(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("feature").agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total), "feature").select("feature", "value", "n", (F.col("n") / F.col("_t")).alias("share"))


def text_reference(df: DataFrame, column: str) -> DataFrame:
    """avg_length, median_length, tokens and distinct tokens of a text column."""
    lengths = df.where(F.col(column).isNotNull()).groupBy(F.length(column).cast("double").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    median = quantiles_of_counts(lengths, [], "len", "c", {"m": 0.5}).select("m").scalar()
    words = df.select(F.explode(F.split(column, f"[{SPACE}]+")).alias("w")).where(F.col("w") != "")
    vocabulary = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))
    return vocabulary.select((lengths.agg(F.sum(F.col("len") * F.col("c")) / F.sum("c")).scalar()).alias("avg_length"),
                             median.alias("median_length"), "tokens", "distinct_tokens")


# ------------------------------------------------------------------ numeric

def _sides(ref: DataFrame, new: DataFrame, columns: Sequence[str], as_type: str = "double") -> DataFrame:
    """(feature, value, ref, new): both sets in long form with 0/1 side counters."""
    def side(df: DataFrame, r: int) -> DataFrame:
        long = to_long(df, [], columns, as_type=as_type).where(F.col("value").isNotNull())
        if as_type == "double":
            long = long.where(~F.isnan("value"))  # NaN has no place in an order
        return long.select("feature", "value", F.lit(r).cast("long").alias("ref"), F.lit(1 - r).cast("long").alias("new"))
    return side(ref, 1).unionAll(side(new, 0))


def _counts(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    return sides.groupBy(*by).agg(F.sum("ref").alias("ref"), F.sum("new").alias("new"))


def histograms(ref: DataFrame, new: DataFrame, numerical: Sequence[str] = (), categorical: Sequence[str] = (), text: Sequence[str] = ()) -> DataFrame:
    """(feature, kind, number, value, ref, new): how often each value occurs on both sides, from one scan of each.

    Kinds are number, category, length (characters of a text) and word (lower-cased). A row becomes its entries, which are
    counted in the tasks before they are shuffled. Nulls have no entry, NaN has one.
    """
    def entry(c: str, kind: str, number: Column | None = None, value: Column | None = None) -> Column:
        return F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), (F.lit(None) if number is None else number).cast("double").alias("number"),
                        (F.lit(None) if value is None else value).cast("string").alias("value"))

    single = [entry(c, "number", F.col(c)) for c in numerical] + [entry(c, "category", value=F.col(c)) for c in categorical]
    single += [entry(c, "length", F.length(c)) for c in text]
    entries = F.filter(F.array(*single), lambda e: e["number"].isNotNull() | e["value"].isNotNull())

    def words(c: str) -> Column:
        return F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"[{SPACE}]+"), lambda w: w != ""), lambda w: entry(c, "word", value=w))
    entries = F.concat(entries, *map(words, text)) if text else entries

    def side(df: DataFrame, r: int) -> DataFrame:
        return df.select(F.inline(entries)).select("*", F.lit(r).cast("long").alias("ref"), F.lit(1 - r).cast("long").alias("new"))
    return _counts(side(ref, 1).unionAll(side(new, 0)), ["feature", "kind", "number", "value"])


def _of_kind(hist: DataFrame, kind: str) -> DataFrame:
    """(feature, value, ref, new) of one kind; NaN has no place in an order."""
    rows = hist.where(F.col("kind") == kind)
    if kind in ("number", "length"):
        return rows.where(~F.isnan("number")).select("feature", F.col("number").alias("value"), "ref", "new")
    return rows.select("feature", "value", "ref", "new")


def ks(ref: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_ref, n_new, ks_statistic, p_value (asymptotic)."""
    return _ks(_counts(_sides(ref, new, columns), ["feature", "value"]))


def _ks(hist: DataFrame) -> DataFrame:
    run = running(hist, ["feature"], ["value"], sums={"cr": F.col("ref"), "cn": F.col("new")},
                  totals={"n_ref": F.col("ref"), "n_new": F.col("new")})
    gap = F.abs(ratio(F.col("cr"), F.col("n_ref")) - ratio(F.col("cn"), F.col("n_new")))
    d = run.groupBy("feature").agg(F.max("n_ref").alias("n_ref"), F.max("n_new").alias("n_new"), F.max(gap).alias("ks_statistic"))
    size = F.col("n_ref") * F.col("n_new").cast("double") / (F.col("n_ref") + F.col("n_new"))
    return d.withColumn("p_value", stats.p_value_udf(stats.kolmogorov_sf)(F.col("ks_statistic") * F.sqrt(size)))


def _psi(share_ref: Column, share_new: Column, eps: float) -> Column:
    p = F.when(share_ref == 0, eps).otherwise(share_ref)
    q = F.when(share_new == 0, eps).otherwise(share_new)
    return (q - p) * F.log(q / p)


def psi_numeric(ref: DataFrame, new: DataFrame, columns: Sequence[str], bins: int = BINS, eps: float = EPS) -> DataFrame:
    """feature, psi over equal-width bins of the reference range.

    New values outside the range fall in no bin but count in the total. A constant
    reference is one bin. Without a value on one side psi is null.
    """
    return _psi_numeric(_counts(_sides(ref, new, columns), ["feature", "value"]), bins, eps)


def _psi_numeric(hist: DataFrame, bins: int = BINS, eps: float = EPS) -> DataFrame:
    ends = hist.where("ref > 0").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = hist.join(F.broadcast(ends), "feature")  # one row per column
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    place = F.least(F.floor(ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    cells = _counts(placed.withColumn("bin", F.when(inside, place)), ["feature", "bin"])
    totals = _counts(cells, ["feature"]).select("feature", F.col("ref").alias("n_ref"), F.col("new").alias("n_new"))
    term = _psi(ratio(F.col("ref"), F.col("n_ref"), None), ratio(F.col("new"), F.col("n_new"), None), eps)
    return cells.where(F.col("bin").isNotNull()).join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum(term).alias("psi"))


def psi_severity(psi: Column) -> Column:
    return F.when(psi > 0.25, "high").when(psi > 0.1, "medium").otherwise("low")


def numeric_details(hist: DataFrame, bins: int = BINS, eps: float = EPS) -> DataFrame:
    """feature, n_ref, n_new, ks_statistic, p_value, psi, mean_shift, std_ratio of the numbers of stored ``histograms``.

    Squares are summed about the means, so large values far from zero lose no digits.
    """
    numbers = _of_kind(hist, "number")
    means = numbers.groupBy("feature").agg(*[ratio(F.sum(F.col("value") * F.col(t)), F.sum(t), None).alias(f"{t}_mean") for t in ("ref", "new")],
                                           *[F.sum(t).alias(f"_{t}") for t in ("ref", "new")])
    squares = numbers.join(F.broadcast(means), "feature").groupBy("feature").agg(  # one row per column
        *[F.first(f"{t}_mean").alias(f"{t}_mean") for t in ("ref", "new")],
        *[F.sqrt(ratio(F.sum(F.col(t) * F.pow(F.col("value") - F.col(f"{t}_mean"), F.lit(2.0))), F.first(f"_{t}") - 1, None)).alias(f"{t}_std")
          for t in ("ref", "new")])
    shift = squares.select("feature", ratio(F.abs(F.col("new_mean") - F.col("ref_mean")), F.col("ref_std"), None).alias("mean_shift"),
                           ratio(F.col("new_std"), F.col("ref_std"), None).alias("std_ratio"))
    return _ks(numbers).join(_psi_numeric(numbers, bins, eps), "feature").join(shift, "feature")


def moments(ref: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, mean_shift in reference deviations, std_ratio."""
    def of(df: DataFrame, tag: str) -> DataFrame:
        return _long(df, columns, {f"{tag}_mean": lambda c: F.avg(c), f"{tag}_std": lambda c: F.stddev_samp(c)}).drop("rows")
    j = of(ref, "ref").join(of(new, "new"), "feature")
    return j.select("feature", ratio(F.abs(F.col("new_mean") - F.col("ref_mean")), F.col("ref_std"), None).alias("mean_shift"),
                    ratio(F.col("new_std"), F.col("ref_std"), None).alias("std_ratio"))


# ------------------------------------------------------------------ categorical

def category_sides(ref: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, ref, new, n_ref, n_new."""
    return _with_totals(_counts(_sides(ref, new, columns, "string"), ["feature", "value"]))


def _with_totals(cells: DataFrame) -> DataFrame:
    totals = _counts(cells, ["feature"]).select("feature", F.col("ref").alias("n_ref"), F.col("new").alias("n_new"))
    return cells.join(F.broadcast(totals), "feature")  # a row per column


def chi2(sides: DataFrame) -> DataFrame:
    """Goodness of fit to the reference shares; null where a cell holds fewer than five."""
    expected = ratio(F.col("ref"), F.col("n_ref"), None) * F.col("n_new")
    g = sides.groupBy("feature").agg(
        F.sum(ratio(F.pow(F.col("new") - expected, F.lit(2.0)), expected)).alias("_x"), F.count(F.lit(1)).alias("categories"),
        F.min(F.least(F.col("ref").cast("double"), F.col("new").cast("double"))).alias("_least"))
    stat = F.when(F.col("_least") >= 5, F.col("_x"))
    out = g.select("feature", "categories", stat.alias("chi2_statistic"))
    return out.withColumn("p_value", stats.p_value_udf(stats.chi2_sf)(F.col("chi2_statistic"), (F.col("categories") - 1).cast("double")))


def psi_categorical(sides: DataFrame, eps: float = EPS) -> DataFrame:
    term = _psi(ratio(F.col("ref"), F.col("n_ref"), None), ratio(F.col("new"), F.col("n_new"), None), eps)
    return sides.groupBy("feature").agg(F.sum(term).alias("psi"))


def category_changes(sides: DataFrame) -> DataFrame:
    """Categories on one side only."""
    change = F.when(F.col("ref") == 0, "new").when(F.col("new") == 0, "missing")
    return sides.select("feature", "value", change.alias("change")).where(F.col("change").isNotNull())


# ------------------------------------------------------------------ over time

def psi_by_period(ref: DataFrame, new: DataFrame, period: Column, numerical: Sequence[str] = (), categorical: Sequence[str] = (),
                  bins: int = BINS, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """period, feature, feature_type, n, psi, drift_detected: the drift of each period of the new rows from one reference.

    The values of all features become cells (bins of the reference range, or
    categories), counted in one scan of each side. The reference cells a period
    has nothing in add a known amount each, so a period starts from the amount
    of all of them and corrects it where it has rows: no period is combined with
    the whole reference. Fewer than ``min_samples`` values show no drift. Nulls
    and NaN are no values; a feature the reference has no values of is left out.
    """
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in numerical}
    # two numbers per column
    ends = ref.agg(*[e for i, c in enumerate(numerical) for e in (F.min(known[c]).alias(f"lo{i}"), F.max(known[c]).alias(f"hi{i}"))]).first() if numerical else {}

    def cell(i: int, c: str) -> Column:
        lo, hi = (F.lit(ends[f"{end}{i}"]).cast("double") for end in ("lo", "hi"))
        place = F.least(F.floor(ratio(known[c] - lo, hi - lo) * bins), F.lit(bins - 1)).cast("string")
        return F.when(known[c].between(lo, hi), place).when(known[c].isNotNull(), "outside")

    def cells(df: DataFrame, by: list[Column]) -> DataFrame:
        found = [F.struct(F.lit(c).alias("feature"), F.lit("numerical").alias("feature_type"), cell(i, c).alias("cell")) for i, c in enumerate(numerical)]
        found += [F.struct(F.lit(c).alias("feature"), F.lit("categorical").alias("feature_type"), F.col(c).cast("string").alias("cell")) for c in categorical]
        entries = F.filter(F.array(*found), lambda e: e["cell"].isNotNull())
        flat = df.select(*by, F.inline(entries))
        return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n"))

    key = ["feature", "feature_type"]
    base = cells(ref, [])
    base = stored(base.join(F.broadcast(base.groupBy(*key).agg(F.sum("n").alias("_n"))), key)  # a row per column
                  .select(*key, "cell", ratio(F.col("n"), F.col("_n")).alias("p")), "reference")
    absent = _psi(F.col("p"), F.lit(0.0), eps)
    start = base.groupBy(*key).agg(F.sum(absent).alias("start"))
    here = stored(cells(new, [period.alias("period")]), "periods")
    total = here.groupBy("period", *key).agg(F.sum("n").alias("total"))
    q = ratio(F.col("n"), F.col("total"))
    outside = (F.col("feature_type") == "numerical") & (F.col("cell") == "outside")
    change = _psi(F.coalesce("p", F.lit(0.0)), q, eps) - F.when(F.col("p").isNotNull(), absent).otherwise(0.0)
    moved = here.join(base, [*key, "cell"], "left").join(total, ["period", *key]).groupBy("period", *key).agg(
        F.sum("n").alias("n"), F.sum(F.when(outside, 0.0).otherwise(change)).alias("change"))
    psi = F.col("start") + F.col("change")
    return moved.join(F.broadcast(start), key).select(  # a row per column
        "period", *key, "n", psi.alias("psi"), ((psi > PSI_LIMIT) & (F.col("n") >= min_samples)).alias("drift_detected"))


def features_with_drift(by_period: DataFrame) -> DataFrame:
    """period, features_with_drift of ``psi_by_period``."""
    return by_period.groupBy("period").agg(F.count_if("drift_detected").alias("features_with_drift"))


# ------------------------------------------------------------------ text

def text_length_shift(ref: DataFrame, new: DataFrame, column: str) -> DataFrame:
    a = ref.agg(F.avg(F.length(column)).alias("avg_length_ref"))
    b = new.agg(F.avg(F.length(column))).scalar()
    out = a.withColumn("avg_length_new", b)
    shift = ratio(F.abs(F.col("avg_length_new") - F.col("avg_length_ref")), F.col("avg_length_ref"))
    return out.select(F.lit(column).alias("feature"), "avg_length_ref", "avg_length_new", shift.alias("length_shift"))


def text_divergence(ref: DataFrame, new: DataFrame, column: str, top: int | None = None, eps: float = EPS) -> DataFrame:
    """Jensen-Shannon divergence in nats of the words of both sides, or of the ``top`` most frequent ones of each."""
    a = word_frequencies(ref, column, top).withColumnRenamed("n", "a")
    b = word_frequencies(new, column, top).withColumnRenamed("n", "b")
    both = a.join(b, "word", "full")
    total = both.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    p = F.coalesce(F.col("a") / total["a"], F.lit(eps))
    q = F.coalesce(F.col("b") / total["b"], F.lit(eps))
    m = (p + q) / 2
    return both.agg((F.sum(p * F.log(p / m)) / 2 + F.sum(q * F.log(q / m)) / 2).alias("js_divergence")).select(
        F.lit(column).alias("feature"), "js_divergence")


def _text_changes(hist: DataFrame, eps: float = EPS) -> DataFrame:
    """feature, length_shift, js_divergence of all text columns of ``histograms``."""
    def mean(side: str) -> Column:
        return ratio(F.sum(F.col("value") * F.col(side)), F.sum(side), None)
    lengths = _of_kind(hist, "length").groupBy("feature").agg(ratio(F.abs(mean("new") - mean("ref")), mean("ref")).alias("length_shift"))

    def share(side: str) -> Column:
        return F.when(F.col(side) > 0, F.col(side) / F.col(f"n_{side}")).otherwise(eps)
    p, q = share("ref"), share("new")
    m = (p + q) / 2
    words = _with_totals(_of_kind(hist, "word")).groupBy("feature").agg((F.sum(p * F.log(p / m)) / 2 + F.sum(q * F.log(q / m)) / 2).alias("js_divergence"))
    return lengths.join(words, "feature", "left")


# ------------------------------------------------------------------ reports

def report(ref: DataFrame, new: DataFrame, numerical: Sequence[str] = (), categorical: Sequence[str] = (), text: Sequence[str] = (),
           min_samples: int = MIN_SAMPLES) -> DataFrame:
    """feature, feature_type, drift_score, drift_detected, error.

    Each side is read once: everything follows from the stored ``histograms``. A feature without values has a row too, of too few samples.
    """
    hist = stored(histograms(ref, new, numerical, categorical, text), "histograms")
    kinds = {"numerical": numerical, "categorical": categorical, "text": text}
    scores = []
    if numerical:
        numbers = _of_kind(hist, "number")
        j = _ks(numbers).join(_psi_numeric(numbers), "feature")
        scores.append(j.select("feature", F.greatest(1 - F.col("p_value"), F.col("psi") / PSI_LIMIT).alias("score"),
                               ((F.col("p_value") < P_LIMIT) | (F.col("psi") > PSI_LIMIT)).alias("hit")))
    if categorical:
        sides = _with_totals(_of_kind(hist, "category"))
        added = sides.groupBy("feature").agg(F.count_if(F.col("ref") == 0).alias("added"))
        j = chi2(sides).join(psi_categorical(sides), "feature").join(added, "feature")
        p = F.coalesce("p_value", F.lit(1.0))
        scores.append(j.select("feature", F.greatest(1 - p, F.col("psi") / PSI_LIMIT, F.col("added") * NEW_CATEGORY_PENALTY).alias("score"),
                               ((p < P_LIMIT) | (F.col("psi") > PSI_LIMIT) | (F.col("added") > 0)).alias("hit")))
    if text:
        scores.append(_text_changes(hist).select("feature", F.greatest(F.col("length_shift") / LENGTH_LIMIT, F.col("js_divergence") / JS_LIMIT).alias("score"),
                                                 ((F.col("length_shift") > LENGTH_LIMIT) | (F.col("js_divergence") > JS_LIMIT)).alias("hit")))
    asked = ref.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(t).alias("feature_type")) for t, columns in kinds.items() for c in columns])))
    typed = [s.withColumn("feature_type", F.lit(t)) for s, t in zip(scores, (t for t, columns in kinds.items() if columns))]
    samples = hist.where("kind <> 'word'").groupBy("feature", F.when(F.col("kind") == "number", "numerical").when(F.col("kind") == "category", "categorical")
                                                       .otherwise("text").alias("feature_type")).agg(F.sum("new").alias("_n"))
    few = F.coalesce("_n", F.lit(0)) < min_samples
    rows = asked.join(F.broadcast(reduce(DataFrame.unionByName, typed)), ["feature", "feature_type"], "left").join(
        F.broadcast(samples), ["feature", "feature_type"], "left")  # one row per column
    return rows.select("feature", "feature_type", F.when(few, 0.0).otherwise(F.col("score")).alias("drift_score"),
                       F.when(few, False).otherwise(F.col("hit")).alias("drift_detected"), F.when(few, "insufficient samples").alias("error"))


def severity(score: Column) -> Column:
    return F.when(score < WARNING, "none").when(score < CRITICAL, "warning").otherwise("critical")


def summary(report_rows: DataFrame) -> DataFrame:
    s = report_rows.agg(F.count(F.lit(1)).alias("features"), F.avg("drift_score").alias("overall_drift_score"),
                        F.count_if("drift_detected").alias("features_with_drift"))
    return s.withColumns({
        "drift_percentage": ratio(F.col("features_with_drift"), F.col("features")) * 100,
        "drift_detected": (F.col("overall_drift_score") > WARNING) | (F.col("features_with_drift") > 0),
        "severity": severity(F.col("overall_drift_score"))})


def top_features(report_rows: DataFrame, k: int = 5) -> DataFrame:
    return report_rows.orderBy(F.desc("drift_score"), "feature").limit(k)


def count_rule(report_rows: DataFrame, at_least: int = 3) -> DataFrame:
    n = F.count_if("drift_detected")
    return report_rows.agg(n.alias("features_with_drift"), ratio(n, F.count(F.lit(1))).alias("drift_share"),
                           (n >= at_least).alias("overall_drift_detected"))


def concept(ref: DataFrame, new: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """Change of the mean label within the bins of a feature, and a chi-square of the change."""
    q = quantiles(ref, [feature], {f"q{i}": i / bins for i in range(1, bins)})
    edges = q.select(F.struct(*[f"q{i}" for i in range(1, bins)])).scalar()
    place = reduce(lambda a, b: a + b, [F.when(F.col(feature) > edges[f"q{i}"], 1).otherwise(0) for i in range(1, bins)])

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.where(F.col(feature).isNotNull()).groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.avg(F.col(label).cast("double")).alias(f"rate_{tag}"))
    j = side(ref, "ref").join(side(new, "new"), "bin", "full")
    spread = F.col("rate_ref") * (1 - F.col("rate_ref"))
    term = ratio(F.col("n_new") * F.pow(F.col("rate_new") - F.col("rate_ref"), F.lit(2.0)), spread)
    return j.select("bin", "n_ref", "n_new", "rate_ref", "rate_new", term.alias("chi2_term"))
