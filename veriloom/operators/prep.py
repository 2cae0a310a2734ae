"""Cleaning, imputation, encoding and scaling.

A fit is an aggregate that gives a small table; a transform is a projection or a
join with that table. Fitted tables can be written and read back.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.columns import at_least_one, missing, numeric_columns, right_closed_bin, string_columns
from veriloom.functions.ordered import quantiles, row_numbers, running
from veriloom.functions.skew import lookup_join
from veriloom.operators.features import anova_f, mutual_information, top_features
from veriloom.operators.knn import knn_impute  # noqa: F401  one of the imputers
from veriloom.operators.quality import bounds_lookup, iqr_bounds, zscore_bounds
from veriloom.session import stored

INF = float("inf")
# Bin edges and labels, open below and closed above.
AMOUNT_BINS = ((0, 1000, 5000, 20000, INF), ("small", "medium", "large", "very_large"))
AGE_BINS = ((0, 25, 35, 50, 65, INF), ("young", "adult", "middle_aged", "senior", "elderly"))
DURATION_BINS = ((0, 6, 12, 24, INF), ("new", "short_term", "medium_term", "long_term"))
SPARSE_LIMIT = 0.7
MAX_ONEHOT = 10
#: Columns that values may become without a limit given by the caller.
MAX_COLUMNS = 10_000


# ------------------------------------------------------------------ columns and rows

def sparse_columns(df: DataFrame, limit: float = SPARSE_LIMIT) -> list[str]:
    """Columns whose share of nulls is above the limit (one row comes to the driver)."""
    shares = df.agg(*[F.avg(F.when(missing(df, c), 1.0).otherwise(0.0)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if (shares[c] or 0.0) > limit]


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value besides null."""
    ends = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(df.columns)
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [c for i, c in enumerate(df.columns) if ends[f"lo_{i}"] == ends[f"hi_{i}"]]


def drop_sparse(df: DataFrame, limit: float = SPARSE_LIMIT) -> DataFrame:
    return df.drop(*sparse_columns(df, limit))


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keeps the first of several columns with one name."""
    keep, seen = [], set()
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(i)
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in keep])


def drop_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key. The rank limit is applied before the shuffle, so copies never travel."""
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def standardize_text(df: DataFrame, upper: Sequence[str] = (), title: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({**{c: F.upper(F.trim(c)) for c in upper}, **{c: F.initcap(c) for c in title}})


def filter_valid(df: DataFrame, amount: str, age: str, low: int = 18, high: int = 120) -> DataFrame:
    return df.where((F.col(amount) > 0) & F.col(age).between(low, high))


# ------------------------------------------------------------------ imputation

def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, most frequent value as text; ties go to the smallest value of the column's type. All columns are counted in one scan.

    A counted row holds the number of its column and that column's value in a
    field of the column's type, the other fields being null.
    """
    slots = [f"_v{i}" for i in range(len(columns))]
    entries = F.array(*[F.when(~missing(df, c), F.struct(F.lit(i).alias("_at"), *[
        (F.col(c) if c == d else F.lit(None).cast(df.schema[d].dataType)).alias(v) for d, v in zip(columns, slots)]))
        for i, c in enumerate(columns)])
    hist = (df.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))
            .groupBy("_at", *slots).agg(F.count(F.lit(1)).alias("_n")))
    top = hist.groupBy("_at").agg(*[F.min_by(v, F.struct(-F.col("_n"), F.col(v))).cast("string").alias(v) for v in slots])
    rows = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(c).alias("feature")) for i, c in enumerate(columns)])
    names = df.sparkSession.range(1).select(F.inline(rows))
    # a column without values has a null; at most one row per column on both sides
    return names.join(F.broadcast(top), "_at", "left").select("feature", F.coalesce(*slots).alias("value"))


def fit_imputer(df: DataFrame, strategies: dict[str, object]) -> DataFrame:
    """feature, value (as text) for strategies mean, median, mode, or ("constant", v)."""
    by: dict[str, list[str]] = {}
    constants = {}
    for c, s in strategies.items():
        if isinstance(s, tuple):
            constants[c] = s[1]
        else:
            by.setdefault(s, []).append(c)
    parts = []
    if "mean" in by:
        means = df.agg(*[F.avg(F.when(~missing(df, c), F.col(c))).alias(c) for c in by["mean"]])
        parts.append(means.unpivot([], by["mean"], "feature", "value").select("feature", F.col("value").cast("string").alias("value")))
    if "median" in by:
        parts.append(quantiles(df, by["median"], {"value": 0.5}).select("feature", F.col("value").cast("string").alias("value")))
    if "mode" in by:
        parts.append(modes(df, by["mode"]))
    if constants:
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(str(v)).alias("value")) for c, v in constants.items()])
        parts.append(df.sparkSession.range(1).select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def apply_imputer(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fills nulls from the fitted table (one row per column).

    Columns of int and smaller whole numbers become double, which holds all their
    values. Long and decimal columns keep their type and values, and take the
    fill value rounded.
    """
    values = {r["feature"]: r["value"] for r in fitted.where(F.col("feature").isin(list(columns))).collect()}
    out = {}
    for c in columns:
        kind, value = df.schema[c].dataType, values.get(c)
        fill = F.lit(value)
        if isinstance(kind, T.IntegralType) and not isinstance(kind, T.LongType):
            kind = T.DoubleType()
        elif isinstance(kind, T.IntegralType):
            fill = F.coalesce(F.round(fill.try_cast("decimal(38,9)"), 0).try_cast(kind), F.round(fill.cast("double"), 0).try_cast(kind))
        elif isinstance(kind, T.DecimalType):
            fill = F.round(fill.try_cast("decimal(38,18)"), kind.scale)
        out[c] = F.when(missing(df, c), fill.cast(kind)).otherwise(F.col(c).cast(kind))
    return df.withColumns(out)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last known value of each column per entity in order."""
    filled = running(df, keys, order, lasts={f"_f_{c}": F.col(c) for c in columns})
    return filled.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*[f"_f_{c}" for c in columns])


# ------------------------------------------------------------------ outliers

def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str = "IQR") -> DataFrame:
    return zscore_bounds(df, columns) if method == "zscore" else iqr_bounds(df, columns)


def cap_outliers(df: DataFrame, columns: Sequence[str], bounds: DataFrame) -> DataFrame:
    look = bounds_lookup(bounds)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), look[c]["lower"]), look[c]["upper"]))
                           for c in columns})


def remove_outliers(df: DataFrame, columns: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Keeps rows within all bounds; null is within."""
    look = bounds_lookup(bounds)
    inside = [F.col(c).isNull() | F.col(c).between(look[c]["lower"], look[c]["upper"]) for c in columns]
    return df.where(reduce(lambda a, b: a & b, inside))


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed log1p."""
    return df.withColumns({c: F.signum(c) * F.log1p(F.abs(F.col(c).cast("double"))) for c in columns})


# ------------------------------------------------------------------ derived columns

def date_parts(df: DataFrame, columns: Sequence[str], as_of: str) -> DataFrame:
    """Calendar parts; Monday is weekday 0."""
    out = {}
    for c in columns:
        out.update({f"{c}_year": F.year(c), f"{c}_month": F.month(c), f"{c}_day": F.dayofmonth(c),
                    f"{c}_weekday": F.weekday(c), f"{c}_is_weekend": F.weekday(c) >= 5,
                    f"{c}_days_since": F.datediff(F.lit(as_of).cast("date"), F.col(c).cast("date"))})
    return df.withColumns(out)


def amount_scales(df: DataFrame, amount: str, duration: str) -> DataFrame:
    a = F.col(amount).cast("double")
    return df.withColumns({f"{amount}_log": F.log1p(a), "amount_per_year": a / at_least_one(F.col(duration))})


def bucketize(df: DataFrame, bins: dict[str, tuple[str, tuple]]) -> DataFrame:
    """``{new column: (column, (edges, labels))}`` with right-closed intervals."""
    return df.withColumns({new: right_closed_bin(F.col(c), *spec) for new, (c, spec) in bins.items()})


# ------------------------------------------------------------------ encoding

def categories(df: DataFrame, column: str, limit: int | None = None, bound: int = MAX_COLUMNS) -> list | None:
    """Sorted values, each of which becomes a column; None if there are more than ``limit``.

    No more than ``bound`` values are taken to the driver; a column with more
    of them is refused, not cut.
    """
    most = bound if limit is None else limit
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) <= most:
        return sorted(r[0] for r in rows)
    if limit is None:
        raise ValueError(f"{column} has more than {bound} values; encode it by labels or targets, or raise the bound")
    return None


def encode_categories(df: DataFrame, column: str, row_key: str, limit: int = MAX_ONEHOT) -> DataFrame:
    """One-hot columns up to ``limit`` values, else label codes under the column's name."""
    values = categories(df, column, limit)
    if values is not None:
        return one_hot(df, column, values)
    return label_encode(df, column, fit_labels(df, column), row_key, "_e").drop(column).withColumnRenamed("_e", column)


def one_hot(df: DataFrame, column: str, values: Sequence, drop_first: bool = True, prefix: str | None = None) -> DataFrame:
    """0/1 columns named prefix_value; values not listed give all zeros."""
    chosen = list(values)[1:] if drop_first else list(values)
    hot = {f"{prefix or column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in chosen}
    return df.withColumns(hot).drop(column)


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """value, code (place among the sorted values), n."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column)).agg(F.count(F.lit(1)).alias("n"))
    return row_numbers(values, [], [column], "_code").select(column, (F.col("_code") - 1).cast("int").alias("code"), "n")


def label_encode(df: DataFrame, column: str, labels: DataFrame, row_key: str, name: str) -> DataFrame:
    """Code of the value; unknown values get code 0."""
    table = labels.select(column, F.col("code").alias("_code"), F.col("n").alias("_n"))
    out = lookup_join(df, table, [column], row_key, weight="_n")
    return out.withColumn(name, F.coalesce("_code", F.lit(0))).drop("_code", "_n")


def fit_targets(df: DataFrame, column: str, target: str) -> DataFrame:
    """value, mean target, n."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.avg(F.col(target).cast("double")).alias("target_mean"), F.count(F.lit(1)).alias("n")))


def target_encode(df: DataFrame, column: str, fitted: DataFrame, row_key: str, name: str,
                  overall: Column | None = None) -> DataFrame:
    """Mean target of the category; unseen categories get the overall mean."""
    overall = overall if overall is not None else fitted.agg(
        F.sum(F.col("target_mean") * F.col("n")) / F.sum("n")).scalar()
    table = fitted.select(column, F.col("target_mean").alias("_mean"), F.col("n").alias("_n"))
    out = lookup_join(df, table, [column], row_key, weight="_n")
    return out.withColumn(name, F.coalesce("_mean", overall)).drop("_mean", "_n")


# ------------------------------------------------------------------ scaling

def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """feature, center, scale. A scale of zero becomes one, so constant columns map to zero."""
    if method == "robust":
        q = quantiles(df, columns, {"q1": 0.25, "center": 0.5, "q3": 0.75})
        out = q.select("feature", "center", (F.col("q3") - F.col("q1")).alias("scale"))
    else:
        aggs = []
        for i, c in enumerate(columns):
            x = F.col(c).cast("double")
            pair = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
            aggs += [pair[0].alias(f"c{i}"), pair[1].alias(f"s{i}")]
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("center"), F.col(f"s{i}").alias("scale"))
                         for i, c in enumerate(columns)])
        out = df.agg(*aggs).select(F.inline(rows))
    return out.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    entry = F.struct(F.col("feature"), F.struct("center", "scale"))
    look = fitted.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    return df.withColumns({f"{c}{suffix}": (F.col(c).cast("double") - look[c]["center"]) / look[c]["scale"] for c in columns})


# ------------------------------------------------------------------ the whole preprocessor

# Default choices of the preprocessor.
DEFAULTS = {"numeric": "median", "categorical": "mode", "scaling": "standard", "encoding": "onehot",
            "sparse_limit": SPARSE_LIMIT, "max_categories": MAX_ONEHOT, "outliers": None, "interactions": [], "select": None, "selection": "f"}


def add_interactions(df: DataFrame, pairs: Sequence[Sequence[str]]) -> DataFrame:
    """The product of each pair of columns, named a_x_b."""
    return df.withColumns({f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in pairs})


class Preprocessor:
    """clean, impute, date parts, bins, interactions, scale, encode, select; each step is fitted on the output of the one before.

    ``interactions`` are pairs of numerical columns; a pair with a dropped column is left out. ``select`` keeps that many of the
    features, those with the best ANOVA F (``selection="f"``) or mutual information ("mi") with the label, ties by name.
    """

    def __init__(self, key: str, as_of: str, dates: Sequence[str] = (), label: str | None = None,
                 bins: dict | None = None, **config):
        self.plan = {**DEFAULTS, **config, "key": key, "as_of": as_of, "dates": list(dates), "label": label,
                     "bins": bins or {}}

    def fit(self, df: DataFrame) -> "FittedPreprocessor":
        df = stored(df, "input")  # its joins run once, not for every step
        plan = dict(self.plan)
        fixed = [c for c in (plan["key"], plan["label"]) if c]
        body = df.drop(*fixed)
        drop = sparse_columns(body, plan["sparse_limit"])
        drop += [c for c in constant_columns(body) if c not in drop]
        plan["drop"] = drop
        kept = df.drop(*drop)
        plan["numbers"] = [c for c in numeric_columns(kept) if c not in fixed]
        plan["texts"] = [c for c in string_columns(kept) if c not in fixed]

        def strategy(s):
            return ("constant", "missing") if s == "constant" else s
        tables = {"impute": fit_imputer(kept, {**{c: strategy(plan["numeric"]) for c in plan["numbers"]},
                                               **{c: strategy(plan["categorical"]) for c in plan["texts"]}})}
        model = FittedPreprocessor(plan, tables)
        filled = model._derived(df)
        if plan["outliers"] == "cap":
            tables["bounds"] = outlier_bounds(filled, plan["numbers"])
            filled = cap_outliers(filled, plan["numbers"], tables["bounds"])
        plan["interactions"] = [list(p) for p in plan["interactions"] if set(p) <= set(plan["numbers"])]
        filled = add_interactions(filled, plan["interactions"])
        plan["encoded"] = {}
        for c in [*plan["texts"], *plan["bins"]]:
            values = categories(filled, c, plan["max_categories"])
            if plan["encoding"] == "target" and plan["label"]:
                plan["encoded"][c] = ["target"]
                tables[f"target_{c}"] = fit_targets(filled, c, plan["label"])
            elif plan["encoding"] == "onehot" and values is not None:
                plan["encoded"][c] = ["onehot", values]
            else:
                plan["encoded"][c] = ["label"]
                tables[f"label_{c}"] = fit_labels(filled, c)
        plan["scaled"] = [c for c in numeric_columns(filled) if c not in fixed]
        tables["scale"] = fit_scaler(filled, plan["scaled"], plan["scaling"])
        if plan["select"] and plan["label"]:
            whole = model.transform(df)
            features = [c for c in numeric_columns(whole) if c not in fixed]
            whole = stored(whole.select(plan["label"], *features), "features")
            scores = {"f": anova_f, "mi": mutual_information}[plan["selection"]](whole, features, plan["label"])
            tables["scores"] = stored(scores, "scores")
            # one row per column
            best = {r["feature"] for r in top_features(tables["scores"].where(F.col("score").isNotNull()), plan["select"]).collect()}
            plan["selected"] = [c for c in features if c in best]
        return model


class FittedPreprocessor:
    def __init__(self, plan: dict, tables: dict[str, DataFrame]):
        self.plan, self.tables = plan, tables

    def _derived(self, df: DataFrame) -> DataFrame:
        p = self.plan
        out = apply_imputer(df.drop(*p["drop"]), self.tables["impute"], [*p["numbers"], *p["texts"]])
        out = date_parts(out, p["dates"], p["as_of"]).drop(*p["dates"])
        return bucketize(out, {n: (c, (tuple(e), tuple(labels))) for n, (c, (e, labels)) in p["bins"].items()})

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.plan
        out = self._derived(df)
        if "bounds" in self.tables:
            out = cap_outliers(out, p["numbers"], self.tables["bounds"])
        out = add_interactions(out, p["interactions"])
        out = apply_scaler(out, self.tables["scale"], p["scaled"])
        for c, how in p["encoded"].items():
            if how[0] == "onehot":
                out = one_hot(out, c, how[1])
            elif how[0] == "target":
                out = target_encode(out, c, self.tables[f"target_{c}"], p["key"], "_e").drop(c).withColumnRenamed("_e", c)
            else:
                out = label_encode(out, c, self.tables[f"label_{c}"], p["key"], "_e").drop(c).withColumnRenamed("_e", c)
        if "selected" in p:
            out = out.select(*[c for c in (p["key"], p["label"]) if c in out.columns], *p["selected"])
        return out

    def importance(self) -> DataFrame:
        """feature, importance, selected of the features that selection chose from."""
        return self.tables["scores"].select("feature", F.col("score").alias("importance"), F.col("feature").isin(self.plan["selected"]).alias("selected"))

    def summary(self, spark: SparkSession) -> DataFrame:
        p = self.plan
        row = (len(p["drop"]), len(p["numbers"]), len(p["texts"]), p["scaling"], p["encoding"])
        return spark.createDataFrame([row], "dropped int, numerical int, categorical int, scaling string, encoding string")

    def save(self, spark: SparkSession, path: str) -> None:
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps({"plan": self.plan, "tables": list(self.tables)}),)], "plan string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/plan")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedPreprocessor":
        saved = json.loads(spark.read.text(f"{path}/plan").first()[0])
        return cls(saved["plan"], {n: spark.read.parquet(f"{path}/{n}") for n in saved["tables"]})
