"""Declarative schemas and rules; every check of a table is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.columns import is_number_text, missing, violated

INTEGER_PATTERN = r"^\s*[-+]?\d+\s*$"


@dataclass(frozen=True)
class FieldRule:
    """What one field must satisfy. ``type`` is one of string, integer, float,
    boolean, date, datetime, categorical."""

    name: str
    type: str = "string"
    required: bool = True
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: tuple | None = None
    pattern: str | None = None
    description: str | None = None


# The default claims schema.
CLAIMS_SCHEMA = (
    FieldRule("claim_id"),
    FieldRule("claim_amount", "float", min_value=0),
    FieldRule("claim_type", "categorical", allowed_values=("auto", "home", "health", "life")),
    FieldRule("customer_id"),
    FieldRule("customer_age", "integer", min_value=18, max_value=120),
    FieldRule("policy_duration", "integer", min_value=0),
    FieldRule("region", "categorical", allowed_values=("north", "south", "east", "west", "central")),
    FieldRule("claim_date", "date"),
    FieldRule("claim_description", required=False),
    FieldRule("customer_segment", "categorical", required=False, allowed_values=("premium", "standard", "basic")),
    FieldRule("risk_level", "categorical", required=False, allowed_values=("low", "high")),
)


def schema_from_dict(spec: dict[str, dict]) -> tuple[FieldRule, ...]:
    def rule(name: str, options: dict) -> FieldRule:
        options = dict(options or {})
        if options.get("allowed_values") is not None:
            options["allowed_values"] = tuple(options["allowed_values"])
        return FieldRule(name, **options)
    return tuple(rule(n, o) for n, o in spec.items())


def schema_to_dict(fields: Sequence[FieldRule]) -> dict[str, dict]:
    """Inverse of schema_from_dict; unset options are left out."""
    out = {}
    for f in fields:
        options = {k: v for k, v in asdict(f).items() if k != "name" and v is not None}
        if f.allowed_values is not None:
            options["allowed_values"] = list(f.allowed_values)
        out[f.name] = options
    return out


def load_schema(path: str) -> tuple[FieldRule, ...]:
    with open(path) as fh:
        return schema_from_dict(yaml.safe_load(fh))


def export_schema(fields: Sequence[FieldRule], path: str) -> None:
    with open(path, "w") as fh:
        yaml.safe_dump(schema_to_dict(fields), fh, sort_keys=False)


SPARK_TYPES = {"string": T.StringType(), "categorical": T.StringType(), "integer": T.LongType(),
               "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
               "datetime": T.TimestampNTZType()}


def to_struct(fields: Sequence[FieldRule]) -> T.StructType:
    """Spark schema whose field metadata keeps the rules."""
    return T.StructType([
        T.StructField(f.name, SPARK_TYPES[f.type], f.nullable, schema_to_dict([f])[f.name]) for f in fields])


def schema_summary(fields: Sequence[FieldRule]) -> dict[str, list[str]]:
    def names(test):
        return [f.name for f in fields if test(f)]
    return {"required": names(lambda f: f.required), "optional": names(lambda f: not f.required),
            "nullable": names(lambda f: f.nullable), "categorical": names(lambda f: f.type == "categorical"),
            "numeric": names(lambda f: f.type in ("integer", "float"))}


def column_presence(df: DataFrame, fields: Sequence[FieldRule]) -> DataFrame:
    """One row per declared or present column: missing, unexpected or present, and the record count."""
    declared = {f.name: f for f in fields}
    status = []
    for f in fields:
        state = "present" if f.name in df.columns else ("missing" if f.required else "absent_optional")
        status.append((f.name, state))
    status += [(c, "unexpected") for c in df.columns if c not in declared]
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(s).alias("status")) for n, s in status])
    return (df.agg(F.count(F.lit(1)).alias("total_records"))
            .select(F.inline(rows), "total_records"))


def rule_violations(df: DataFrame, fields: Sequence[FieldRule]) -> list[tuple[str, str, Column]]:
    """(field, rule, condition of a bad row) for the declared fields that are present."""
    out = []
    for f in (f for f in fields if f.name in df.columns):
        c, kind = F.col(f.name), df.schema[f.name].dataType
        null = missing(df, f.name)
        text = isinstance(kind, T.StringType)
        number = isinstance(kind, T.NumericType)
        if not f.nullable:
            out.append((f.name, "null", null))
        if f.type == "integer" and not isinstance(kind, T.IntegralType):
            out.append((f.name, "type", ~null & ~c.rlike(INTEGER_PATTERN) if text else ~null))
        elif f.type == "float" and not number:
            out.append((f.name, "type", ~null & ~is_number_text(c) if text else ~null))
        elif f.type in ("date", "datetime"):
            if text:
                out.append((f.name, "date", ~null & F.try_to_timestamp(c).isNull()))
            elif not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                out.append((f.name, "date", ~null))
        if number and f.min_value is not None:
            out.append((f.name, "min", ~null & (c < f.min_value)))
        if number and f.max_value is not None:
            out.append((f.name, "max", ~null & (c > f.max_value)))
        if f.allowed_values is not None:
            out.append((f.name, "allowed", ~null & ~c.isin(list(f.allowed_values))))
        if f.pattern is not None:
            out.append((f.name, "pattern", ~null & ~c.cast("string").rlike(f"^(?:{f.pattern})")))
    return out


def count_conditions(df: DataFrame, conditions: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(field, rule, n_bad, n_rows) for all conditions in one pass."""
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    *[F.count_if(cond).alias(f"b{i}") for i, (_, _, cond) in enumerate(conditions)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.col(f"b{i}").alias("n_bad"))
                     for i, (f, r, _) in enumerate(conditions)])
    return totals.select(F.inline(rows), "n_rows")


def rule_counts(df: DataFrame, fields: Sequence[FieldRule], rules: Sequence[str] | None = None) -> DataFrame:
    conditions = [c for c in rule_violations(df, fields) if rules is None or c[1] in rules]
    return count_conditions(df, conditions)


def validation_report(df: DataFrame, fields: Sequence[FieldRule]) -> DataFrame:
    """Per field: valid, errors (broken rules in order), bad values; missing required fields are invalid."""
    counts = rule_counts(df, fields)
    found = (counts.groupBy("field").agg(
        (F.sum("n_bad") == 0).alias("is_valid"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_bad") > 0, F.col("rule")))), ",").alias("errors"),
        F.sum("n_bad").alias("n_bad")))
    extra = column_presence(df, fields).select(
        "field", (F.col("status") != "missing").alias("present_ok"),
        F.when(F.col("status") == "unexpected", "unexpected").otherwise("").alias("warning"), "total_records")
    return (extra.join(found, "field", "left").select(
        "field", (F.col("present_ok") & F.coalesce("is_valid", F.lit(True))).alias("is_valid"),
        F.when(F.col("present_ok"), F.coalesce("errors", F.lit(""))).otherwise("missing").alias("errors"),
        "warning", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"), "total_records"))


def disallowed_values(df: DataFrame, column: str, allowed: Sequence | DataFrame) -> DataFrame:
    """Values outside the allowed set with their counts; the set may be a table."""
    rows = df.where(F.col(column).isNotNull())
    if isinstance(allowed, DataFrame):
        rows = rows.join(allowed.toDF(column), column, "left_anti")
    else:
        rows = rows.where(~F.col(column).isin(list(allowed)))
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def parse_json(df: DataFrame, column: str, fields: Sequence[FieldRule]) -> DataFrame:
    """JSON text to the declared columns; ``_corrupt`` holds text that is not valid JSON."""
    struct = T.StructType([T.StructField(f.name, t.dataType, True) for f, t in zip(fields, to_struct(fields))]
                          + [T.StructField("_corrupt", T.StringType(), True)])
    parsed = F.from_json(F.col(column), struct, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_json", parsed).select(*df.columns, "_json.*")


# Accepted values of a scoring request.
REQUEST_REGIONS = ("North", "South", "East", "West", "Central")
REQUEST_TYPES = ("Auto", "Home", "Health", "Life", "Commercial")
REQUEST_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
                "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def request_rules(columns: dict[str, str] | None = None, regions: Sequence[str] = REQUEST_REGIONS,
                  types: Sequence[str] = REQUEST_TYPES, days: Sequence[str] = REQUEST_DAYS,
                  only: Sequence[str] | None = None) -> dict[str, Column]:
    """Row rules of a scoring request. ``columns`` maps rule fields to columns of the table."""
    names = columns or {}

    def c(field: str) -> Column:
        return F.col(names.get(field, field))

    def optional(field: str, test) -> Column:
        return c(field).isNull() | test(c(field))

    rules = {
        "claim_id": lambda: F.length(F.trim(c("claim_id").cast("string"))) > 0,
        "claim_amount": lambda: c("claim_amount") > 0,
        "claimant_age": lambda: c("claimant_age").between(0, 120),
        "policy_duration_months": lambda: c("policy_duration_months") >= 0,
        "previous_claims": lambda: c("previous_claims") >= 0,
        "region": lambda: c("region").isin(list(regions)),
        "claim_type": lambda: c("claim_type").isin(list(types)),
        "day_of_week": lambda: c("day_of_week").isin(list(days)),
        "claim_description": lambda: F.length(F.trim(c("claim_description"))) >= 10,
        "policy_premium": lambda: optional("policy_premium", lambda x: x > 0),
        "deductible_amount": lambda: optional("deductible_amount", lambda x: x >= 0),
    }
    return {k: rule() for k, rule in rules.items() if only is None or k in only}


def mark_violations(df: DataFrame, rules: dict[str, Column], name: str = "violations") -> DataFrame:
    return df.withColumn(name, violated(rules))


def split_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the broken rules)."""
    marked = mark_violations(df, rules)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def business_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule; a rule that cannot be decided counts as broken."""
    return count_conditions(df, [("row", r, ~F.coalesce(ok, F.lit(False))) for r, ok in rules.items()]).drop("field")


def threshold_gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value) rows against ``{metric: (operator, limit)}``; adds limit and passed.

    Every threshold has a row: one whose metric is absent or null has not passed.
    """
    gates = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(v)).alias("limit"), F.lit(o).alias("_op")) for m, (o, v) in thresholds.items()])
    v, lim, o = F.col("value"), F.col("limit"), F.col("_op")
    passed = F.when(o == "<", v < lim).when(o == "<=", v <= lim).when(o == ">", v > lim).when(o == ">=", v >= lim)
    rows = metrics.sparkSession.range(1).select(F.inline(gates)).join(metrics, "metric", "left")
    return rows.select(*metrics.columns, "limit", F.coalesce(passed, F.lit(False)).alias("passed"))


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return df.where(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_anti")


def freshness(df: DataFrame, ts: str, as_of: str, max_age_days: int) -> DataFrame:
    """Newest row, its age in days and whether it is fresh enough."""
    newest = df.agg(F.max(ts).alias("newest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("newest").cast("date"))
    return newest.select("newest", age.alias("age_days"), (age <= max_age_days).alias("fresh"))
