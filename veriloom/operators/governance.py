"""Privacy jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.lexicon import ENTITIES, as_re2

# Patterns and masks, specific ones before amounts. An amount needs a digit here,
# so that commas of the prose stay.
MASKS = ((ENTITIES["phone_numbers"], "[PHONE]"), (ENTITIES["dates_mentioned"], "[DATE]"), (ENTITIES["times_mentioned"], "[TIME]"),
         (ENTITIES["license_plates"], "[PLATE]"), (r"\$?\d[\d,]*\.?\d*", "[AMOUNT]"))


def pseudonymize(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Replaces identifiers by a salted SHA-256."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})


def anonymize(df: DataFrame, text: str) -> DataFrame:
    """Masks phone numbers, dates, times, plates and amounts in text."""
    masked = reduce(lambda c, m: F.regexp_replace(c, as_re2(m[0]), m[1]), MASKS, F.col(text))
    return df.withColumn(text, masked)


def erase(df: DataFrame, key: str, subjects: DataFrame) -> DataFrame:
    """Rows of all other subjects; the caller writes them over the table."""
    return df.join(subjects.select(F.col(subjects.columns[0]).alias("_s")), F.col(key) == F.col("_s"), "left_anti")


def subject_rows(df: DataFrame, key: str, subjects: DataFrame) -> DataFrame:
    return df.join(subjects.select(F.col(subjects.columns[0]).alias("_s")), F.col(key) == F.col("_s"), "left_semi")


def export_subject(tables: dict[str, tuple[DataFrame, str]], subjects: DataFrame) -> DataFrame:
    """(table_name, subject, record as JSON) of the subjects' rows in every table."""
    parts = [subject_rows(df, key, subjects).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("subject"),
                                                    F.to_json(F.struct("*")).alias("record"))
             for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionAll, parts)
