"""Validity: formats and ranges chosen by column name, and rules of the user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import fixed
from tabgauge.functions.columns import kind_of, percent, present, ref
from tabgauge.functions.scoring import step_score, validity_status
from tabgauge.functions.text import matches
from tabgauge.operators.consistency import with_counts
from tabgauge.operators.measures import SIZE, measure


@dataclass(frozen=True)
class Checks:
    """Checks by word in the column name, tried in order; the first fits."""

    formats: tuple = fixed.FORMAT_CHECKS
    ranges: tuple = fixed.RANGE_CHECKS

    def choose(self, field: T.StructField) -> tuple[str, str, Column] | None:
        """Name of the check, kind of steps and condition for a column."""
        name, kind = field.name.lower(), kind_of(field.dataType)
        if kind == "Text":
            for check, words, pattern in self.formats:
                if any(word in name for word in words):
                    return check, "format", matches(ref(field.name), pattern)
        if kind == "Numeric":
            for check, words, low, high in self.ranges:
                if any(word in name for word in words):
                    return check, "range", present(field).between(low, high)
        return None


def valid_values(df: DataFrame, checks: Checks = Checks()) -> dict[str, Column]:
    """Per checked column: is the value valid?"""
    chosen = {f.name: checks.choose(f) for f in df.schema.fields}
    return {name: found[2] for name, found in chosen.items() if found is not None}


def with_validity(measured: DataFrame, df: DataFrame, checks: Checks = Checks()) -> DataFrame:
    """Add check, share and score; all NULL where nothing could be checked."""
    kinds, steps = F.lit(None).cast("string"), F.lit(None).cast("string")
    for field in df.schema.fields:
        found = checks.choose(field)
        if found is not None:
            here = F.col("column") == field.name
            kinds = F.when(here, found[0]).otherwise(kinds)
            steps = F.when(here, found[1]).otherwise(steps)
    share = percent(F.col("valid_count"), F.col("row_count") - F.col("missing_count"))
    return measured.withColumns({"check_type": kinds, "check_steps": steps, "validity_percentage": share}).withColumn(
        "validity_score",
        F.when(F.col("check_steps") == "format", step_score(F.col("validity_percentage"), "format"))
        .when(F.col("check_steps") == "range", step_score(F.col("validity_percentage"), "range")),
    )


def validity_columns(df: DataFrame, checks: Checks = Checks()) -> DataFrame:
    """Check, valid values, share, score and status per checked column."""
    valid = valid_values(df, checks)
    fields = [f for f in df.schema.fields if f.name in valid] or df.schema.fields[:1]
    counted = with_counts(measure(df, SIZE, fields), df, {"valid_count": valid})
    return (
        with_validity(counted, df, checks)
        .where("validity_score IS NOT NULL")
        .select(
            "ordinal", "column", "check_type", "valid_count", "validity_percentage",
            "validity_score", validity_status(F.col("validity_percentage")).alias("status"),
        )
    )


def overall_from_columns(columns: DataFrame, *keys: str) -> DataFrame:
    return columns.groupBy(*keys).agg(
        F.count("validity_score").alias("checks_performed"),
        F.coalesce(F.avg("validity_score"), F.lit(100.0)).alias("validity_score"),
    )


def validity_overall(df: DataFrame, checks: Checks = Checks()) -> DataFrame:
    """Number of checks and mean score; 100 when nothing was checked."""
    return overall_from_columns(validity_columns(df, checks))


def business_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Violations per rule; a rule is an SQL condition that should hold.

    A row on which a rule is NULL cannot be judged and is not counted.
    """
    names = list(rules)
    counted = df.agg(
        *[F.count(F.expr(rules[n])).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count_if(~F.expr(rules[n])).alias(f"v{i}") for i, n in enumerate(names)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(n).alias("rule"),
            F.col(f"n{i}").alias("checked_rows"),
            F.col(f"v{i}").alias("violations"),
            percent(F.col(f"v{i}"), F.col(f"n{i}"), 0.0).alias("violation_percentage"),
        )
        for i, n in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*rows)))
