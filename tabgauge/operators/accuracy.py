"""Accuracy: distant numeric values and capitalisation of text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import fixed
from tabgauge.functions.columns import kind_of, percent, present
from tabgauge.functions.scoring import step_score
from tabgauge.functions.text import is_lower, is_title, is_upper
from tabgauge.operators.consistency import SPREAD, numeric_fields, with_counts
from tabgauge.operators.measures import SIZE, VALUE, Measures, combined, measure

Moments = dict[str, tuple[float | None, float | None]]


def moments(df: DataFrame) -> Moments:
    """Mean and standard deviation per numeric column: one row per column."""
    fields = numeric_fields(df)
    if not fields:
        return {}
    rows = measure(df, SPREAD, fields).select("column", "mean", "std").collect()
    return {r["column"]: (r["mean"], r["std"]) for r in rows}


def far_from_mean(
    df: DataFrame, found: Moments, limit: float = fixed.Z_LIMIT
) -> dict[str, Column]:
    """Per numeric column with values: is it more than ``limit`` deviations off?"""
    conditions = {}
    for field in numeric_fields(df):
        mean, std = found.get(field.name, (None, None))
        if mean is not None:
            value = present(field).cast("double")
            # an infinite value leaves no deviation to measure by
            usable = std > 0 and math.isfinite(mean) and math.isfinite(std)
            distance = F.abs((value - mean) / std) if usable else F.lit(0.0)
            conditions[field.name] = distance > limit
    return conditions


def with_numeric_accuracy(measured: DataFrame) -> DataFrame:
    share = percent(F.col("z_outlier_count"), F.col("row_count") - F.col("missing_count"))
    return measured.withColumns(
        {
            "z_outlier_percentage": share,
            "numeric_accuracy_score": step_score(100.0 - share, "numeric_accuracy"),
        }
    )


def zscore_outliers(df: DataFrame, z_limit: float = fixed.Z_LIMIT) -> DataFrame:
    """Distant values per numeric column; columns without values are left out."""
    measured = measure(df, SIZE, numeric_fields(df))
    distant = {"z_outlier_count": far_from_mean(df, moments(df), z_limit)}
    return (
        with_numeric_accuracy(with_counts(measured, df, distant))
        .where("z_outlier_count IS NOT NULL")
        .select("ordinal", "column", "z_outlier_count", "z_outlier_percentage", "numeric_accuracy_score")
    )


def _styles(kind: str):
    if kind != "Text":
        return {}, {}
    text = F.col(VALUE)
    tests = {"lower": is_lower(text), "upper": is_upper(text), "title": is_title(text)}
    return tests, {f"{style}_count": F.count_if(F.col(style)) for style in tests}


# Text values in lower case, upper case and title case.
STYLES = Measures({f"{s}_count": "bigint" for s in ("lower", "upper", "title")}, _styles)


def with_text_accuracy(measured: DataFrame) -> DataFrame:
    leading = F.greatest("lower_count", "upper_count", "title_count")
    share = percent(leading, F.col("row_count") - F.col("missing_count"))
    return measured.withColumns(
        {
            "style_percentage": share,
            "text_accuracy_score": step_score(share, "text_accuracy"),
        }
    )


def text_style(df: DataFrame) -> DataFrame:
    """Share of the leading capitalisation style per text column."""
    fields = [f for f in df.schema.fields if kind_of(f.dataType) == "Text"]
    measured = measure(df, combined(SIZE, STYLES), fields)
    return (
        with_text_accuracy(measured)
        .where("row_count > missing_count")
        .select(
            "ordinal", "column", "lower_count", "upper_count", "title_count",
            "style_percentage", "text_accuracy_score",
        )
    )


def overall_from_columns(columns: DataFrame, *keys: str) -> DataFrame:
    numeric, text = "numeric_accuracy_score", "text_accuracy_score"
    both = F.coalesce(F.sum(numeric), F.lit(0.0)) + F.coalesce(F.sum(text), F.lit(0.0))
    return columns.groupBy(*keys).agg(
        F.coalesce(F.avg(numeric), F.lit(100.0)).alias("numeric_accuracy_score"),
        F.coalesce(F.avg(text), F.lit(100.0)).alias("text_accuracy_score"),
        F.coalesce(
            both / F.nullif(F.count(numeric) + F.count(text), F.lit(0)), F.lit(100.0)
        ).alias("accuracy_score"),
    )


def accuracy_overall(df: DataFrame, z_limit: float = fixed.Z_LIMIT) -> DataFrame:
    measured = measure(df, combined(SIZE, STYLES))
    distant = {"z_outlier_count": far_from_mean(df, moments(df), z_limit)}
    counted = with_counts(measured, df, distant)
    return overall_from_columns(with_text_accuracy(with_numeric_accuracy(counted)))
