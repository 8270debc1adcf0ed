"""Consistency: mixed kinds of text values, and numeric values outside fences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import fixed
from tabgauge.functions.columns import kind_of, percent, present
from tabgauge.functions.scoring import step_score
from tabgauge.functions.text import TYPE_CLASSES, type_class
from tabgauge.operators.measures import SIZE, VALUE, Measures, combined, count_where, measure
from tabgauge.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]

# Quartiles by column; None for a column without values.
Quartiles = dict[str, list[float | None]]


def _types(kind: str):
    if kind != "Text":
        return {}, {}
    return (
        {"class": type_class(F.col(VALUE))},
        {f"{c}_values": F.count_if(F.col("class") == c) for c in TYPE_CLASSES},
    )


# Values per class of text; a typed column holds its own type only.
TYPES = Measures({f"{c}_values": "bigint" for c in TYPE_CLASSES}, _types)


def with_type_consistency(measured: DataFrame) -> DataFrame:
    """Add the classes found, their number as a score and the dominant share."""
    counts = [F.coalesce(F.col(f"{c}_values"), F.lit(0)) for c in TYPE_CLASSES]
    found = F.array_compact(
        F.array(*[F.when(F.col(f"{c}_values") > 0, F.lit(c)) for c in TYPE_CLASSES])
    )
    types = F.when(F.col("kind") != "Text", F.array("dtype")).otherwise(found)
    total = sum(counts[1:], counts[0])
    kinds = F.size(types)
    return measured.withColumns(
        {
            "types_found": types,
            "mixed_types": kinds > 1,
            "type_score": F.when(kinds <= 1, 100.0).otherwise(100.0 - (kinds - 1) * 20.0),
            "consistency_percentage": percent(F.greatest(*counts), total, 100.0),
        }
    )


def type_consistency(df: DataFrame) -> DataFrame:
    """Per column: classes found, whether mixed, score and dominant share."""
    return with_type_consistency(measure(df, TYPES)).select(
        "ordinal", "column", "types_found", "mixed_types", "type_score", "consistency_percentage"
    )


def _spread(kind: str):
    if kind != "Numeric":
        return {}, {}
    deviation = F.coalesce(F.stddev_samp(VALUE), F.lit(0.0))
    return {}, {
        "min": F.min(VALUE),
        "max": F.max(VALUE),
        "mean": F.avg(VALUE),
        "std": F.when(F.count(VALUE) > 0, deviation),
    }


# Extremes, mean and deviation of numeric columns.
SPREAD = Measures({n: "double" for n in ("min", "max", "mean", "std")}, _spread)


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if kind_of(f.dataType) == "Numeric"]


def quartiles(df: DataFrame) -> Quartiles:
    return exact_quantiles(df, {f.name: present(f) for f in numeric_fields(df)}, QUARTILES)


def outside_fences(df: DataFrame, found: Quartiles) -> dict[str, Column]:
    """Per numeric column: lies the value outside the fences?"""
    conditions = {}
    for field in numeric_fields(df):
        low, _, high = found[field.name]
        if low is not None:
            reach = fixed.IQR_FACTOR * (high - low) if high > low else 0.0
            value = present(field).cast("double")
            conditions[field.name] = (value < low - reach) | (value > high + reach)
    return conditions


def with_quartiles(measured: DataFrame, found: Quartiles) -> DataFrame:
    """Add the quartiles found before to the rows of their columns."""
    rows = pa.table(
        {
            "column": pa.array(list(found), pa.string()),
            **{
                n: pa.array([q[i] for q in found.values()], pa.float64())
                for i, n in enumerate(("q1", "median", "q3"))
            },
        }
    )
    return measured.join(F.broadcast(measured.sparkSession.createDataFrame(rows)), "column", "left")


def with_counts(measured: DataFrame, df: DataFrame, conditions: dict[str, dict[str, Column]]) -> DataFrame:
    """Add the number of rows meeting each condition."""
    if not any(conditions.values()):
        return measured.withColumns({n: F.lit(None).cast("bigint") for n in conditions})
    counted = count_where(df, conditions).drop("column")
    return measured.join(F.broadcast(counted), "ordinal", "left")


def with_value_consistency(measured: DataFrame) -> DataFrame:
    """Add outlier share and score; a numeric column without values scores 100."""
    outliers = F.when(F.col("kind") == "Numeric", F.coalesce("iqr_outlier_count", F.lit(0)))
    share = percent(outliers, F.col("row_count") - F.col("missing_count"), 0.0)
    share = F.when(F.col("kind") == "Numeric", share)
    return measured.withColumns(
        {
            "iqr_outlier_count": outliers,
            "iqr_outlier_percentage": share,
            "value_score": step_score(100.0 - share, "value_consistency"),
        }
    )


def value_consistency(df: DataFrame) -> DataFrame:
    """Range statistics, outlier count and score of each numeric column."""
    found = quartiles(df)
    measured = with_quartiles(measure(df, combined(SIZE, SPREAD), numeric_fields(df)), found)
    counted = with_counts(measured, df, {"iqr_outlier_count": outside_fences(df, found)})
    return with_value_consistency(counted)


def numeric_ranges(df: DataFrame) -> DataFrame:
    return value_consistency(df).select("ordinal", "column", "min", "max", "mean", "median", "std")


def iqr_outliers(df: DataFrame) -> DataFrame:
    return value_consistency(df).select(
        "ordinal", "column", "q1", "q3", "iqr_outlier_count", "iqr_outlier_percentage", "value_score"
    )


def overall_from_columns(columns: DataFrame, *keys: str) -> DataFrame:
    """Mean of the type scores, of the value scores and of both together."""
    both = F.coalesce(F.sum("type_score"), F.lit(0.0)) + F.coalesce(F.sum("value_score"), F.lit(0.0))
    return columns.groupBy(*keys).agg(
        F.coalesce(F.avg("type_score"), F.lit(100.0)).alias("type_consistency_score"),
        F.coalesce(F.avg("value_score"), F.lit(100.0)).alias("value_consistency_score"),
        F.coalesce(
            both / F.nullif(F.count("type_score") + F.count("value_score"), F.lit(0)), F.lit(100.0)
        ).alias("consistency_score"),
    )


def consistency_overall(df: DataFrame) -> DataFrame:
    measured = measure(df, combined(SIZE, TYPES))
    counted = with_counts(measured, df, {"iqr_outlier_count": outside_fences(df, quartiles(df))})
    return overall_from_columns(with_value_consistency(with_type_consistency(counted)))
