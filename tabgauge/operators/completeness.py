"""Completeness: missing values per table and column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.columns import missing, percent, ref
from tabgauge.functions.scoring import step_score
from tabgauge.operators.measures import SIZE, measure


def with_completeness(measured: DataFrame) -> DataFrame:
    """Add share and score to rows holding row and missing counts."""
    share = F.coalesce(
        100.0 * (1.0 - F.col("missing_count") / F.nullif(F.col("row_count"), F.lit(0))),
        F.lit(100.0),
    )
    return measured.withColumn("completeness_percentage", share).withColumn(
        "completeness_score", step_score(F.col("completeness_percentage"), "completeness")
    )


def completeness_columns(df: DataFrame) -> DataFrame:
    """Missing count, share of values present and score per column."""
    return with_completeness(measure(df, SIZE)).drop("dtype", "kind")


def completeness_overall(df: DataFrame) -> DataFrame:
    """The same over all cells of the table."""
    return overall_from_columns(completeness_columns(df))


def overall_from_columns(columns: DataFrame, *keys: str) -> DataFrame:
    totals = columns.groupBy(*keys).agg(
        F.sum("row_count").alias("total_cells"),
        F.sum("missing_count").alias("missing_cells"),
    )
    renamed = totals.withColumnsRenamed(
        {"total_cells": "row_count", "missing_cells": "missing_count"}
    )
    return with_completeness(renamed).withColumnsRenamed(
        {"row_count": "total_cells", "missing_count": "missing_cells"}
    )


def top_incomplete(df: DataFrame, rows: int = 5) -> DataFrame:
    """The columns with the lowest share of values present."""
    return (
        completeness_columns(df)
        .where("completeness_percentage < 100")
        .orderBy("completeness_percentage", "ordinal")
        .limit(rows)
        .select("column", "completeness_percentage")
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and share, worst first."""
    return (
        measure(df, SIZE)
        .where("missing_count > 0")
        .select(
            "column",
            "missing_count",
            F.round(percent(F.col("missing_count"), F.col("row_count")), 2).alias(
                "missing_percentage"
            ),
        )
        .orderBy(F.desc("missing_count"), "column")
    )


def valid_and_missing(df: DataFrame) -> DataFrame:
    """Chart data: valid and missing values per column."""
    return measure(df, SIZE).select(
        "column",
        (F.col("row_count") - F.col("missing_count")).alias("valid"),
        F.col("missing_count").alias("missing"),
        percent(F.col("row_count") - F.col("missing_count"), F.col("row_count"), 100.0).alias(
            "complete_percentage"
        ),
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing columns, as a string of 0 and 1.

    Counted before the shuffle, so that a pattern shared by most rows moves as
    one row per task.
    """
    flags = F.concat(*[missing(f).cast("int").cast("string") for f in df.schema.fields])
    return df.select(flags.alias("pattern")).groupBy("pattern").count()


def missing_sample(df: DataFrame, key: list[str], rows: int = 100, seed: int = 42) -> DataFrame:
    """0/1 per cell for a repeatable sample of rows."""
    flags = [missing(f).cast("int").alias(f.name) for f in df.schema.fields]
    drawn = F.md5(F.concat_ws(":", F.lit(seed), *[ref(k).cast("string") for k in key]))
    return df.orderBy(drawn, *[ref(k) for k in key]).limit(rows).select(*flags)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any missing value, and their share."""
    complete = reduce(lambda a, b: a & b, [~missing(f) for f in df.schema.fields])
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(complete).alias("complete_rows"),
    )
    return counted.withColumn(
        "complete_rows_percentage",
        percent(F.col("complete_rows"), F.col("total_rows"), 100.0),
    )
