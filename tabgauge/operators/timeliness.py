"""Timeliness: how recent the dates of a table are, seen from a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.columns import percent
from tabgauge.functions.dates import elapsed_days, moment, parse_date
from tabgauge.functions.scoring import age_category, age_score
from tabgauge.operators.measures import VALUE, Measures, combined, measure
from tabgauge.operators.schema import DATE_LIKE, is_likely_date

OUTDATED_DAYS = 365


def dates(as_of=None) -> Measures:
    """Valid dates, the earliest, the latest and how many are outdated."""

    def of_kind(kind: str):
        if kind not in ("DateTime", "Text"):
            return {}, {}
        value = F.col(VALUE)
        return (
            {"when": parse_date(value) if kind == "Text" else value},
            {
                "valid_dates": F.count("when"),
                "earliest": F.min("when"),
                "latest": F.max("when"),
                "outdated_dates": F.count_if(
                    elapsed_days(moment(as_of), F.col("when")) > OUTDATED_DAYS
                ),
            },
        )

    types = {"valid_dates": "bigint", "earliest": "timestamp", "latest": "timestamp"}
    return Measures(types | {"outdated_dates": "bigint"}, of_kind)


def with_timeliness(measured: DataFrame, as_of=None) -> DataFrame:
    """Add span, age, score and category; NULL for columns that hold no dates."""
    first, last = F.col("earliest"), F.col("latest")
    span = F.when(last > first, elapsed_days(last, first)).otherwise(F.lit(0).cast("bigint"))
    age = elapsed_days(moment(as_of), last)
    derived = {
        "min_date": F.date_format(first, "yyyy-MM-dd"),
        "max_date": F.date_format(last, "yyyy-MM-dd"),
        "time_span_days": span,
        "recency_days": age,
        "timeliness_score": age_score(age),
        "timeliness_category": age_category(age),
        "outdated_percentage": percent(F.col("outdated_dates"), F.col("valid_dates"), 0.0),
    }
    is_date = (F.col("kind") == "DateTime") | is_likely_date()
    return measured.withColumn("is_date", is_date).withColumns(
        {name: F.when(F.col("is_date"), column) for name, column in derived.items()}
    )


def _measured(df: DataFrame, as_of) -> DataFrame:
    return with_timeliness(measure(df, combined(DATE_LIKE, dates(as_of))), as_of)


def timeliness_columns(df: DataFrame, as_of=None) -> DataFrame:
    """Date range, age, score and category per date column."""
    return (
        _measured(df, as_of)
        .where("is_date")
        .select(
            "ordinal", "column", "min_date", "max_date", "time_span_days",
            "recency_days", "timeliness_score", "timeliness_category",
        )
    )


def overall_from_columns(columns: DataFrame, *keys: str) -> DataFrame:
    found = F.count_if("is_date")
    return columns.groupBy(*keys).agg(
        found.alias("date_columns_found"),
        F.avg("timeliness_score").alias("timeliness_score"),
        F.when(found == 0, "No date columns")
        .otherwise("Assessed")
        .alias("timeliness_message"),
    )


def timeliness_overall(df: DataFrame, as_of=None) -> DataFrame:
    """Mean score of the date columns; NULL when there is none."""
    return overall_from_columns(_measured(df, as_of))


def date_ranges(df: DataFrame, as_of=None) -> DataFrame:
    """Chart data: first and last date per date column."""
    return (
        timeliness_columns(df, as_of)
        .where("min_date IS NOT NULL")
        .select("column", "min_date", "max_date")
    )
