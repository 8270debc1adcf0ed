"""Report rows: what a written report would show, as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import scoring
from tabgauge.plans import summary
from tabgauge.plans.assess import Assessment


def report(result: Assessment) -> DataFrame:
    """(section, table, item, value, status) for every statement of a report."""
    columns, tables = result.columns, result.tables
    parts = [
        _rows("size", tables, F.lit("rows"), F.col("total_rows")),
        _rows("size", tables, F.lit("columns"), F.col("column_count")),
    ]
    overall = summary.overall_scores(result)
    parts.append(
        overall.select(
            F.lit("summary").alias("section"),
            F.lit(None).cast("string").alias("table"),
            F.col("dimension").alias("item"),
            scoring.score_text(F.col("score")).alias("value"),
            scoring.rating(F.col("score")).alias("status"),
        )
    )
    parts.append(
        summary.dimension_scores(result).select(
            F.lit("scores").alias("section"),
            "table",
            F.col("dimension").alias("item"),
            F.format_string("%.1f/100", "score").alias("value"),
            scoring.rating(F.col("score")).alias("status"),
        )
    )
    has = set(columns.columns)
    if "completeness_percentage" in has:
        lacking = F.format_string("%.2f%% missing", 100 - F.col("completeness_percentage"))
        parts.append(_rows("completeness", columns.where("completeness_percentage < 100"), F.col("column"), lacking))
    if "mixed_types" in has:
        kinds = F.array_join("types_found", ", ")
        parts.append(_rows("consistency_types", columns.where("mixed_types"), F.col("column"), kinds))
    if "iqr_outlier_percentage" in has:
        outside = F.format_string("%d outliers (%.2f%%)", "iqr_outlier_count", "iqr_outlier_percentage")
        parts.append(_rows("consistency_values", columns.where("iqr_outlier_percentage > 1"), F.col("column"), outside))
    if "key_candidate" in has:
        parts.append(_rows("keys", columns.where("key_candidate"), F.col("column"), F.lit("100%")))
        almost = F.format_string("%.2f%% unique (%d values)", F.col("uniqueness_ratio") * 100, F.col("unique_values"))
        parts.append(_rows("high_cardinality", columns.where("high_cardinality"), F.col("column"), almost))
    if "min_date" in has:
        span = F.concat_ws(" to ", "min_date", "max_date")
        dated = columns.where("min_date IS NOT NULL")
        parts.append(_rows("timeliness", dated, F.col("column"), span, F.col("timeliness_category")))
    if "validity_score" in has:
        checked = columns.where("validity_score IS NOT NULL")
        share = F.format_string("%s: %.2f%% valid", "check_type", "validity_percentage")
        parts.append(
            _rows("validity", checked, F.col("column"), share, scoring.validity_status(F.col("validity_percentage")))
        )
    return reduce(DataFrame.unionByName, parts)


def _rows(section: str, source: DataFrame, item: Column, value: Column, status: Column | None = None):
    return source.select(
        F.lit(section).alias("section"),
        "table",
        item.alias("item"),
        value.cast("string").alias("value"),
        (F.lit(None) if status is None else status).cast("string").alias("status"),
    )


def narrative(result: Assessment) -> DataFrame:
    """Sentences that state the overall score, its rating and the extremes."""
    scores = summary.overall_scores(result)
    overall = scores.where("dimension = 'overall'").select(
        F.lit(1).alias("line"),
        F.format_string(
            "Overall quality is %.1f of 100: %s.", F.col("score"), scoring.rating(F.col("score"))
        ).alias("text"),
    )
    ends = summary.strongest_and_weakest(scores).select(
        F.lit(2),
        F.format_string(
            "The strongest dimension is %s (%.1f), the weakest %s (%.1f).",
            "strongest", "strongest_score", "weakest", "weakest_score",
        ),
    )
    issues = summary.issues(result).agg(F.count_distinct("table", "column").alias("n")).select(
        F.lit(3), F.format_string("%d columns need attention.", "n")
    )
    return overall.union(ends).union(issues)
