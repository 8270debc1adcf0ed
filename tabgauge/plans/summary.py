"""From an assessment to scores, issues and advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions import fixed, scoring
from tabgauge.plans.assess import Assessment

# One short piece of advice per dimension.
_ADVICE = {
    "completeness": "Find where values get lost and make the fields mandatory there.",
    "consistency": "Agree on one format per column and enforce it on entry.",
    "accuracy": "Check extreme values against their source and add plausibility rules.",
    "uniqueness": "Declare keys, and remove the duplicates that violate them.",
    "timeliness": "Refresh the data more often and watch the age of its newest record.",
    "validity": "Check formats and ranges when the data comes in.",
}


def score_column(dimension: str) -> str:
    return f"{dimension}_score"


def _order() -> Column:
    return F.create_map(
        *[x for i, d in enumerate(fixed.DIMENSIONS) for x in (F.lit(d), F.lit(i))]
    )


def dimension_scores(result: Assessment) -> DataFrame:
    """Score per table and dimension (radar chart data); missing ones left out."""
    cells = [
        F.struct(F.lit(d).alias("dimension"), F.col(score_column(d)).cast("double").alias("score"))
        for d in fixed.DIMENSIONS
        if score_column(d) in result.tables.columns
    ]
    return (
        result.tables.select("table", F.explode(F.array(*cells)).alias("cell"))
        .select("table", "cell.*")
        .where("score IS NOT NULL")
    )


def overall_scores(result: Assessment) -> DataFrame:
    """Mean per dimension, and ``overall``: the mean of all scores of all tables."""
    return (
        dimension_scores(result)
        .rollup("dimension")
        .agg(F.avg("score").alias("score"))
        .select(F.coalesce("dimension", F.lit("overall")).alias("dimension"), "score")
    )


def issues(result: Assessment) -> DataFrame:
    """Every issue of every column, with both ways of ranking."""
    columns = result.columns
    parts = []

    def found(condition, position, dimension, table_label, label, score, severity):
        parts.append(
            columns.where(condition).select(
                "table_position",
                "table",
                F.lit(position).alias("rule_position"),
                "ordinal",
                "column",
                label.alias("issue"),
                F.lit(table_label).alias("table_issue"),
                F.lit(dimension).alias("dimension"),
                severity.alias("severity"),
                score.alias("score"),
            )
        )

    share, outliers = F.col("completeness_percentage"), F.col("z_outlier_percentage")
    if "completeness_percentage" in columns.columns:
        found(
            share < 95, 0, "Completeness", "Incomplete Data",
            F.format_string("Missing data (%.1f%%)", 100 - share), share, (100 - share) / 10,
        )
    if "mixed_types" in columns.columns:
        found(
            F.col("mixed_types"), 1, "Consistency", "Mixed Data Types",
            F.lit("Mixed data types"), F.col("type_score"), (100 - F.col("type_score")) / 10,
        )
    if "z_outlier_percentage" in columns.columns:
        found(
            outliers > 5, 2, "Accuracy", "High Outlier %",
            F.format_string("High outliers (%.1f%%)", outliers),
            F.col("numeric_accuracy_score"), outliers / 10,
        )
    return reduce(DataFrame.unionByName, parts)


def top_issues(result: Assessment, rows: int = 10) -> DataFrame:
    """The most severe issues over all tables."""
    return (
        issues(result)
        .orderBy(F.desc("severity"), "table_position", "rule_position", "ordinal")
        .limit(rows)
        .select("table", "column", "issue", "dimension", "severity")
    )


def table_issues(result: Assessment, rows: int = 8) -> DataFrame:
    """The issues with the lowest scores in each table (bar chart data)."""
    rank = F.row_number().over(
        Window.partitionBy("table").orderBy("score", "rule_position", "ordinal")
    )
    return (
        issues(result)
        .withColumn("rank", rank)
        .where(F.col("rank") <= rows)
        .select("table", "rank", "column", F.col("table_issue").alias("issue"), "dimension", "score")
    )


def recommendations(scores: DataFrame) -> DataFrame:
    """Advice for each dimension whose mean score is below its limit."""
    parts = []
    for dimension, (limit, urgent, first, other) in fixed.ADVICE_LIMITS.items():
        parts.append(
            scores.where((F.col("dimension") == dimension) & (F.col("score") < limit)).select(
                F.initcap("dimension").alias("dimension"),
                F.lit(_ADVICE[dimension]).alias("recommendation"),
                F.when(F.col("score") < urgent, first).otherwise(other).alias("priority"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def strongest_and_weakest(scores: DataFrame) -> DataFrame:
    """Best and worst dimension; the earlier one wins a tie."""
    ranked = scores.where("dimension <> 'overall'").select(
        "dimension",
        scoring.clamp_score(F.col("score")).alias("score"),
        _order()[F.col("dimension")].alias("position"),
    )
    best = F.min(F.struct((-F.col("score")).alias("rank"), "position", "dimension"))
    worst = F.min(F.struct(F.col("score").alias("rank"), "position", "dimension"))
    found = ranked.agg(best.alias("best"), worst.alias("worst"))
    return found.select(
        F.col("best.dimension").alias("strongest"),
        (-F.col("best.rank")).alias("strongest_score"),
        (-F.col("best.rank") >= 75).alias("is_strength"),
        F.col("worst.dimension").alias("weakest"),
        F.col("worst.rank").alias("weakest_score"),
        (F.col("worst.rank") < 75).alias("needs_improvement"),
    )


def quality_context(result: Assessment) -> DataFrame:
    """Overall level, the critical dimension and the number of missing cells.

    A dimension is critical when it has the lowest score and that is below 100.
    """
    scores = overall_scores(result)
    ranked = scores.withColumn("position", _order()[F.col("dimension")])
    overall = F.bround(F.max(F.when(F.col("dimension") == "overall", F.col("score"))))
    lowest = F.min(
        F.when(
            (F.col("dimension") != "overall") & (F.col("score") < 100),
            F.struct("score", "position", "dimension"),
        )
    )
    missing = result.tables.agg(F.sum("missing_cells")).scalar()
    return ranked.agg(overall.alias("quality_score"), lowest.alias("lowest")).select(
        "quality_score",
        scoring.quality_level(F.col("quality_score")).alias("quality_level"),
        F.col("lowest.dimension").alias("critical_dimension"),
        missing.alias("issue_count"),
    )
