"""Scores, ratings and labels as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabgauge.functions import fixed


def step_score(value: Column, measure: str) -> Column:
    """Score of a percentage: 100, 90, 75, 60, 40 or 20; NULL stays NULL."""
    good, great, excellent = fixed.STEPS[measure]
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(value >= excellent, 100.0)
        .when(value >= great, 90.0)
        .when(value >= good, 75.0)
        .when(value >= good * 0.8, 60.0)
        .when(value >= good * 0.6, 40.0)
        .otherwise(20.0)
    )


def _banded(value: Column, bands, lowest: str) -> Column:
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in bands:
        label = label.when(value >= limit, name)
    return label.otherwise(lowest)


def rating(score: Column, bands: str = "three") -> Column:
    """Display rating of a score, in three or in five bands."""
    if bands == "five":
        return _banded(
            score,
            ((90, "Excellent"), (80, "Good"), (70, "Fair"), (50, "Poor")),
            "Critical",
        )
    return _banded(score, ((90, "Excellent"), (75, "Good")), "Needs Improvement")


def quality_level(score: Column) -> Column:
    return _banded(
        score, ((90, "excellent"), (75, "good"), (60, "moderate")), "poor"
    )


def validity_status(share: Column) -> Column:
    return _banded(share, ((95, "Valid"), (80, "Mostly Valid")), "Invalid")


def dependency_strength(share: Column) -> Column:
    return _banded(share, ((95, "Strong"), (70, "Moderate")), "Weak")


def correlation_strength(r: Column) -> Column:
    return _banded(F.abs(r), ((0.7, "Strong"), (0.3, "Moderate")), "Weak")


def distribution_quality(skewness: Column, modes: Column) -> Column:
    return (
        F.when((F.abs(skewness) < 1) & (modes <= 2), "Good")
        .when((F.abs(skewness) < 2) & (modes <= 3), "Fair")
        .otherwise("Poor")
    )


def age_score(days: Column) -> Column:
    """Score of the newest date's age; each band falls on its own slope."""
    return (
        F.when(days.isNull(), F.lit(0.0))
        .when(days > 365, F.greatest(F.lit(0.0), 100.0 - (days - 365) / 10.0))
        .when(days > 180, F.greatest(F.lit(70.0), 100.0 - (days - 180) / 4.0))
        .when(days > 30, F.greatest(F.lit(85.0), 100.0 - (days - 30) / 5.0))
        .otherwise(100.0)
    )


def age_category(days: Column) -> Column:
    return (
        F.when(days.isNull(), "Invalid Dates")
        .when(days <= 30, "Current")
        .when(days <= 180, "Recent")
        .when(days <= 365, "Outdated")
        .otherwise("Obsolete")
    )


def clamp_score(score: Column) -> Column:
    """Keep a score within 0..100; a missing score counts as 0."""
    value = F.coalesce(score.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def parse_score(text: Column) -> Column:
    """Number in a text such as ``85`` or ``85%``; NULL when there is none."""
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double")


def score_text(score: Column) -> Column:
    """``85/100`` for whole scores, ``85.3/100`` otherwise, ``N/A`` if missing."""
    whole = F.concat(score.cast("bigint").cast("string"), F.lit("/100"))
    return (
        F.when(score.isNull(), "N/A")
        .when(score == F.floor(score), whole)
        .otherwise(F.format_string("%.1f/100", score))
    )
