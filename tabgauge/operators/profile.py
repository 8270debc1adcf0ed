"""Profiles of single columns and of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.columns import field_of, grouping_key, kind_of, percent, present, ref
from tabgauge.functions.dates import as_timestamp, elapsed_days
from tabgauge.operators.completeness import completeness_overall
from tabgauge.operators.consistency import (
    SPREAD, numeric_fields, outside_fences, quartiles, with_counts, with_quartiles,
)
from tabgauge.operators.measures import SIZE, VALUE, Measures, combined, local_rows, measure
from tabgauge.operators.uniqueness import distinct_counts, duplicate_rows, value_groups


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows of a table."""
    cells = completeness_overall(df).select("total_cells", "missing_cells")
    copies = duplicate_rows(df).select("total_rows", "duplicate_rows")
    both = copies.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        cells.select(F.struct("*")).scalar().alias("cells"),
        "duplicate_rows",
    )
    return both.select(
        "total_rows",
        "total_columns",
        "cells.missing_cells",
        percent(F.col("cells.missing_cells"), F.col("cells.total_cells"), 0.0).alias("missing_percentage"),
        "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("total_rows"), 0.0).alias("duplicate_percentage"),
    )


def _with_distinct(measured: DataFrame, df: DataFrame, fields) -> DataFrame:
    counts = distinct_counts(df, fields).select("column", "unique_values")
    return measured.join(counts, "column", "left").withColumn(
        "unique_values", F.coalesce("unique_values", F.lit(0))
    )


def numeric_profile(df: DataFrame) -> DataFrame:
    """Count, missing, mean, median, extremes, deviation, distinct values."""
    fields = numeric_fields(df)
    measured = with_quartiles(measure(df, combined(SIZE, SPREAD), fields), quartiles(df))
    return _with_distinct(measured, df, fields).select(
        "column",
        (F.col("row_count") - F.col("missing_count")).alias("count"),
        F.col("missing_count").alias("missing"),
        percent(F.col("missing_count"), F.col("row_count")).alias("missing_percentage"),
        "mean", "median", "min", "max", "std", "unique_values",
    )


def date_profile(df: DataFrame) -> DataFrame:
    """Count, missing, earliest, latest, days between, distinct values."""
    fields = [f for f in df.schema.fields if kind_of(f.dataType) == "DateTime"]

    ends = Measures(
        {"earliest": "timestamp", "latest": "timestamp"},
        lambda kind: ({}, {"earliest": F.min(VALUE), "latest": F.max(VALUE)}),
    )
    return _with_distinct(measure(df, combined(SIZE, ends), fields), df, fields).select(
        "column",
        (F.col("row_count") - F.col("missing_count")).alias("count"),
        F.col("missing_count").alias("missing"),
        percent(F.col("missing_count"), F.col("row_count")).alias("missing_percentage"),
        "earliest",
        "latest",
        elapsed_days(F.col("latest"), F.col("earliest")).alias("range_days"),
        "unique_values",
    )


def text_profile(df: DataFrame) -> DataFrame:
    """Count, missing, distinct values and the most common value per text column.

    Values are counted by grouping key, so long text is shuffled as a digest; the
    most common value is the best of an aggregate, one row per column, and its
    text is then looked up in a second pass without a shuffle. Of equally common
    values the one with the smallest key wins.
    """
    texts = df.select(
        *[
            ref(f.name).cast("string").alias(f.name)
            for f in df.schema.fields
            if kind_of(f.dataType) in ("Text", "Boolean")
        ]
    )
    ranked = [
        groups.groupBy("position").agg(
            F.count(F.lit(1)).alias("unique_values"),
            F.min(F.struct((-F.col("rows")).alias("rank"), "value")).alias("best"),
        )
        for groups in value_groups(texts)
    ]
    leaders = reduce(DataFrame.unionByName, ranked).collect()
    by_column = {texts.columns[int(r["position"][1:])]: r for r in leaders}
    wanted = [
        F.min(F.when(grouping_key(f) == F.lit(by_column[f.name]["best"]["value"]), ref(f.name))).alias(f.name)
        for f in texts.schema.fields
        if f.name in by_column
    ]
    looked_up = texts.agg(*wanted).first().asDict() if wanted else {}
    common = local_rows(
        df.sparkSession,
        [
            {
                "column": name,
                "unique_values": r["unique_values"],
                "most_common": looked_up[name],
                "most_common_count": -r["best"]["rank"],
            }
            for name, r in by_column.items()
        ],
        "column string, unique_values bigint, most_common string, most_common_count bigint",
    )
    count = F.col("row_count") - F.col("missing_count")
    return (
        measure(texts, SIZE)
        .join(F.broadcast(common), "column", "left")
        .na.fill(0, ["unique_values", "most_common_count"])
        .select(
            "column",
            count.alias("count"),
            F.col("missing_count").alias("missing"),
            percent(F.col("missing_count"), F.col("row_count")).alias("missing_percentage"),
            "unique_values", "most_common", "most_common_count",
            percent(F.col("most_common_count"), count, 0.0).alias("most_common_percentage"),
        )
    )


def top_values(df: DataFrame, column: str, rows: int = 20) -> DataFrame:
    """The most common values with their share of the values shown."""
    shown = (
        df.select(present(field_of(df, column)).cast("string").alias("value"))
        .where("value IS NOT NULL")
        .groupBy("value")
        .count()
        .orderBy(F.desc("count"), "value")
        .limit(rows)
    )
    total = shown.agg(F.sum("count")).scalar()
    return shown.withColumn("percentage", percent(F.col("count"), total))


def records_per_month(df: DataFrame, column: str) -> DataFrame:
    """Rows per calendar month that has any."""
    field = field_of(df, column)
    when = as_timestamp(present(field), field.dataType)
    return (
        df.select(F.date_format(when, "yyyy-MM").alias("month"))
        .where("month IS NOT NULL")
        .groupBy("month")
        .count()
    )


def box_stats(df: DataFrame) -> DataFrame:
    """Chart data: quartiles, and the furthest values within the fences."""
    fields = numeric_fields(df)
    found = quartiles(df)

    measured = with_quartiles(measure(df, combined(SIZE, SPREAD), fields), found)
    outside = outside_fences(df, found)
    if not outside:
        raise ValueError("the table has no numeric values")
    counted = with_counts(measured, df, {"outliers": outside})
    within = {f.name: F.when(~outside[f.name], present(f).cast("double")) for f in fields if f.name in outside}
    names = list(within)
    ends = df.agg(
        *[F.min(c).alias(f"low{i}") for i, c in enumerate(within.values())],
        *[F.max(c).alias(f"high{i}") for i, c in enumerate(within.values())],
    )
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            F.col(f"low{i}").alias("whisker_low"),
            F.col(f"high{i}").alias("whisker_high"),
        )
        for i, n in enumerate(names)
    ]
    whiskers = ends.select(F.inline(F.array(*rows)))
    return counted.join(F.broadcast(whiskers), "column").select(
        "column", "min", "whisker_low", "q1", "median", "q3", "whisker_high", "max", "outliers"
    )


def scatter(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """Chart data: the points of two columns, with an optional group."""
    columns = [ref(x).alias("x"), ref(y).alias("y")]
    if colour:
        columns.append(ref(colour).cast("string").alias("colour"))
    return df.select(*columns).where("x IS NOT NULL AND y IS NOT NULL")
