"""The whole assessment of a set of tables.

Per table the operators' measures are fused: one pass for everything that needs
no other result, one for quartiles, one for the counts that depend on both, one
grouped pass for distinct values, one for duplicate rows and one for histogram
bins. What a pass leaves behind is one row per column; those rows are bounded by
the schema and become the two result tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions import fixed, scoring
from tabgauge.functions.columns import in_batches, pick_columns
from tabgauge.functions.together import together
from tabgauge.operators import accuracy, completeness, consistency, distribution
from tabgauge.operators import relations, timeliness, uniqueness, validity
from tabgauge.operators.measures import SIZE, combined, measure, settled
from tabgauge.operators.schema import DATE_LIKE, Dataset


@dataclass(frozen=True)
class Options:
    """What to assess and how."""

    dimensions: tuple[str, ...] = fixed.DIMENSIONS
    columns: list[str] | None = None
    combinations: list[list[str]] = field(default_factory=list)
    rules: dict[str, dict[str, str]] = field(default_factory=dict)
    checks: validity.Checks = validity.Checks()
    as_of: str | None = None
    z_limit: float = fixed.Z_LIMIT
    distributions: bool = True


@dataclass(frozen=True)
class Assessment:
    """Results: one row per column, one row per table, and the user's rules."""

    columns: DataFrame
    tables: DataFrame
    rules: DataFrame
    combinations: DataFrame


def assess(dataset: Dataset, options: Options = Options(), parallel: int = 4) -> Assessment:
    """Assess every table of a dataset, several at a time."""
    spark = next(iter(dataset.values())).sparkSession
    numbered = list(enumerate(dataset.items()))
    done = []
    for batch in in_batches(numbered, parallel):
        done += together(spark, *[partial(_one_table, p, n, df, options) for p, (n, df) in batch])
    columns = settled(reduce(DataFrame.unionByName, [c for c, _ in done]))
    sizes = reduce(DataFrame.unionByName, [t for _, t in done])
    return Assessment(
        columns=columns,
        tables=settled(_with_overall(sizes, columns, options)),
        rules=settled(_rule_rows(spark, dataset, options)),
        combinations=settled(_combination_rows(spark, dataset, options)),
    )


def _one_table(position: int, name: str, df: DataFrame, options: Options):
    picked = pick_columns(df, options.columns)
    place = (F.lit(position).alias("table_position"), F.lit(name).alias("table"))
    return together(
        df.sparkSession,
        lambda: _column_rows(picked, options).select(*place, "*"),
        lambda: settled(_table_row(picked, len(df.columns), options).select(*place, "*")),
    )


def _column_rows(df: DataFrame, options: Options) -> DataFrame:
    wanted = set(options.dimensions)
    parts = [SIZE, DATE_LIKE, consistency.SPREAD]
    if "consistency" in wanted:
        parts.append(consistency.TYPES)
    if "accuracy" in wanted:
        parts += [accuracy.STYLES, distribution.SKEW, distribution.FINITE]
    if "timeliness" in wanted:
        parts.append(timeliness.dates(options.as_of))
    numeric = consistency.numeric_fields(df)
    outliers = bool(numeric and wanted & {"consistency", "accuracy"})

    # What needs the data only.
    found, quarters, distinct = together(
        df.sparkSession,
        lambda: settled(measure(df, combined(*parts))),
        lambda: consistency.quartiles(df) if outliers else {},
        lambda: settled(uniqueness.distinct_counts(df).drop("column"))
        if "uniqueness" in wanted
        else None,
    )

    # What needs the results of the first passes.
    conditions: dict[str, dict[str, Column]] = {"iqr_outlier_count": {}, "z_outlier_count": {}}
    bins = {}
    if outliers:
        sizes = found.where("kind = 'Numeric'").collect()
        moments = {r["column"]: (r["mean"], r["std"]) for r in sizes}
        conditions["iqr_outlier_count"] = consistency.outside_fences(df, quarters)
        conditions["z_outlier_count"] = accuracy.far_from_mean(df, moments, options.z_limit)
        if "accuracy" in wanted and options.distributions:
            bins = distribution.bins_from(df, sizes, quarters)
    if "validity" in wanted:
        conditions["valid_count"] = validity.valid_values(df, options.checks)
    if outliers:
        found = consistency.with_quartiles(found, quarters)
    else:
        found = _with_nulls(found, {"q1": "double", "median": "double", "q3": "double"})
    counted, modes = together(
        df.sparkSession,
        lambda: settled(consistency.with_counts(found, df, conditions)),
        lambda: settled(distribution.peaks_in(df, bins)) if bins else None,
    )
    if modes is not None:
        counted = counted.join(F.broadcast(modes), "column", "left")
    else:
        counted = _with_nulls(counted, {"potential_modes": "bigint"})
    if distinct is not None:
        counted = counted.join(F.broadcast(distinct), "ordinal", "left")
    return settled(_scored(counted, df, wanted, options))


def _scored(found: DataFrame, df: DataFrame, wanted: set[str], options: Options) -> DataFrame:
    if "completeness" in wanted:
        found = completeness.with_completeness(found)
    if "consistency" in wanted:
        found = consistency.with_value_consistency(consistency.with_type_consistency(found))
    if "accuracy" in wanted:
        found = accuracy.with_text_accuracy(accuracy.with_numeric_accuracy(found))
        skew, modes = F.col("skewness"), F.col("potential_modes")
        quality = F.when(
            skew.isNotNull() & modes.isNotNull(), scoring.distribution_quality(skew, modes)
        )
        found = found.withColumn("distribution_quality", quality)
    if "uniqueness" in wanted:
        found = uniqueness.with_ratio(found).withColumns(
            {
                "key_candidate": F.coalesce(
                    uniqueness.is_key_candidate(F.col("row_count")), F.lit(False)
                ),
                "high_cardinality": F.coalesce(uniqueness.is_high_cardinality(), F.lit(False)),
            }
        )
    if "timeliness" in wanted:
        found = timeliness.with_timeliness(found, options.as_of)
    if "validity" in wanted:
        found = validity.with_validity(found, df, options.checks)
    return found


def _with_nulls(found: DataFrame, types: dict[str, str]) -> DataFrame:
    return found.withColumns({n: F.lit(None).cast(t) for n, t in types.items()})


def _table_row(picked: DataFrame, column_count: int, options: Options) -> DataFrame:
    if "uniqueness" in options.dimensions:
        row = uniqueness.duplicate_rows(picked)
    else:
        row = picked.agg(F.count(F.lit(1)).alias("total_rows"))
    return row.withColumns(
        {
            "column_count": F.lit(column_count).cast("bigint"),
            "assessed_columns": F.lit(len(picked.columns)).cast("bigint"),
        }
    )


def _with_overall(sizes: DataFrame, columns: DataFrame, options: Options) -> DataFrame:
    overall = {
        "completeness": completeness.overall_from_columns,
        "consistency": consistency.overall_from_columns,
        "accuracy": accuracy.overall_from_columns,
        "timeliness": timeliness.overall_from_columns,
        "validity": validity.overall_from_columns,
    }
    for dimension, derive in overall.items():
        if dimension in options.dimensions:
            sizes = sizes.join(derive(columns, "table"), "table")
    return sizes


def _rule_rows(spark: SparkSession, dataset: Dataset, options: Options) -> DataFrame:
    parts = [
        validity.business_rules(dataset[table], rules).select(F.lit(table).alias("table"), "*")
        for table, rules in options.rules.items()
        if table in dataset
    ]
    schema = (
        "table string, position int, rule string, checked_rows bigint, violations bigint,"
        " violation_percentage double"
    )
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _combination_rows(spark: SparkSession, dataset: Dataset, options: Options) -> DataFrame:
    """Quality of each combination in every table that has two of its columns."""
    parts = []
    for name, df in dataset.items():
        for combo in options.combinations:
            members = [c for c in combo if c in df.columns]
            if len(members) >= 2:
                quality = relations.combination_quality(df, members)
                parts.append(
                    quality.select(
                        F.lit(name).alias("table"),
                        F.array(*[F.lit(c) for c in members]).alias("columns"),
                        "*",
                    )
                )
    schema = (
        "table string, columns array<string>, completeness double,"
        " dependency_strength double, overall double"
    )
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


_METRICS = {
    "completeness": ("missing_count", "completeness_percentage", "completeness_score"),
    "consistency": (
        "type_score", "consistency_percentage", "min", "max", "mean", "median", "std",
        "iqr_outlier_count", "iqr_outlier_percentage", "value_score",
    ),
    "accuracy": (
        "z_outlier_count", "z_outlier_percentage", "numeric_accuracy_score",
        "style_percentage", "text_accuracy_score", "skewness", "potential_modes",
    ),
    "uniqueness": ("unique_values", "total_values", "uniqueness_ratio"),
    "timeliness": ("time_span_days", "recency_days", "timeliness_score"),
    "validity": ("valid_count", "validity_percentage", "validity_score"),
}

_TABLE_METRICS = {
    "completeness": (
        "total_cells", "missing_cells", "completeness_percentage", "completeness_score",
    ),
    "consistency": ("type_consistency_score", "value_consistency_score", "consistency_score"),
    "accuracy": ("numeric_accuracy_score", "text_accuracy_score", "accuracy_score"),
    "uniqueness": (
        "total_rows", "duplicate_rows", "uniqueness_percentage", "uniqueness_score",
    ),
    "timeliness": ("date_columns_found", "timeliness_score"),
    "validity": ("checks_performed", "validity_score"),
}


_RULE_METRICS = {"rules": ("checked_rows", "violations", "violation_percentage")}
_COMBINATION_METRICS = {"combinations": ("completeness", "dependency_strength", "overall")}


def metrics(result: Assessment) -> DataFrame:
    """All results as one long table: table, column, dimension, metric, value.

    Table-wide metrics have no column; those of rules and combinations have the rule's
    name and the columns' names there. Metrics that do not apply are left out.
    """
    per_column = _melted(result.columns, _METRICS, F.col("column"))
    per_table = _melted(result.tables, _TABLE_METRICS, F.lit(None).cast("string"))
    per_rule = _melted(result.rules, _RULE_METRICS, F.col("rule"))
    members = F.array_join("columns", " + ")
    per_combination = _melted(result.combinations, _COMBINATION_METRICS, members)
    parts = (per_column, per_table, per_rule, per_combination)
    return reduce(DataFrame.unionByName, parts)


def _melted(wide: DataFrame, layout: dict[str, tuple[str, ...]], column: Column) -> DataFrame:
    cells = [
        F.struct(
            F.lit(dimension).alias("dimension"),
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("value"),
        )
        for dimension, names in layout.items()
        for name in names
        if name in wide.columns
    ]
    return wide.select(
        "table", column.alias("column"), F.explode(F.array(*cells)).alias("cell")
    ).select("table", "column", "cell.*").where("value IS NOT NULL")
