"""Uniqueness: duplicate rows and distinct values per column.

Both group before they shuffle, so copies of one row or value collapse within
each task and a value that fills a third of the table does not make one task
slow. Long text is grouped by digest (see ``grouping_key``), rows by the hashes of
``row_digest``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.columns import field_of, grouping_key, percent, row_digest
from tabgauge.functions.scoring import step_score


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows; NULLs are equal."""
    names = columns or df.columns
    digest = row_digest([field_of(df, n) for n in names])
    grouped = df.select(*digest).groupBy("digest_1", "digest_2").count()
    return with_uniqueness(
        grouped.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def with_uniqueness(counted: DataFrame) -> DataFrame:
    share = 100.0 * (1.0 - F.col("duplicate_rows") / F.nullif(F.col("total_rows"), F.lit(0)))
    return counted.withColumn(
        "uniqueness_percentage", F.coalesce(share, F.lit(100.0))
    ).withColumn("uniqueness_score", step_score(F.col("uniqueness_percentage"), "uniqueness"))


def _family(data_type: T.DataType) -> str:
    """Type in which columns can be stacked without changing which are equal."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return "string"
    return data_type.simpleString()


def value_groups(df: DataFrame, fields: list[T.StructField] | None = None) -> list[DataFrame]:
    """(position, value, rows) per distinct value, one table per type family.

    Columns of one type are stacked and grouped together: each is read once and
    nothing is turned into text for the sake of a common type.
    """
    families: dict[str, list[tuple[int, T.StructField]]] = {}
    wanted = None if fields is None else {f.name for f in fields}
    for i, field in enumerate(df.schema.fields):
        if wanted is None or field.name in wanted:
            families.setdefault(_family(field.dataType), []).append((i, field))
    tables = []
    for family, members in families.items():
        names = [f"p{i}" for i, _ in members]
        simple = family in ("bigint", "double", "string")
        keys = [
            (grouping_key(f).cast(family) if simple else grouping_key(f)).alias(n)
            for n, (_, f) in zip(names, members)
        ]
        tables.append(
            df.select(*keys)
            .unpivot([], names, "position", "value")
            .where("value IS NOT NULL")
            .groupBy("position", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
    return tables


def distinct_counts(df: DataFrame, fields: list[T.StructField] | None = None) -> DataFrame:
    """Distinct and present values per column; columns without values are left out."""
    names = F.create_map(
        *[x for i, f in enumerate(df.schema.fields) for x in (F.lit(f"p{i}"), F.lit(f.name))]
    )
    ordinals = F.create_map(
        *[x for i, _ in enumerate(df.schema.fields) for x in (F.lit(f"p{i}"), F.lit(i))]
    )
    counted = [
        t.groupBy("position").agg(
            F.count(F.lit(1)).alias("unique_values"), F.sum("rows").alias("total_values")
        )
        for t in value_groups(df, fields)
    ]
    return reduce(DataFrame.unionByName, counted).select(
        ordinals[F.col("position")].alias("ordinal"),
        names[F.col("position")].alias("column"),
        "unique_values",
        "total_values",
    )


def approximate_distinct_counts(df: DataFrame) -> DataFrame:
    """The same from a bounded sketch: one pass, no shuffle of values, a few
    percent off. For a first look; keys are only decided on exact counts."""
    names = df.columns
    row = df.agg(
        *[F.approx_count_distinct(grouping_key(f)).alias(f"u{i}") for i, f in enumerate(df.schema.fields)],
        *[F.count(grouping_key(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(n).alias("column"),
            F.col(f"u{i}").alias("unique_values"),
            F.col(f"n{i}").alias("total_values"),
        )
        for i, n in enumerate(names)
    ]
    return row.select(F.inline(F.array(*rows))).where("total_values > 0")


def with_ratio(counted: DataFrame) -> DataFrame:
    return counted.withColumn(
        "uniqueness_ratio", F.col("unique_values") / F.nullif(F.col("total_values"), F.lit(0))
    ).withColumn("is_unique", F.col("unique_values") == F.col("total_values"))


def column_uniqueness(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values, present values, their ratio and whether all differ."""
    counted = approximate_distinct_counts(df) if approximate else distinct_counts(df)
    return with_ratio(counted)


def is_key_candidate(total_rows: Column) -> Column:
    return F.col("is_unique") & (F.col("total_values") == total_rows)


def is_high_cardinality() -> Column:
    """Almost unique: often a key that went wrong."""
    return (
        (F.col("uniqueness_ratio") > 0.9)
        & (F.col("uniqueness_ratio") < 1)
        & (F.col("total_values") > 100)
    )


def key_candidates(df: DataFrame) -> DataFrame:
    """Columns with a different value in every row."""
    rows = df.count()
    found = column_uniqueness(df).where(is_key_candidate(F.lit(rows)))
    return found.orderBy("ordinal").select("column", "unique_values")


def high_cardinality(df: DataFrame) -> DataFrame:
    """Columns that are almost, but not quite, unique."""
    found = column_uniqueness(df).where(is_high_cardinality())
    return found.orderBy("ordinal").select(
        "column",
        "unique_values",
        "uniqueness_ratio",
        percent(F.col("unique_values"), F.col("total_values")).alias("unique_percentage"),
    )
