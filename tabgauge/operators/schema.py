"""Schema and size of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import fixed
from tabgauge.functions.columns import kind_of, names_of_kind, pick_columns, ref
from tabgauge.functions.dates import parse_date
from tabgauge.functions.text import looks_like_date
from tabgauge.operators.measures import VALUE, Measures, measure

Dataset = dict[str, DataFrame]

_DISPLAY_KINDS = {
    "Numeric": "Numeric (Integer)",
    "DateTime": "Date/Time",
    "Boolean": "Boolean",
    "Text": "Text",
}


def _date_like(kind: str):
    if kind != "Text":
        return {}, {}
    return (
        {"date_like": looks_like_date(F.col(VALUE)).cast("int")},
        {"date_like_share": F.avg("date_like")},
    )


# Share of a text column's values that look like dates.
DATE_LIKE = Measures({"date_like_share": "double"}, _date_like)


def likely_dates(df: DataFrame) -> DataFrame:
    """Text columns with the share of date-like values over all rows."""
    fields = [f for f in df.schema.fields if kind_of(f.dataType) == "Text"]
    measured = measure(df, DATE_LIKE, fields)
    return measured.select(
        "column",
        F.coalesce("date_like_share", F.lit(0.0)).alias("date_like_share"),
        is_likely_date().alias("likely_date"),
    )


def is_likely_date() -> Column:
    return F.coalesce(F.col("date_like_share") > fixed.LIKELY_DATE_SHARE, F.lit(False))


def _schema_rows(df: DataFrame, selected: list[str] | None = None) -> list[tuple]:
    return [
        (i, f.name, f.dataType.simpleString(), kind_of(f.dataType), not selected or f.name in selected)
        for i, f in enumerate(df.schema.fields)
    ]


def column_meta(df: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Type, kind and role of each column; only ``likely_date`` reads data."""
    rows = df.sparkSession.createDataFrame(
        _schema_rows(df, selected),
        "ordinal int, column string, dtype string, kind string, is_selected boolean",
    )
    meta = rows.select(
        "*",
        (F.col("kind") == "Numeric").alias("is_numeric"),
        (F.col("kind") == "DateTime").alias("is_datetime"),
        F.lit(False).alias("is_categorical"),
    )
    if not names_of_kind(df, "Text"):
        return meta.withColumn("likely_date", F.lit(False))
    likely = likely_dates(df).select("column", "likely_date")
    return meta.join(likely, "column", "left").withColumn(
        "likely_date", F.coalesce("likely_date", F.lit(False))
    )


def type_distribution(df: DataFrame) -> DataFrame:
    """Number of columns per kind, also for kinds without columns."""
    kinds = [kind_of(f.dataType) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        [(k, kinds.count(k)) for k in fixed.KINDS], "kind string, columns bigint"
    )


def display_types(df: DataFrame) -> DataFrame:
    """Number of columns per display name of their type, most frequent first."""
    names = []
    for f in df.schema.fields:
        label = _DISPLAY_KINDS.get(kind_of(f.dataType), f.dataType.simpleString())
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            label = "Numeric (Float)"
        names.append(label)
    counts = df.sparkSession.createDataFrame([(n,) for n in names], "data_type string")
    return counts.groupBy("data_type").count().orderBy(F.desc("count"), "data_type")


def table_stats(df: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Rows, columns, assessed columns and bytes of text of a table."""
    texts = [F.sum(F.octet_length(ref(n))) for n in names_of_kind(df, "Text")]
    total_text = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in texts], F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(len(pick_columns(df, selected).columns)).cast("bigint").alias("assessed_columns"),
        total_text.cast("bigint").alias("text_bytes"),
    )


def dataset_info(dataset: Dataset) -> DataFrame:
    """Rows, columns and column types per table."""
    parts = []
    for name, df in dataset.items():
        dtypes = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"),
                "rows",
                F.lit(len(df.columns)).cast("bigint").alias("columns"),
                dtypes.alias("column_types"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dataset_totals(info: DataFrame) -> DataFrame:
    """Totals over all tables of ``dataset_info``."""
    return info.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("rows").alias("total_rows"),
        F.sum("columns").alias("total_columns"),
    )


def trend_date_columns(df: DataFrame) -> DataFrame:
    """Columns usable as a time axis: dates, and text that always parses as one."""

    def parsed(kind: str):
        value = F.col(VALUE)
        when = parse_date(value) if kind == "Text" else value
        return (
            {"when": when},
            {"filled": F.count(value), "unparsed": F.count(value) - F.count("when")},
        )

    fields = [f for f in df.schema.fields if kind_of(f.dataType) in ("Text", "DateTime")]
    return (
        measure(df, Measures({"filled": "bigint", "unparsed": "bigint"}, parsed), fields)
        .where("unparsed = 0 AND filled > 0")
        .select("ordinal", "column")
    )


def preview(df: DataFrame, order_by: list[str], rows: int = 10) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*[ref(c) for c in order_by]).limit(rows)
