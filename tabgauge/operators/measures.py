"""Measures of every column of a table, one row per column.

``measure`` computes the same measures for all columns of a kind: the columns are
stacked and aggregated by position, so the plan stays small however wide the
table is. Every task reduces its rows to one row per column before anything is
shuffled. Each column is read once.

``count_where`` counts conditions that differ from column to column, such as
fences with the column's own bounds, in one aggregate without keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.columns import in_batches, kind_of, present

# More conditions in one aggregate make its generated code too long for the JIT
# compiler. Passes read different columns, so splitting costs no extra reading.
CONDITIONS_PER_PASS = 24
VALUE = "value"

# For a kind: expressions on ``value`` evaluated once per row, and aggregates
# over them; both empty for kinds the measures do not apply to.
OfKind = Callable[[str], tuple[dict[str, Column], dict[str, Column]]]


@dataclass(frozen=True)
class Measures:
    """Aggregates by kind of column; ``types`` names every result column."""

    types: dict[str, str]
    of_kind: OfKind
    #: Only asks whether values are missing, so that the values need not be moved.
    presence_only: bool = False


def combined(*parts: Measures) -> Measures:
    """Several sets of measures in one pass."""

    def both(kind: str):
        prepared: dict[str, Column] = {}
        aggregates: dict[str, Column] = {}
        for part in parts:
            more_prepared, more_aggregates = part.of_kind(kind)
            prepared.update(more_prepared)
            aggregates.update(more_aggregates)
        return prepared, aggregates

    types: dict[str, str] = {}
    for part in parts:
        types.update(part.types)
    return Measures(types, both, all(part.presence_only for part in parts))


def _size(kind: str):
    return {}, {
        "row_count": F.count(F.lit(1)),
        "missing_count": F.count_if(F.col(VALUE).isNull()),
    }


SIZE = Measures({"row_count": "bigint", "missing_count": "bigint"}, _size, presence_only=True)


def _stackable(field: T.StructField) -> Column:
    """The column in the common type of its kind."""
    kind, value = kind_of(field.dataType), present(field)
    if kind == "Numeric":
        return value.cast("double")
    if kind == "DateTime":
        return value.cast("timestamp")
    return value if kind == "Text" else F.when(value.isNotNull(), F.lit(True))


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from values known to the driver."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(r[f.name] for f in struct) for r in rows], struct)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, computed once: a table without lineage.

    For results with one row per column or table; the schema bounds their size,
    so they may pass through the driver.
    """
    return rows.sparkSession.createDataFrame(rows.toArrow())


def layout(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Ordinal, name, type and kind of the given columns."""
    chosen = {f.name for f in fields}
    rows = [(i, f) for i, f in enumerate(df.schema.fields) if f.name in chosen]
    table = pa.table(
        {
            "ordinal": pa.array([i for i, _ in rows], pa.int32()),
            "column": pa.array([f.name for _, f in rows], pa.string()),
            "dtype": pa.array([f.dataType.simpleString() for _, f in rows], pa.string()),
            "kind": pa.array([kind_of(f.dataType) for _, f in rows], pa.string()),
        }
    )
    return df.sparkSession.createDataFrame(table)


def measure(
    df: DataFrame, measures: Measures, fields: list[T.StructField] | None = None
) -> DataFrame:
    """One row per column: ordinal, column, dtype, kind and the measures.

    Measures that do not apply to a column's kind are NULL.
    """
    fields = df.schema.fields if fields is None else fields
    if not fields:
        raise ValueError("the table has no such columns")
    chosen = {f.name for f in fields}
    by_kind: dict[str, list[tuple[int, T.StructField]]] = {}
    for i, field in enumerate(df.schema.fields):
        if field.name in chosen:
            by_kind.setdefault(kind_of(field.dataType), []).append((i, field))
    parts = [_measured_kind(df, measures, kind, members) for kind, members in by_kind.items()]
    found = reduce(DataFrame.unionByName, parts)
    # An empty table has no groups, but still has columns.
    rows = layout(df, fields).join(F.broadcast(found), "ordinal", "left")
    counts = [c for c in ("row_count", "missing_count") if c in measures.types]
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}) if counts else rows


def _measured_kind(df: DataFrame, measures: Measures, kind: str, members: list) -> DataFrame:
    prepared, aggregates = measures.of_kind(kind)

    def value(field: T.StructField) -> Column:
        if measures.presence_only:
            return F.when(present(field).isNotNull(), F.lit(True))
        return _stackable(field)

    cells = [F.struct(F.lit(i).alias("ordinal"), value(f).alias(VALUE)) for i, f in members]
    stacked = df.select(F.inline(F.array(*cells)))
    if prepared:
        stacked = stacked.select("ordinal", VALUE, *[c.alias(n) for n, c in prepared.items()])
    grouped = stacked.groupBy("ordinal").agg(
        *[c.alias(n) for n, c in (aggregates or _size(kind)[1]).items()]
    )
    return grouped.select(
        "ordinal",
        *[
            (F.col(n) if n in aggregates else F.lit(None)).cast(t).alias(n)
            for n, t in measures.types.items()
        ],
    )


def count_where(df: DataFrame, conditions: dict[str, dict[str, Column]]) -> DataFrame:
    """Rows per condition: measure name to column name to condition.

    One row per column that has any condition; NULL where it has not that one.
    """
    order = {name: i for i, name in enumerate(df.columns)}
    columns = sorted({c for by_column in conditions.values() for c in by_column}, key=order.get)
    if not columns:
        raise ValueError("no conditions to count")
    per_pass = max(1, CONDITIONS_PER_PASS // len(conditions))
    parts = []
    for batch in in_batches(columns, per_pass):
        aggregates, rows = [], []
        for name in batch:
            cells = []
            for j, (measure_name, by_column) in enumerate(conditions.items()):
                alias = f"n{order[name]}_{j}"
                if name in by_column:
                    aggregates.append(F.count_if(by_column[name]).alias(alias))
                    cells.append(F.col(alias).alias(measure_name))
                else:
                    cells.append(F.lit(None).cast("bigint").alias(measure_name))
            rows.append(
                F.struct(F.lit(order[name]).alias("ordinal"), F.lit(name).alias("column"), *cells)
            )
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)
