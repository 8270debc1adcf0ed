"""Column references, missing values and grouping keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Text up to this many bytes is grouped as it is; longer text is grouped by its
# SHA-256 digest in hex, which has exactly this many bytes.
DIGEST_BYTES = 64


def ref(name: str) -> Column:
    """Column of that exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    """Kind of a column: Numeric, DateTime, Boolean, Text or Other."""
    if isinstance(data_type, T.BooleanType):
        return "Boolean"
    if isinstance(data_type, T.NumericType):
        return "Numeric"
    if isinstance(data_type, _DATES):
        return "DateTime"
    if isinstance(data_type, T.StringType):
        return "Text"
    return "Other"


def names_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL, so that both count as missing."""
    column = ref(field.name)
    if isinstance(field.dataType, _FLOATS):
        return F.when(~F.isnan(column), column)
    return column


def missing(field: T.StructField) -> Column:
    return present(field).isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """The table with NaN turned into NULL in every float column."""
    if not any(isinstance(f.dataType, _FLOATS) for f in df.schema.fields):
        return df
    return df.select(*[present(f).alias(f.name) for f in df.schema.fields])


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ValueError(f"no column {name!r}")


def grouping_key(field: T.StructField) -> Column:
    """A value that is equal exactly when the column's values are equal.

    Long text is replaced by its digest so that a shuffle moves 64 bytes instead
    of whole documents; a shorter raw text can never equal a digest because the
    lengths differ. Maps cannot be grouped, so they become sorted entries.
    """
    column = present(field)
    if isinstance(field.dataType, T.StringType):
        return F.when(F.octet_length(column) < DIGEST_BYTES, column).otherwise(
            F.sha2(column.cast("binary"), 256)
        )
    if isinstance(field.dataType, T.BinaryType):
        return F.sha2(column, 256)
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column


def row_digest(fields: Iterable[T.StructField]) -> list[Column]:
    """Two 64-bit hashes, equal for equal rows; NULL is told from its neighbours.

    A shuffle then moves 16 bytes a row, however wide the table. Different rows agree in
    both hashes with a probability of 2 to the power of -128.
    """
    keys = [grouping_key(f) for f in fields]
    parts = [F.array(*[k.isNull() for k in keys]), *keys]
    return [F.xxhash64(*parts).alias("digest_1"), F.xxhash64(F.lit(1), *parts).alias("digest_2")]


def pick_columns(df: DataFrame, wanted: Iterable[str] | None) -> DataFrame:
    """Keep the wanted columns that exist; keep all when none of them does."""
    if not wanted:
        return df
    valid = [name for name in wanted if name in df.columns]
    return df.select(*[ref(name) for name in valid]) if valid else df


def percent(part: Column, whole: Column, empty: float | None = None) -> Column:
    """100 * part / whole, or ``empty`` when there is no whole."""
    share = 100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0))
    return share if empty is None else F.coalesce(share, F.lit(float(empty)))


def in_batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
