"""Repairs: filling, filtering and removing what the assessment points out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions import fixed
from tabgauge.functions.columns import field_of, kind_of, present, ref, row_digest
from tabgauge.functions.dates import as_timestamp, elapsed_days, moment
from tabgauge.functions.text import matches
from tabgauge.operators.accuracy import moments
from tabgauge.operators.quantiles import exact_quantiles

# Rows of the sample per range, and characters of a text in a bound.
SAMPLED = 32
BOUND_CHARS = 1000


def fill_with_median(df: DataFrame, column: str) -> DataFrame:
    """Missing values of a numeric column replaced by its median."""
    value = present(field_of(df, column)).cast("double")
    middle = exact_quantiles(df, {column: value}, [0.5])[column][0]
    return df.withColumn(column, F.coalesce(value, F.lit(middle).cast("double")))


def forward_fill(
    df: DataFrame, column: str, order_by: list[str], parts: int | None = None
) -> DataFrame:
    """Missing values replaced by the last value before them.

    Rows are split into ranges of the whole order key, so a first key that many rows share
    is split by the keys after it; rows equal in all of ``order_by`` share a range, and
    which of them comes first is open. The bounds are taken once, from a sample, and then
    are part of the plan: every run of a task splits rows the same way, and they decide
    only how even the ranges are, never a value. Each range is filled by itself; its last
    value is handed on to the ranges after it. Missing keys come first. Only keys of the
    order, the column and the range go through the windows' sorts beside the row itself.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [ref(c) for c in order_by]
    value = present(field_of(df, column))
    ranged = df.withColumn(column, value)
    ranged = ranged.withColumn("__range", _range_of(ranged, order_by, parts))
    last_values = (
        ranged.where(ref(column).isNotNull())
        .groupBy("__range")
        .agg(F.max_by(ref(column), F.struct(*keys)).alias("__last"))
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = (
        spark.range(parts)
        .select(F.col("id").cast("int").alias("__range"))
        .join(last_values, "__range", "left")
        .select("__range", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    )
    within = (
        Window.partitionBy("__range")
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = F.coalesce(F.last(ref(column), ignorenulls=True).over(within), F.col("__carried"))
    # One row per range: bounded by the number of ranges.
    return (
        ranged.join(F.broadcast(handed_on), "__range", "left")
        .withColumn(column, filled)
        .select(*[ref(c) for c in df.columns])
    )


def _range_of(df: DataFrame, order_by: list[str], parts: int) -> Column:
    """The number of the range a row lies in: how many bounds its key has reached.

    The place among the sorted bounds is found by halving: from large to small, a step is
    taken when the bound at its end is not above the key.
    """
    fields = [field_of(df, c) for c in order_by]
    bounds = _bounds(df, order_by, parts)
    if not bounds:
        return F.lit(0)
    key = F.struct(*[ref(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    places = F.array(
        *[
            F.struct(*[F.lit(v).cast(f.dataType).alias(f"k{i}") for i, (v, f) in enumerate(zip(bound, fields))])
            for bound in bounds
        ]
    )
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        # beyond the last bound there is no bound, and no step
        return F.when(F.get(places, at + width - 1) <= key, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _bounds(df: DataFrame, order_by: list[str], parts: int) -> list[tuple]:
    """At most ``parts - 1`` keys that split the rows about evenly, in order.

    From about SAMPLED rows a range. Equal keys of the sample are counted before they
    are put in order, and texts are cut after BOUND_CHARS characters: a bound need not be
    a key of the table.
    """
    rows = df.count()
    if parts < 2 or not rows:
        return []
    names = [f"k{i}" for i in range(len(order_by))]

    def cut(name: str) -> Column:
        is_text = kind_of(field_of(df, name).dataType) == "Text"
        return F.substring(ref(name), 1, BOUND_CHARS) if is_text else ref(name)

    keys = df.select(*[cut(c).alias(n) for c, n in zip(order_by, names)])
    share = parts * SAMPLED / rows
    sample = keys.sample(share, seed=SAMPLED) if share < 1 else keys
    counted = sample.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    # One task orders the sample: its size is a parameter, whatever the table's.
    so_far = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy())
    cell = F.floor(F.coalesce(F.sum("n").over(so_far), F.lit(0)) * parts / total)
    starts = counted.withColumn("cell", cell).where("cell > 0")
    first = starts.groupBy("cell").agg(F.min(F.struct(*names)).alias("bound"))
    return [tuple(r.bound) for r in first.orderBy("cell").collect()]


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each group of equal rows; NaN and NULL are the same, as elsewhere.

    Rows are grouped by a digest of what `duplicate_rows` compares, so whole texts are
    no keys. Of equal rows the one that a task meets first stays.
    """
    row = F.struct(*[ref(n) for n in df.columns]).alias("row")
    return (
        df.select(*row_digest(df.schema.fields), row)
        .groupBy("digest_1", "digest_2")
        .agg(F.any_value("row").alias("row"))
        .select("row.*")
    )


def duplicates_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once; missing keys count as equal.

    Keys are counted before they are shuffled; a frequent key is one small row on
    the build side, and the rows it matches can be split by adaptive execution.
    """
    parts = [present(field_of(df, k)) for k in keys]  # NaN is missing like NULL
    repeated = (
        df.groupBy(*[part.alias(f"__k{i}") for i, part in enumerate(parts)])
        .count()
        .where("count > 1")
        .drop("count")
    )
    condition = F.lit(True)
    for i, part in enumerate(parts):
        condition = condition & part.eqNullSafe(F.col(f"__k{i}"))
    return df.join(repeated, condition, "left_semi")


def outside_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose value lies outside a range."""
    value = present(field_of(df, column))
    return df.where((value < low) | (value > high))


def zscore_outliers(df: DataFrame, column: str, limit: float = fixed.Z_LIMIT) -> DataFrame:
    """Rows whose value is far from the mean."""
    mean, std = moments(df.select(ref(column))).get(column, (None, None))
    if not std:
        return df.where(F.lit(False))
    value = present(field_of(df, column)).cast("double")
    return df.where(F.abs((value - F.lit(mean)) / F.lit(std)) > limit)


def outdated(df: DataFrame, column: str, days: int = 365, as_of=None) -> DataFrame:
    """Rows whose date is more than so many days old."""
    field = field_of(df, column)
    when = as_timestamp(present(field), field.dataType)
    return df.where(elapsed_days(moment(as_of), when) > days)


def not_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text does not match a pattern; missing text does not match."""
    return df.where(~F.coalesce(matches(ref(column), pattern), F.lit(False)))


def cast_or_null(df: DataFrame, column: str, data_type: str) -> DataFrame:
    """A column in another type, with NULL where a value does not fit."""
    return df.withColumn(column, ref(column).try_cast(data_type))
