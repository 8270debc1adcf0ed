"""Distributions of numeric columns: skewness, histograms, peaks.

Histograms count in bins before the shuffle; the number of automatic bins never
exceeds about twice the square root of the number of values. Peaks are found
from the counts of each bin and its two neighbours by grouping, so no window has
to hold a whole histogram.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import fixed
from tabgauge.functions.columns import present, ref
from tabgauge.functions.scoring import distribution_quality
from tabgauge.operators.consistency import Quartiles, numeric_fields, quartiles
from tabgauge.operators.measures import VALUE, Measures, count_where, measure

_BINS_PER_BLOCK = 10_000


def _skew(kind: str):
    if kind != "Numeric":
        return {}, {}
    n = F.count(VALUE).cast("double")
    correction = F.sqrt(n * (n - 1)) / (n - 2)
    skew = F.when(F.min(VALUE) < F.max(VALUE), F.skewness(VALUE) * correction).otherwise(0.0)
    return {}, {
        "values": F.count(VALUE),
        "skewness": F.when(n >= fixed.MIN_DISTRIBUTION_ROWS, skew),
    }


def finite(value: Column) -> Column:
    return F.abs(value) < F.lit(math.inf)


def _finite(kind: str):
    if kind != "Numeric":
        return {}, {}
    kept = F.when(finite(F.col(VALUE)), F.col(VALUE))
    return {}, {
        "finite_count": F.count(kept),
        "finite_min": F.min(kept),
        "finite_max": F.max(kept),
    }


# What histograms span: the values that are not infinite.
FINITE = Measures(
    {"finite_count": "bigint", "finite_min": "double", "finite_max": "double"}, _finite
)

# Number of values and sample skewness of numeric columns.
SKEW = Measures({"values": "bigint", "skewness": "double"}, _skew)


def skewness(df: DataFrame) -> DataFrame:
    """Sample skewness per numeric column with enough values."""
    return (
        measure(df, SKEW, numeric_fields(df))
        .where("skewness IS NOT NULL")
        .select("ordinal", "column", "skewness")
    )


def auto_bins(count: int, low: float, high: float, iqr: float, whole: bool) -> int:
    """Number of equal bins: the finer of the Sturges and the relaxed
    Freedman-Diaconis widths, and at least 1 wide for whole numbers."""
    reach = high - low
    if count == 0 or reach == 0:
        return 1
    sturges = reach / (math.log2(count) + 1.0)
    relaxed = max(2.0 * iqr / count ** (1.0 / 3.0), reach / math.sqrt(count) / 2)
    width = min(relaxed, sturges) if relaxed > 0 else sturges
    if whole and width < 1:
        width = 1.0
    return max(1, math.ceil(reach / width))


class Bins:
    """Equal bins over a range; the last bin includes its upper edge."""

    def __init__(self, low: float, high: float, count: int):
        if low == high:
            low, high = low - 0.5, high + 0.5
        self.low, self.high, self.count = low, high, count
        self.step = (high - low) / count


def _edge(index: Column) -> Column:
    """Lower edge of a bin, from the columns low, high, step and bins."""
    inner = index * F.col("step") + F.col("low")
    return F.when(index >= F.col("bins"), F.col("high")).otherwise(inner)


def _layout(df: DataFrame, found: dict[str, Bins]) -> DataFrame:
    """column, low, high, step, bins: one row per column."""
    rows = pa.Table.from_pylist(
        [
            {"column": n, "low": b.low, "high": b.high, "step": b.step, "bins": b.count}
            for n, b in found.items()
        ]
    )
    return df.sparkSession.createDataFrame(rows)


def bins_of(df: DataFrame, bins: int | None = None) -> dict[str, Bins]:
    """Bins per numeric column with values; automatic unless a number is given."""
    fields = numeric_fields(df)
    if not fields:
        return {}
    sizes = measure(df, FINITE, fields).collect()
    return bins_from(df, sizes, quartiles(df) if bins is None else {}, bins)


def bins_from(
    df: DataFrame, sizes: list[Row], found: Quartiles, bins: int | None = None
) -> dict[str, Bins]:
    """Bins from measures taken before: one row per numeric column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    result = {}
    for row in sizes:
        name, count = row["column"], row["finite_count"]
        if not count:
            continue
        low, high = row["finite_min"], row["finite_max"]
        number = bins
        if number is None:
            first, _, third = found[name]
            whole = isinstance(types[name], T.IntegralType)
            iqr = third - first if third > first else 0.0
            number = auto_bins(count, low, high, iqr, whole)
        result[name] = Bins(low, high, number)
    return result


def bin_counts(df: DataFrame, bins: dict[str, Bins]) -> DataFrame:
    """Values per column and bin, for bins that have any; infinite values have none.

    Columns are stacked before their bins are found, so that the generated code has one
    such expression, however wide the table is, and the JIT compiler takes it.
    """
    fields = [f for f in numeric_fields(df) if f.name in bins]
    values = df.select(*[present(f).cast("double").alias(f.name) for f in fields])
    stacked = values.unpivot([], [ref(f.name) for f in fields], "column", "value")
    # A bin by its width, corrected where rounding puts the value beyond an edge.
    scaled = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins").cast("double")
    guess = F.least(F.floor(scaled), F.col("bins") - 1).cast("int")
    down = (F.col("value") < _edge(F.col("guess"))).cast("int")
    up = ((F.col("value") >= _edge(F.col("guess") + 1)) & (F.col("guess") != F.col("bins") - 1)).cast("int")
    return (
        stacked.where(finite(F.col("value")))
        .join(F.broadcast(_layout(df, {f.name: bins[f.name] for f in fields})), "column")
        .withColumn("guess", guess)
        .groupBy("column", (F.col("guess") - down + up).alias("bin"))
        .count()
    )


def histogram(df: DataFrame, bins: int | None = None) -> DataFrame:
    """All bins of each numeric column with their edges and counts."""
    found = bins_of(df, bins)
    if not found:
        raise ValueError("the table has no numeric values")
    blocks = _layout(df, found).withColumn(
        "block", F.explode(F.expr(f"sequence(0, (bins - 1) div {_BINS_PER_BLOCK})"))
    )
    every_bin = blocks.withColumn(
        "bin",
        F.explode(
            F.expr(
                f"sequence(int(block * {_BINS_PER_BLOCK}),"
                f" int(least((block + 1) * {_BINS_PER_BLOCK}, bins) - 1))"
            )
        ),
    )

    return every_bin.join(bin_counts(df, found), ["column", "bin"], "left").select(
        "column",
        "bin",
        _edge(F.col("bin")).alias("bin_start"),
        _edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def infinite_values(df: DataFrame) -> DataFrame:
    """Number of infinite values per numeric column, which no histogram shows."""
    conditions = {f.name: ~finite(present(f).cast("double")) for f in numeric_fields(df)}
    return count_where(df, {"infinite_count": conditions}).drop("ordinal")


def peaks(df: DataFrame, bins: int | None = None) -> DataFrame:
    """Inner bins fuller than both neighbours, per numeric column."""
    return peaks_in(df, bins_of(df, bins))


def peaks_in(df: DataFrame, found: dict[str, Bins]) -> DataFrame:
    last = F.create_map(*[x for n, b in found.items() for x in (F.lit(n), F.lit(b.count - 1))])
    seen = bin_counts(df, found).select(
        "column",
        F.explode(
            F.array(
                F.struct(F.col("bin"), F.lit(0).alias("side"), "count"),
                F.struct((F.col("bin") + 1).alias("bin"), F.lit(-1).alias("side"), "count"),
                F.struct((F.col("bin") - 1).alias("bin"), F.lit(1).alias("side"), "count"),
            )
        ).alias("seen"),
    )
    side = F.col("seen.side")
    joined = seen.groupBy("column", F.col("seen.bin").alias("bin")).agg(
        *[
            F.coalesce(F.sum(F.when(side == s, F.col("seen.count"))), F.lit(0)).alias(name)
            for s, name in ((0, "own"), (-1, "left"), (1, "right"))
        ]
    )
    inner = (F.col("bin") > 0) & (F.col("bin") < last[F.col("column")])
    higher = (F.col("own") > F.col("left")) & (F.col("own") > F.col("right"))
    return joined.groupBy("column").agg(F.count_if(inner & higher).alias("potential_modes"))


def distribution(df: DataFrame) -> DataFrame:
    """Skewness, peaks and quality label per numeric column with enough values."""
    return (
        skewness(df)
        .join(peaks(df), "column")
        .withColumn(
            "distribution_quality", distribution_quality(F.col("skewness"), F.col("potential_modes"))
        )
    )
