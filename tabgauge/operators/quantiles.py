"""Exact quantiles with linear interpolation by radix selection, one algorithm at any size.

All columns are stacked and searched together. A pass maps each value to a part by a
function that never decreases, and counts values per key and part, with the smallest and
the largest of each: plain aggregates that tasks combine before anything is shuffled. The
running counts show which part holds a wanted rank, and only the values of such parts are
looked at in the next pass. First parts are fractions of an octave, so infinite values and
both signs take their place in the order; later ones are equal slices between a part's
smallest and largest value. A rank is found where a part has one value, or at a part's
ends. Columns of few different values need one pass, most others two.

The chosen parts, a few per key, stay in Spark until the last one is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled

#: Slices of a part in every pass but the first.
PARTS = 1 << 16
#: First parts in an octave.
_FINE = 64
#: More than the octaves below one that a double can have.
_OCTAVES = 1_100


def _octave_part(value: Column) -> Column:
    """A whole number that never decreases as the value grows."""
    size = F.abs(value)
    most = F.lit(2 * _FINE * _OCTAVES)
    place = F.when(size == math.inf, most).otherwise(
        F.floor(F.log2(F.when(size == math.inf, 1.0).otherwise(size)) * _FINE).cast("int") + _FINE * _OCTAVES
    )
    return F.when(value == 0, 0).when(value > 0, place).otherwise(-place)


def _slice_part(value: Column, parts: int) -> Column:
    share = (value - F.col("low")) / (F.col("high") - F.col("low"))
    return F.least(F.floor(share * parts).cast("int"), F.lit(parts - 1))


def _counted(rows: DataFrame) -> DataFrame:
    """Values per key, segment (values before it) and part, and the values before each part."""
    counts = rows.groupBy("key", "segment", "part").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    earlier = (
        Window.partitionBy("key", "segment").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("segment") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return counts.withColumn("start", start)


def _holding(parts: DataFrame) -> DataFrame:
    """Parts that hold wanted ranks, with these."""
    end = F.col("start") + F.col("n")
    held = F.filter("ranks", lambda rank: (rank >= F.col("start")) & (rank < end))
    return (
        parts.withColumn("ranks", held)
        .where(F.size("ranks") > 0)
        .select("key", "total", "start", "n", "low", "high", "ranks")
    )


def _inner(rank: Column) -> Column:
    """Whether a rank is at neither end of a part of several values."""
    last = F.col("start") + F.col("n") - 1
    return (F.col("low") < F.col("high")) & (rank > F.col("start")) & (rank < last)


def _stored(parts: DataFrame) -> tuple[DataFrame, int]:
    """The parts, stored, and how many of them have ranks still to be found."""
    seen = Observation()
    open_ones = F.count_if(F.exists("ranks", _inner)).alias("n")
    stored = settled(parts.observe(seen, open_ones))
    return stored, seen.get["n"]


def quantile_table(
    stacked: DataFrame,
    shares: list[float],
    parts: int = PARTS,
    within: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """key, quantiles (an array, one per share), from rows (key, value).

    Keys without values are left out. Any number of keys; none needs to fit anywhere.
    ``within`` gives the rows for a table (of, low, high) again, at least those between the
    bounds of their key.
    """
    values = stacked.where(F.col("value").isNotNull())
    first = values.select("key", F.lit(0).cast("long").alias("segment"), "value", _octave_part(F.col("value")).alias("part"))
    total = F.sum("n").over(Window.partitionBy("key"))
    places = [F.lit(float(share)) * (F.col("total") - 1) for share in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    chosen = _holding(_counted(first).withColumn("total", total).withColumn("ranks", ranks))
    found, left = _stored(chosen)
    levels = [found]
    while left:
        opened = found.where(F.exists("ranks", _inner))
        bounds = opened.select(F.col("key").alias("of"), F.col("start").alias("segment"), "low", "high")
        again = within(bounds).where(F.col("value").isNotNull()) if within else values
        inside = again.join(
            bounds, F.col("key").eqNullSafe(F.col("of")) & F.col("value").between(F.col("low"), F.col("high"))
        )
        inside = inside.select("key", "segment", "value", _slice_part(F.col("value"), parts).alias("part"))
        wanted = opened.select(
            F.col("key").alias("of"), F.col("start").alias("origin"), "total", F.filter("ranks", _inner).alias("ranks")
        )
        placed = _counted(inside).join(
            wanted, F.col("key").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("origin"))
        )
        found, left = _stored(_holding(placed))
        levels.append(found)

    picked = None
    for level in levels:
        every = level.select("key", "total", "start", "n", "low", "high", F.explode("ranks").alias("rank"))
        value = F.when(F.col("rank") == F.col("start"), F.col("low")).otherwise(F.col("high"))
        own = every.where(~_inner(F.col("rank"))).select("key", "total", F.struct("rank", value.alias("value")).alias("found"))
        picked = own if picked is None else picked.union(own)
    known = picked.groupBy("key").agg(
        F.first("total").alias("total"), F.map_from_entries(F.collect_set("found")).alias("found")
    )
    return known.select("key", F.array(*[_between(p) for p in places]).alias("quantiles"))


def _between(place: Column) -> Column:
    """The value at a place between two ranks; between infinities and others nothing lies."""
    low, high = (F.element_at("found", f(place).cast("long")) for f in (F.floor, F.ceil))
    infinite = F.lit(math.inf)
    return (
        F.when((low == high) | (place == F.floor(place)) | (F.abs(low) == infinite), low)
        .when(F.abs(high) == infinite, high)
        .otherwise(low + (high - low) * (place - F.floor(place)))
    )


def exact_quantiles(
    df: DataFrame, values: dict[str, Column], shares: list[float], parts: int = PARTS
) -> dict[str, list[float | None]]:
    """Quantiles of each expression, skipping NULL; None for no values at all."""
    none: list[float | None] = [None] * len(shares)
    if not values:
        return {}
    numbers = {str(i): v.cast("double") for i, v in enumerate(values.values())}

    def stacked(chosen: dict[str, Column]) -> DataFrame:
        return df.select(*[v.alias(i) for i, v in chosen.items()]).unpivot([], list(chosen), "key", "value")

    def within(bounds: DataFrame) -> DataFrame:
        """Only columns that are still open, and of these what lies between the outer bounds."""
        outer = bounds.groupBy("of").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        ranges = {r["of"]: (r["low"], r["high"]) for r in outer}
        return stacked({i: F.when(v.between(*ranges[i]), v) for i, v in numbers.items() if i in ranges})

    table = quantile_table(stacked(numbers), shares, parts, within)
    found = {int(r["key"]): list(r["quantiles"]) for r in table.collect()}
    return {name: found.get(i, none) for i, name in enumerate(values)}
