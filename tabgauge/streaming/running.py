"""Quality of all rows of a growing table, kept up to date batch by batch.

Each batch is reduced to one small row per column (its state). States of several batches
merge into the state of all their rows, so a new batch never needs the rows before it.
A state folder holds ``batches/batch=<id>`` and, after `fold`, ``folded/upto=<id>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabgauge.functions import fixed
from tabgauge.functions.text import TYPE_CLASSES
from tabgauge.operators.completeness import with_completeness
from tabgauge.operators.consistency import TYPES, with_type_consistency
from tabgauge.operators.measures import SIZE, VALUE, Measures, combined, measure
from tabgauge.plans.history import _delete, _place

FOLDED_EVERY = 50

_COLUMN = ("ordinal", "column", "dtype", "kind")
_COUNTS = ("row_count", "missing_count", "values", *(f"{c}_values" for c in TYPE_CLASSES))


def _state(kind: str):
    aggregates = {"values": F.count(VALUE), "distinct": F.hll_sketch_agg(F.col(VALUE).cast("string"))}
    if kind == "DateTime":
        aggregates |= {"first": F.min(VALUE), "last": F.max(VALUE)}
    if kind == "Numeric":
        squares = F.var_pop(VALUE) * F.count(VALUE)
        cubes = F.coalesce(F.nanvl(F.skewness(VALUE), F.lit(0.0)), F.lit(0.0))
        aggregates |= {
            "min": F.min(VALUE),
            "max": F.max(VALUE),
            "mean": F.avg(VALUE),
            "squares": squares,
            "cubes": cubes * F.count(VALUE) * F.pow(F.var_pop(VALUE), 1.5),
        }
    return {}, aggregates


#: Counts, extremes, mean, sums of squares and cubes about it, a sketch of the different values.
STATE = Measures(
    {"values": "bigint", "distinct": "binary", "first": "timestamp", "last": "timestamp"}
    | {n: "double" for n in ("min", "max", "mean", "squares", "cubes")},
    _state,
)


def state_of(batch: DataFrame) -> DataFrame:
    """The state of a batch: one row per column, read in one pass per kind of column."""
    return measure(batch, combined(SIZE, TYPES, STATE))


def merged(states: DataFrame) -> DataFrame:
    """The state of all rows, from the states of their parts.

    A batch without rows changes nothing. Sums about the common mean follow from those
    about each part's own, so large values lose no digits. One row per column and part.
    """
    weight = F.col("values") * F.col("mean")
    centres = states.groupBy("ordinal").agg((F.sum(weight) / F.sum(F.when(F.col("mean").isNotNull(), F.col("values")))).alias("centre"))
    off = F.col("mean") - F.col("centre")
    together = {
        "squares": F.sum(F.col("squares") + F.col("values") * off * off),
        "cubes": F.sum(F.col("cubes") + 3 * off * F.col("squares") + F.col("values") * off * off * off),
    }
    return (
        states.join(F.broadcast(centres), "ordinal")
        .groupBy(*_COLUMN)
        .agg(
            *[F.sum(n).alias(n) for n in _COUNTS],
            *[F.min(n).alias(n) for n in ("min", "first")],
            *[F.max(n).alias(n) for n in ("max", "last")],
            F.max("centre").alias("mean"),
            *[c.alias(n) for n, c in together.items()],
            F.hll_union_agg("distinct").alias("distinct"),
        )
    )


def quality(state: DataFrame) -> DataFrame:
    """Completeness, type consistency, moments and extremes per column of a state.

    Equal to the assessment of all rows at once; only ``distinct_estimate`` is a sketch's.
    """
    n = F.col("values").cast("double")
    spread = F.sqrt(F.col("squares") / F.nullif(n - 1, F.lit(0.0)))
    correction = F.sqrt(n * (n - 1)) / (n - 2)
    skew = F.col("cubes") / n / F.pow(F.col("squares") / n, 1.5) * correction
    varied = F.when(F.col("min") < F.col("max"), skew).otherwise(0.0)
    numeric = F.col("kind") == "Numeric"
    return with_type_consistency(with_completeness(state)).select(
        "ordinal", "column", "kind", "row_count", "missing_count",
        "completeness_percentage", "completeness_score",
        "types_found", "mixed_types", "type_score", "consistency_percentage",
        "min", "max", "mean",
        F.when(numeric & (n > 0), F.coalesce(spread, F.lit(0.0))).alias("std"),
        F.when(numeric & (n >= fixed.MIN_DISTRIBUTION_ROWS), varied).alias("skewness"),
        "first", "last",
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("distinct_estimate"),
    )


def put(state: DataFrame, path: str, batch: int) -> None:
    """Store the state of a batch; a batch that is stored again counts once."""
    if batch > _folded(state.sparkSession, path):
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The state of all rows so far."""
    upto = _folded(spark, path)
    parts = [f"{path}/batches/batch={b}" for b in _numbers(spark, f"{path}/batches", "batch") if b > upto]
    if upto >= 0:
        parts.append(f"{path}/folded/upto={upto}")
    if not parts:
        raise ValueError(f"no state in {path}")
    return merged(reduce(DataFrame.unionByName, [spark.read.parquet(part) for part in parts]))


def fold(spark: SparkSession, path: str) -> None:
    """Put the states of all batches so far into one, so that reading stays cheap.

    The new state counts once it is complete; only then are the old ones deleted.
    """
    batches, before = _numbers(spark, f"{path}/batches", "batch"), _folded(spark, path)
    if batches and batches[-1] > before:
        read(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/folded/upto={batches[-1]}")
    upto = _folded(spark, path)
    for batch in batches:
        if batch <= upto:
            _delete(spark, f"{path}/batches/batch={batch}")
    for old in _numbers(spark, f"{path}/folded", "upto"):
        if old < upto:
            _delete(spark, f"{path}/folded/upto={old}")


def watch_all(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the state of all rows of a stream; `quality(read(…))` tells it at any time."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            put(state_of(rows), path, number)
        finally:
            rows.unpersist()
        if number % FOLDED_EVERY == FOLDED_EVERY - 1:
            fold(batch.sparkSession, path)

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers of the complete folders ``<key>=<number>`` in a folder, in order."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in files.listStatus(place)]
    named = [(p, p.getName().split("=", 1)) for p in found if p.getName().startswith(f"{key}=")]
    return sorted(int(parts[1]) for p, parts in named if files.exists(marker(p, "_SUCCESS")))


def _folded(spark: SparkSession, path: str) -> int:
    """The last batch that is part of the folded state; -1 without one."""
    return max(_numbers(spark, f"{path}/folded", "upto"), default=-1)
