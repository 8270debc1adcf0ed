"""Regular assessment as a stream.

``window_quality`` measures each time window of a stream as it closes; ``watch``
assesses every batch of new rows and appends the snapshot to the history.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabgauge.functions.columns import field_of, percent, present, ref
from tabgauge.plans import history
from tabgauge.plans.assess import Options, assess


def window_quality(
    stream: DataFrame,
    time: str,
    column: str,
    width: str = "1 hour",
    delay: str = "1 hour",
    valid: str | None = None,
) -> DataFrame:
    """Rows, missing and valid share, extremes per window.

    Of a stream, late rows are dropped once the watermark has passed their window, and
    a window is given out when the watermark passes its end, so the last windows of an
    input that has ended stay open; state holds one small row per open window. A table
    gives all its windows.
    """
    value = present(field_of(stream, column))
    condition = F.expr(valid) if valid else value.isNotNull()
    timed = stream.withWatermark(time, delay) if stream.isStreaming else stream
    grouped = (
        timed.groupBy(F.window(ref(time), width))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(value.isNull()).alias("missing"),
            F.count_if(condition).alias("valid"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "rows",
        percent(F.col("missing"), F.col("rows"), 0.0).alias("missing_percentage"),
        percent(F.col("valid"), F.col("rows") - F.col("missing"), 100.0).alias("valid_percentage"),
        "min",
        "max",
    )


def watch(
    stream: DataFrame,
    name: str,
    history_path: str,
    checkpoint: str,
    options: Options = Options(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Assess each batch of new rows and append a snapshot to the history.

    A batch that is run again after a failure replaces its own snapshot, so every batch
    is in the history once. The rows of a batch are kept while it is assessed, so its
    files are read once.
    """

    def assess_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not rows.isEmpty():
                row = history.snapshot(assess({name: rows}, options), name, options.as_of)
                history.put_batch(row, history_path, f"{name}-{batch_id}")
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(assess_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def file_stream(spark: SparkSession, path: str, like: DataFrame, glob: str | None = None) -> DataFrame:
    """A stream of Parquet files as they arrive, with the schema of a table."""
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)
