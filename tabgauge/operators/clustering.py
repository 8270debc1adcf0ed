"""Clusters of rows, and statistics per cluster."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.columns import field_of, percent, present, ref
from tabgauge.operators.anomaly import mean_filled, numeric_choice
from tabgauge.operators.quantiles import quantile_table


def cluster_rows(
    df: DataFrame, columns: list[str] | None = None, k: int = 3, seed: int = 42, max_iter: int = 50
) -> DataFrame:
    """The table with a ``cluster`` number from k-means on the unscaled columns."""
    chosen = numeric_choice(df, columns)
    names = [f"__f{i}" for i in range(len(chosen))]
    filled = df.select("*", *[f.alias(n) for f, n in zip(mean_filled(df, chosen), names)])
    vectors = VectorAssembler(inputCols=names, outputCol="__features").transform(filled)
    model = KMeans(
        k=k, seed=seed, maxIter=max_iter, featuresCol="__features", predictionCol="cluster"
    ).fit(vectors.select("__features"))
    return model.transform(vectors).drop("__features", *names)


def cluster_sizes(clustered: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per cluster and their share."""
    sizes = clustered.groupBy(ref(label).alias(label)).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    return sizes.withColumn("percentage", percent(F.col("size"), total))


def cluster_stats(
    clustered: DataFrame, label: str = "cluster", columns: list[str] | None = None, median: bool = False
) -> DataFrame:
    """Size, share and mean, min, max, deviation (and median) per cluster and column."""
    chosen = [c for c in numeric_choice(clustered, columns, 1) if c != label]

    def value(name: str) -> Column:
        return present(field_of(clustered, name)).cast("double")

    wide = clustered.groupBy(ref(label).alias(label)).agg(
        F.count(F.lit(1)).alias("size"),
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.avg(value(c)).alias("mean"),
                F.min(value(c)).alias("min"),
                F.max(value(c)).alias("max"),
                F.stddev_samp(value(c)).alias("std"),
            ).alias(f"c{i}")
            for i, c in enumerate(chosen)
        ],
    )
    total = wide.agg(F.sum("size")).scalar()
    stats = wide.select(
        label,
        "size",
        percent(F.col("size"), total).alias("percentage"),
        F.inline(F.array(*[f"c{i}" for i in range(len(chosen))])),
    )
    return stats.join(cluster_medians(clustered, label, chosen), [label, "column"]) if median else stats


def cluster_medians(clustered: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Exact median per cluster and column, all searched together.

    No task holds the values of a cluster, and nothing per cluster reaches the driver.
    """
    cells = [
        F.struct(
            F.struct(ref(label).alias("group"), F.lit(i).alias("position")).alias("key"),
            present(field_of(clustered, c)).cast("double").alias("value"),
        )
        for i, c in enumerate(columns)
    ]
    found = quantile_table(clustered.select(F.inline(F.array(*cells))), [0.5])
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(
        F.col("key.group").alias(label),
        F.get(names, F.col("key.position")).alias("column"),
        F.col("quantiles")[0].alias("median"),
    )


def cluster_samples(
    clustered: DataFrame, order_by: list[str], label: str = "cluster", rows: int = 10
) -> DataFrame:
    """The first rows of every cluster in a stated order.

    Each task keeps its first rows per cluster before anything is shuffled.
    """
    number = "__number"
    first = Window.partitionBy(ref(label)).orderBy(*[ref(c) for c in order_by])
    return (
        clustered.withColumn(number, F.row_number().over(first))
        .where(F.col(number) <= rows)
        .drop(number)
    )
