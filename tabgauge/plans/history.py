"""History of assessments: an append-only table of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabgauge.functions import fixed
from tabgauge.functions.dates import moment
from tabgauge.plans import summary
from tabgauge.plans.assess import Assessment

KEPT = 10


def snapshot(result: Assessment, name: str, at=None) -> DataFrame:
    """One row: when, what, how large, the scores and the three worst issues."""
    scores = summary.overall_scores(result)
    wide = scores.agg(
        *[
            F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d)
            for d in ("overall", *fixed.DIMENSIONS)
        ]
    )
    worst = summary.top_issues(result, 3).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("rank"), "table", "column", "issue")))
    )
    sizes = result.tables.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("column_count").alias("total_columns"),
    )
    return (
        sizes.select(
            moment(at).alias("ts"),
            F.lit(name).alias("name"),
            "*",
            wide.select(F.struct("*")).scalar().alias("scores"),
            worst.scalar().alias("top_issues"),
        )
        .select("ts", "name", "table_count", "total_rows", "total_columns", "scores.*", "top_issues")
        .withColumn("day", F.to_date("ts"))
    )


def append(row: DataFrame, path: str) -> None:
    """Add snapshots to the history, in the folders day and batch ('single')."""
    row.withColumn("batch", F.lit("single")).write.mode("append").partitionBy("day", "batch").parquet(path)


def put_batch(row: DataFrame, path: str, batch: str) -> None:
    """Store the snapshot of a batch; storing the same batch again replaces it.

    The folders are those of `append`, so one history can have both kinds.
    """
    spark = row.sparkSession
    day = row.first()["day"]
    if _exists(spark, path):
        earlier = spark.read.option("basePath", path).parquet(path).where(F.col("batch") == batch)
        for other in {r.day for r in earlier.select("day").distinct().collect()} - {day}:
            _delete(spark, f"{path}/day={other}/batch={batch}")
    row.drop("day").write.mode("overwrite").parquet(f"{path}/day={day}/batch={batch}")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place) and len(files.listStatus(place)) > 0


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(history: DataFrame, rows: int = KEPT) -> DataFrame:
    """The last snapshots, newest first: the ones the trends look at."""
    return history.orderBy(F.desc("ts")).limit(rows)


def score_trend(history: DataFrame, rows: int = KEPT) -> DataFrame:
    """Chart data: one row per snapshot and score, oldest first."""
    names = [c for c in ("overall", *fixed.DIMENSIONS) if c in history.columns]
    return (
        latest(history, rows)
        .unpivot(["ts"], names, "dimension", "score")
        .where("score IS NOT NULL")
        .orderBy("ts", "dimension")
    )


def volume_trend(history: DataFrame, rows: int = KEPT) -> DataFrame:
    """Chart data: rows and columns per snapshot, oldest first."""
    return latest(history, rows).select("ts", "total_rows", "total_columns").orderBy("ts")


def score_change(history: DataFrame, rows: int = KEPT) -> DataFrame:
    """Overall score against the snapshot before, among the last snapshots.

    The window spans the last ``rows`` snapshots only.
    """
    before = F.lag("overall").over(Window.orderBy("ts"))
    return (
        latest(history, rows)
        .withColumn("previous", before)
        .withColumn("change", F.col("overall") - F.col("previous"))
        .select("ts", "name", "overall", "previous", "change")
    )


def biggest_changes(history: DataFrame, rows: int = 3) -> DataFrame:
    """The largest rises and falls; empty with fewer than three snapshots."""
    changes = score_change(history)
    enough = changes.agg(F.count(F.lit(1)) >= 3).scalar()
    kept = changes.where(enough)
    rises = kept.where("change > 0").orderBy(F.desc("change"), "ts").limit(rows)
    falls = kept.where("change < 0").orderBy("change", "ts").limit(rows)
    return rises.select(F.lit("improvement").alias("kind"), "*").unionByName(
        falls.select(F.lit("decline").alias("kind"), "*")
    )
