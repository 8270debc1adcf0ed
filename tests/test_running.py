"""Quality of a growing table: parts give what the whole gives."""

import math

import pytest
from pyspark.sql import functions as F

from tabgauge.operators import completeness, consistency, distribution
from tabgauge.operators.measures import measure
from tabgauge.streaming import monitor, running


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(900).selectExpr(
        "CAST(id AS INT) AS n",
        "CASE WHEN id % 7 > 0 THEN 1e9 + pow(id % 50, 2) END AS `far.x`",
        "CASE WHEN id % 3 = 0 THEN '17' WHEN id % 5 > 0 THEN concat('w', id % 40) END AS t",
        "timestamp_seconds(id * 1000) AS ts",
        "CAST(NULL AS DOUBLE) AS none",
        "CASE WHEN id = 5 THEN CAST('NaN' AS DOUBLE) ELSE 2D END AS two",
    )


def rows(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def same(found, whole):
    for column, expected in whole.items():
        for name, value in expected.items():
            if isinstance(value, float) and math.isfinite(value):
                assert found[column][name] == pytest.approx(value, rel=1e-6, abs=1e-6), (column, name)
            else:
                assert found[column][name] == value, (column, name)


def test_batches_as_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "state")
    part = F.when(F.col("n") < 4, 0).when(F.col("n") < 300, 1).otherwise(3)
    for k in range(5):  # 2 and 4 have no rows
        running.put(running.state_of(table.where(part == k)), path, k)
        running.put(running.state_of(table.where(part == k)), path, k)
        if k in (1, 4):
            running.fold(spark, path)
        if k == 3:
            running.put(running.state_of(table), path, 0)  # folded before: counts no more
    found = rows(running.quality(running.read(spark, path)))
    same(found, rows(completeness.completeness_columns(table)))
    same(found, rows(consistency.type_consistency(table)))
    same(found, rows(measure(table, consistency.SPREAD).drop("dtype")))
    same(found, rows(measure(table, distribution.SKEW).select("column", "skewness")))
    assert found["ts"]["first"].timestamp() == 0 and found["ts"]["last"].timestamp() == 899_000
    assert found["n"]["distinct_estimate"] == pytest.approx(900, rel=0.05)
    assert found["none"]["distinct_estimate"] == 0
    assert [p.name for p in (tmp_path / "state" / "folded").iterdir()] == ["upto=4"]


def test_incomplete_fold_is_not_read(spark, table, tmp_path):
    path = str(tmp_path / "state")
    running.put(running.state_of(table), path, 0)
    (tmp_path / "state" / "folded" / "upto=0").mkdir(parents=True)
    assert rows(running.read(spark, path))["n"]["row_count"] == 900


def test_stream(spark, table, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(2):
        table.where(F.col("n") % 2 == k).write.mode("append").parquet(source)
        stream = monitor.file_stream(spark, source, table)
        running.watch_all(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    same(rows(running.quality(running.read(spark, path))), rows(completeness.completeness_columns(table)))


def test_without_state(spark, tmp_path):
    with pytest.raises(ValueError, match="no state"):
        running.read(spark, str(tmp_path / "nothing"))


def test_empty_table(spark, table, tmp_path):
    running.put(running.state_of(table.limit(0)), str(tmp_path / "state"), 0)
    found = rows(running.quality(running.read(spark, str(tmp_path / "state"))))
    assert found["n"]["row_count"] == 0 and found["n"]["mean"] is None and found["n"]["std"] is None
