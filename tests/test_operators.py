"""Operators on small tables whose results are known."""

import math
import time
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabgauge.functions import scoring
from tabgauge.functions.dates import parse_date
from tabgauge.functions.text import is_lower, is_title, is_upper
from tabgauge.operators import (
    accuracy, anomaly, clustering, completeness, consistency, distribution, near_rows, profile,
    relations, remediate, schema, timeliness, trend, uniqueness, validity,
)
from tabgauge.operators import quantiles
from tabgauge.operators.quantiles import exact_quantiles


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


# Missing values -------------------------------------------------------------


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    found = completeness.completeness_columns(df).first()
    assert (found["missing_count"], found["row_count"]) == (2, 3)
    assert found["completeness_percentage"] == pytest.approx(100 / 3)
    assert found["completeness_score"] == 20.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, x double, s string")
    overall = completeness.completeness_overall(df).first()
    assert (overall["total_cells"], overall["completeness_score"]) == (0, 100.0)
    assert uniqueness.duplicate_rows(df).first()["uniqueness_score"] == 100.0
    assert consistency.consistency_overall(df).first()["consistency_score"] == 100.0
    assert accuracy.accuracy_overall(df).first()["accuracy_score"] == 100.0
    assert validity.validity_overall(df).first()["validity_score"] == 100.0


def test_all_null(spark):
    df = spark.createDataFrame([(None, None, None)] * 3, "x double, s string, d date")
    found = by_column(consistency.value_consistency(df))
    assert found["x"]["iqr_outlier_count"] == 0 and found["x"]["value_score"] == 100.0
    assert found["x"]["mean"] is None
    assert rows(accuracy.zscore_outliers(df)) == []
    assert rows(accuracy.text_style(df)) == []
    assert rows(uniqueness.column_uniqueness(df)) == []
    dated = timeliness.timeliness_columns(df, "2024-01-01").first()
    assert (dated["timeliness_score"], dated["timeliness_category"]) == (0.0, "Invalid Dates")


def test_patterns_and_top_incomplete(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, None), (1, 2, 3)], "a int, b int, c int")
    assert dict(rows(completeness.missing_patterns(df))) == {"010": 1, "011": 1, "000": 1}
    assert [r["column"] for r in completeness.top_incomplete(df).collect()] == ["b", "c"]
    assert completeness.complete_rows(df).first()["complete_rows"] == 1


def test_odd_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", None, 3)], "`first_name` string, `a.b` double, `Größe` int")
    assert set(by_column(completeness.completeness_columns(df))) == {"first_name", "a.b", "Größe"}
    assert relations.co_missing(df, ["first_name", "a.b"]).first()["missing_2"] == 1
    assert by_column(uniqueness.column_uniqueness(df))["a.b"]["unique_values"] == 1
    assert by_column(consistency.value_consistency(df))["Größe"]["mean"] == 2.5


# Scores -----------------------------------------------------------------------


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(value=st.floats(0, 100))
def test_score_steps(spark, value):
    found = spark.range(1).select(scoring.step_score(F.lit(value), "text_accuracy")).first()[0]
    expected = (
        100 if value >= 95 else 90 if value >= 85 else 75 if value >= 70
        else 60 if value >= 56 else 40 if value >= 42 else 20
    )
    assert found == expected


@pytest.mark.parametrize(
    ("days", "score", "category"),
    [(10, 100, "Current"), (31, 99.8, "Recent"), (180, 85, "Recent"), (181, 99.75, "Outdated"),
     (365, 70, "Outdated"), (366, 99.9, "Obsolete"), (894, 47.1, "Obsolete"), (1365, 0, "Obsolete")],
)
def test_age(spark, days, score, category):
    age = F.lit(days)
    found = spark.range(1).select(scoring.age_score(age), scoring.age_category(age)).first()
    assert found[0] == pytest.approx(score) and found[1] == category


def test_text_of_scores(spark):
    df = spark.createDataFrame([("85%",), (" ",), ("n/a",), ("120",)], "t string")
    parsed = [r[0] for r in df.select(scoring.parse_score(F.col("t"))).collect()]
    assert parsed == [85.0, None, None, 120.0]
    clamped = [r[0] for r in df.select(scoring.clamp_score(scoring.parse_score(F.col("t")))).collect()]
    assert clamped == [85.0, 0.0, 0.0, 100.0]


# Text -------------------------------------------------------------------------


TEXTS = ["New York", "new york", "NEW", "A", "a", "2Nd", "They're", "Straße", "123", "",
         "ÉCOLE", "école", "École Normale", "new York-City", "New York-city", "Ǆ", "a1b", "A1B"]


@pytest.mark.parametrize("text", TEXTS)
def test_capitalisation_as_in_python(spark, text):
    t = F.lit(text)
    found = spark.range(1).select(is_lower(t), is_upper(t), is_title(t)).first()
    assert tuple(found) == (text.islower(), text.isupper(), text.istitle())


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2024-01-31", date(2024, 1, 31)), ("2024/1/3", date(2024, 1, 3)), ("1/31/2024", date(2024, 1, 31)),
     ("31-1-2024", date(2024, 1, 31)), ("20240131", date(2024, 1, 31)), ("2024-01", date(2024, 1, 1)),
     ("2024-02-30", None), ("99999999", None), ("5-LOW", None), ("2024-01-31 10:20:30", date(2024, 1, 31))],
)
def test_dates(spark, text, expected):
    assert spark.range(1).select(parse_date(F.lit(text)).cast("date")).first()[0] == expected


def test_types(spark):
    df = spark.createDataFrame([("1", "a"), ("2.5", "b"), ("true", "c"), ("2024-01-02", "d"), ("x", "e")], "m string, t string")
    found = by_column(consistency.type_consistency(df))
    assert found["m"]["type_score"] == 20.0 and found["m"]["consistency_percentage"] == 20.0
    assert not found["t"]["mixed_types"]


# Quantiles and distributions ----------------------------------------------------


@pytest.mark.parametrize("budget", [10_000_000, 1_000, 10])
def test_quantiles_exact_at_any_budget(spark, budget):
    random = np.random.default_rng(1)
    values = np.concatenate([random.lognormal(0, 3, 2000), np.full(1500, 2.5), -random.random(500)])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(7)
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, {"x": F.col("x"), "none": F.lit(None)}, shares, budget)
    assert found["x"] == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    assert found["none"] == [None] * len(shares)


@pytest.mark.parametrize("gathered", [100_000, 2])
def test_quantiles_with_infinities(spark, gathered):
    values = [float("inf")] * 3 + [float("-inf")] * 2 + [1.0, 2.0, 3.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = consistency.quartiles(df)
    assert found["x"] == [float("-inf"), 2.5, float("inf")]
    shares = [0.0, 0.5, 1.0]
    some = exact_quantiles(df, {"x": F.nullif("x", F.lit(float("nan")))}, shares, gathered)
    assert some["x"] == [float("-inf"), 2.5, float("inf")]


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert sum(r["count"] for r in distribution.histogram(df, 4).collect()) == 3
    assert sum(r["count"] for r in distribution.histogram(df).collect()) == 3
    assert distribution.infinite_values(df).first()["infinite_count"] == 1


def test_many_groups(spark):
    df = spark.range(1200).selectExpr("id % 150 AS g", "id AS v", "double(id) AS x")
    medians = clustering.cluster_medians(df, "g", ["x"]).collect()
    assert {r["g"]: r["median"] for r in medians} == {
        g: float(np.median(np.arange(g, 1200, 150))) for g in range(150)
    }
    samples = clustering.cluster_samples(df, ["v"], "g", 2)
    assert sorted(r["v"] for r in samples.collect()) == list(range(300))


def test_anomalies_do_not_depend_on_the_layout(spark):
    random = np.random.default_rng(4)
    rows = pd.DataFrame({"k": range(4000), "a": random.normal(size=4000), "b": random.normal(size=4000)})
    df = spark.createDataFrame(rows)

    def flagged(table):
        found = anomaly.detect_anomalies(table, ["a", "b"])
        return {r["k"] for r in found.where("is_anomaly").collect()}

    first = flagged(df)
    assert len(first) == 200 and first == flagged(df.repartition(7)) == flagged(df.orderBy("a"))


def test_long_dates_are_dates(spark):
    text = "2024-01-01 10:00:00.123456 America/Argentina/Buenos_Aires"
    assert spark.range(1).select(parse_date(F.lit(text)).cast("date")).first()[0] == date(2024, 1, 1)


def test_dependency_plan_has_no_sort(spark):
    df = spark.createDataFrame([("a", "x", 1)], "p string, q string, r int")
    plan = relations.functional_dependencies(df, ["p", "q", "r"])._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan.split("Physical Plan")[-1]


def test_too_many_categories_are_told(spark):
    df = spark.range(30).selectExpr("string(id) AS a", "string(id % 2) AS b")
    assert relations.contingency(df, "a", "b").collect() == []
    assert tuple(relations.category_counts(df, "a", "b").first()) == (30, 2, False)
    assert relations.contingency(df, "a", "b", most=None).count() == 30


def test_duplicates_with_nan_and_maps(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (double('nan'), map(1, 2)), (NULL, map(1, 2)), (1.0, map(1, 2)) AS t(x, m)"
    )
    assert remediate.drop_duplicates(df).count() == 2
    assert remediate.duplicates_by_key(df.drop("m"), ["x"]).count() == 2


def test_forward_fill_over_texts_and_missing_keys(spark):
    rows = [(f"k{i:03d}" if i else None, i, None if i % 3 else float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "t string, n int, x double").repartition(5)
    found = {r["n"]: r["x"] for r in remediate.forward_fill(df, "x", ["t"], 6).collect()}
    assert found == {i: float(i - i % 3) for i in range(120)}


@pytest.mark.parametrize("whole", [False, True])
def test_histogram_as_numpy(spark, whole):
    random = np.random.default_rng(3)
    values = random.gamma(2, 10, 3000)
    values = values.astype("int64") if whole else values
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    counts, edges = np.histogram(values, bins="auto")
    found = distribution.histogram(df).orderBy("bin").collect()
    assert [r["count"] for r in found] == list(counts)
    assert [r["bin_start"] for r in found] == pytest.approx(list(edges[:-1]))
    inner = sum(counts[i] > counts[i - 1] and counts[i] > counts[i + 1] for i in range(1, len(counts) - 1))
    assert distribution.peaks(df).first()["potential_modes"] == inner
    assert distribution.skewness(df).first()["skewness"] == pytest.approx(pd.Series(values).skew())


def test_constant_column(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(40)], "x double, y double")
    assert by_column(accuracy.zscore_outliers(df))["y"]["z_outlier_count"] == 0
    assert by_column(distribution.distribution(df))["y"]["distribution_quality"] == "Good"
    assert relations.pair_correlation(df, "x", "y").first()["pearson"] is None


# Uniqueness -------------------------------------------------------------------


def test_null_rows_are_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")
    assert uniqueness.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_long_text_is_compared_whole(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "a",), ("short",)], "t string")
    assert uniqueness.duplicate_rows(df).first()["duplicate_rows"] == 1
    assert by_column(uniqueness.column_uniqueness(df))["t"]["unique_values"] == 3
    assert profile.text_profile(df).first()["most_common"] == base + "a"


def test_arrays_and_maps(spark):
    df = spark.sql("SELECT array(1, 2) a, map('x', 1, 'y', 2) m UNION ALL SELECT array(1, 2), map('y', 2, 'x', 1)")
    assert uniqueness.duplicate_rows(df).first()["duplicate_rows"] == 1
    assert by_column(uniqueness.column_uniqueness(df))["a"]["unique_values"] == 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), min_size=1, max_size=30))
def test_duplicates_and_distinct_add_up(spark, values):
    df = spark.createDataFrame(values, "s string, n int").repartition(3)
    assert uniqueness.duplicate_rows(df).first()["duplicate_rows"] == len(values) - len(set(values))


# Time ---------------------------------------------------------------------------


def test_future_and_elapsed_days(spark):
    df = spark.createDataFrame([(datetime(2030, 1, 1, 23),)], "d timestamp")
    found = timeliness.timeliness_columns(df, "2030-01-01 00:00:00").first()
    assert found["recency_days"] == -1 and found["timeliness_category"] == "Current"


def test_gap_in_months(spark):
    months = [m for m in pd.date_range("2020-01-15", periods=26, freq="MS") if m.month not in (5,)]
    df = spark.createDataFrame([(m.date(), float(i)) for i, m in enumerate(months)], "d date, y double")
    found = trend.monthly_series(df, "d", "y").orderBy("idx").collect()
    span = pd.period_range(months[0], months[-1], freq="M")
    assert [r["idx"] for r in found] == list(range(len(span)))
    assert sum(r["value"] is None for r in found) == len(span) - len(months)


def test_decomposition_against_numpy(spark):
    random = np.random.default_rng(5)
    n = 40
    y = np.arange(n) * 2 + 10 * np.sin(np.arange(n) * 2 * np.pi / 12) + random.random(n)
    days = pd.date_range("2020-01-31", periods=n, freq="ME")
    df = spark.createDataFrame([(d.date(), float(v)) for d, v in zip(days, y)], "d date, y double")
    found = trend.seasonal_decomposition(trend.monthly_series(df, "d", "y")).orderBy("idx").collect()
    weights = np.r_[0.5, np.ones(11), 0.5] / 12
    smooth = np.convolve(y, weights, "valid")
    assert [r["trend"] for r in found[6:-6]] == pytest.approx(list(smooth))
    assert found[0]["trend"] is None and found[-1]["trend"] is None
    short = df.limit(20)
    assert rows(trend.seasonal_decomposition(trend.monthly_series(short, "d", "y"))) == []


# Relations -----------------------------------------------------------------------


def test_dependency_with_missing_partners(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 1), ("c", 2), (None, 9)], "k string, v int")
    found = {(r["determinant"], r["dependent"]): r["fd_score"] for r in relations.functional_dependencies(df, ["k", "v"]).collect()}
    assert found["k", "v"] == pytest.approx(100 / 3)


def test_correlation_uses_common_rows(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, None, 9], "b": [2, 1, 4, None, 5, 7], "c": [5, 5, 5, 5, 5, 5]}, dtype="float64")
    df = spark.createDataFrame(pdf)
    found = {(r["column_1"], r["column_2"]): r["pearson"] for r in relations.correlation_matrix(df).collect()}
    assert found["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert found["b", "a"] == found["a", "b"] and found["a", "c"] is None
    assert len(found) == 9


def test_correlation_over_many_columns(spark):
    """300 columns in five blocks: one scan, one plan size, missing values, far and constant columns."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(400, 300)) + rng.normal(size=(400, 1))
    values[:, 7] += 1e9
    values[:, 8] = 5.1
    values[:, 9] = np.r_[np.full(200, 1 / 3), np.full(200, 0.1)]
    values[rng.random(values.shape) < 0.2] = np.nan
    values[200:, 10] = np.nan  # over its rows column 9 is constant
    pdf = pd.DataFrame(values, columns=[f"c{i}" for i in range(300)])
    df = spark.createDataFrame(pdf).repartition(6)
    table = relations.correlation_matrix(df)
    narrow = relations.correlation_matrix(df.select("c0", "c1"))

    def steps(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return [plan.count(part) for part in ("MapInArrow", "Exchange", "Join", "Scan ExistingRDD")]

    assert steps(table) == steps(narrow)
    found = {(int(r[0][1:]), int(r[1][1:])): r[2] for r in table.collect()}
    assert len(found) == 90_000 and all(found[b, a] == v for (a, b), v in found.items())
    got = np.array([[found[a, b] if found[a, b] is not None else np.nan for b in range(300)] for a in range(300)])
    wanted = pdf.corr(min_periods=2).to_numpy()
    assert np.isnan(got[9, 10]) and np.isnan(got[8]).all()
    wanted[9, 10] = wanted[10, 9] = np.nan
    wanted[8] = wanted[:, 8] = np.nan
    assert np.allclose(got, wanted, atol=1e-6, equal_nan=True)


def test_correlation_edges(spark):
    def found(values, schema):
        return {(r[0], r[1]): r[2] for r in relations.correlation_matrix(spark.createDataFrame(values, schema)).collect()}

    assert found([], "a double, b int") == dict.fromkeys([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")])
    assert found([("x",)], "a string") == {}
    assert found([(1.0, 2)], "a double, b int")["a", "a"] is None
    endless = found([(1.0, 2.0, 1.0), (float("inf"), 3.0, 2.0), (2.0, 5.0, 4.0)], "a double, b double, c double")
    assert np.isnan(endless["a", "b"]) and endless["b", "c"] == pytest.approx(np.corrcoef([2, 3, 5], [1, 2, 4])[0, 1])


def test_missing_together_over_many_columns(spark):
    rng = np.random.default_rng(4)
    gone = rng.random((300, 150)) < rng.random(150)
    pdf = pd.DataFrame(np.where(gone, np.nan, 1.0), columns=[f"c{i}" for i in range(150)])
    found = relations.co_missing(spark.createDataFrame(pdf).repartition(5), list(pdf.columns)).collect()
    assert len(found) == 150 * 149 // 2
    for r in found:
        a, b = gone[:, int(r["column_1"][1:])], gone[:, int(r["column_2"][1:])]
        assert (r["both_missing"], r["missing_1"], r["missing_2"]) == ((a & b).sum(), a.sum(), b.sum())
    empty = relations.co_missing(spark.createDataFrame([], "a int, b string"), ["a", "b"]).collect()
    assert [tuple(r)[2:] for r in empty] == [(0, 0, 0, 0.0, 0.0)]


def test_too_many_categories(spark):
    df = spark.range(30).select(F.col("id").alias("a"), (F.col("id") % 2).alias("b"))
    assert rows(relations.contingency(df, "a", "b")) == []


# Repairs --------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 5])
def test_forward_fill_across_ranges(spark, parts):
    values = [None, 1.0, None, None, 4.0] + [None] * 40 + [7.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(4, "x")
    found = [r["x"] for r in remediate.forward_fill(df, "x", ["i"], parts).orderBy("i").collect()]
    assert found == [None if math.isnan(v) else v for v in pd.Series(values, dtype=float).ffill()]


@pytest.mark.parametrize("hot", ["2024-01-01T00:00:00", None])
def test_forward_fill_splits_a_frequent_first_key(spark, hot):
    """A third of all rows have one first key, the others' texts begin alike: no range is large."""
    rows = 6000
    first = [hot if i % 3 == 0 else f"2024-01-{i % 28 + 1:02d}T{i % 24:02d}" for i in range(rows)]
    table = pd.DataFrame({"t": first, "i": range(rows), "x": [float(i) if i % 7 == 0 else None for i in range(rows)]})
    df = spark.createDataFrame(table.astype({"t": object}), "t string, i int, x double").repartition(5, "x")
    sizes = [r["count"] for r in df.groupBy(remediate._range_of(df, ["t", "i"], 12)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * rows / 12
    found = {r["i"]: r["x"] for r in remediate.forward_fill(df, "x", ["t", "i"], 12).collect()}
    expected = table.sort_values(["t", "i"], na_position="first")
    filled = expected["x"].ffill()
    assert found == {i: None if math.isnan(x) else x for i, x in zip(expected["i"], filled)}


def test_forward_fill_plan_does_not_grow_with_the_ranges(spark):
    """The range is found by halving: one step more for twice as many bounds."""
    df = spark.range(4000).select(F.col("id").alias("i"), F.lit(None).cast("double").alias("x"))
    few, many = (str(remediate._range_of(df, ["i"], p)._jc.toString()).count("CASE") for p in (8, 64))
    assert few == many == 1
    ranges = df.groupBy(remediate._range_of(df, ["i"], 64).alias("r")).agg(F.min("i").alias("low"), F.max("i").alias("high"))
    bounds = [(r["low"], r["high"]) for r in ranges.orderBy("r").collect()]
    assert len(bounds) == 64
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("kind", ["timestamp", "date", "decimal(10,2)", "double", "binary"])
def test_forward_fill_by_other_kinds_of_keys(spark, kind):
    source = {"timestamp": "timestamp_seconds(i * 5000)", "date": "date_add(date'2024-01-01', i)", "binary": "cast(format_string('%04d', i) as binary)"}
    key = source.get(kind, f"CAST(CASE WHEN i = 299 AND '{kind}' = 'double' THEN 'NaN' ELSE i / 4 END AS {kind})")
    df = spark.range(300).selectExpr("CAST(id AS INT) AS i").selectExpr("i", f"{key} AS k", "CASE WHEN i % 9 = 4 THEN i END AS x")
    found = {r["i"]: r["x"] for r in remediate.forward_fill(df.repartition(4), "x", ["k"], 7).collect()}
    assert found == {i: None if i < 4 else i - (i - 4) % 9 for i in range(300)}


def test_forward_fill_without_rows(spark):
    df = spark.createDataFrame([], "i int, x double")
    assert remediate.forward_fill(df, "x", ["i"], 5).collect() == []


def test_duplicate_keys_keep_all(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert {r["v"] for r in remediate.duplicates_by_key(df, ["k"]).collect()} == {"a", "b", "d", "e"}


# Learning ---------------------------------------------------------------------------


def test_repeated_rows_hide_no_outlier(spark):
    """420 values of some 143 copies each and one row far off, in any layout."""
    rows = spark.range(60_000).select((F.col("id") % 60).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    far = spark.createDataFrame([(10_000.0, -10_000.0)], "a double, b double")
    table = rows.union(far)
    scored = anomaly.detect_anomalies(table, ["a", "b"])
    assert scored.where("a = 10000").first()["is_anomaly"]
    # it scores like the extremes of the others, well below their middle
    scores_of = {r["a"]: r["anomaly_score"] for r in scored.where("b in (0, -10000) and a in (10000, 28)").collect()}
    assert scores_of[10_000.0] < scores_of[28.0] - 0.05
    again = anomaly.detect_anomalies(table.repartition(9, "b"), ["a", "b"])

    def scores(found):
        return {(r["a"], r["b"]): r["anomaly_score"] for r in found.distinct().collect()}

    assert scores(scored) == scores(again)


def test_copies_are_drawn_as_if_each_by_itself(spark):
    """A row that is a third of the table has a third of every tree's sample."""
    third = spark.range(10_000).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    others = spark.range(20_000).select((F.col("id") * 1.0).alias("a"), F.lit(0.0).alias("b"))
    drawn = anomaly.draw(third.union(others), [F.col("a"), F.col("b")], anomaly.Forest(), 30_000).toPandas()
    assert 45_000 < drawn["copies"].sum() < 57_000 and len(drawn) < 40_000
    hot = drawn[drawn["f1"] == 2.0].groupby("tree")["copies"].sum()
    assert len(hot) == 100 and 140 < hot.mean() < 200 and hot.max() < 260
    assert drawn.groupby("tree")["copies"].sum().min() > 300
    few = anomaly.draw(third.limit(30), [F.col("a"), F.col("b")], anomaly.Forest(), 30).toPandas()
    assert few["copies"].tolist() == [30] * 100


def brute_near_rows(rows, percent):
    import itertools
    import re

    sets = {k: frozenset((0, w) for w in re.findall(r"\w+", t.lower())) if t else frozenset() for k, t in rows}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    found = set()
    for a, b in itertools.combinations(sorted(k for s, k in first.items() if s), 2):
        common = len(sets[a] & sets[b])
        if (100 + percent) * common >= percent * (len(sets[a]) + len(sets[b])):
            found.add((a, b, round(common / len(sets[a] | sets[b]), 9)))
    return found


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_near_rows_as_all_pairs(spark, percent):
    random = np.random.default_rng(percent)
    rows = []
    for i in range(300):
        base = [f"w{random.integers(0, 60)}" for _ in range(random.integers(0, 12))] if i % 3 == 0 or not rows[-1][1] else rows[-1][1].split()
        words = list(base)
        if words and i % 3:
            words[random.integers(0, len(words))] = f"v{random.integers(0, 5)}"
        rows.append((i, " ".join(words) or None))
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    found = {(r[0], r[1], round(r[2], 9)) for r in near_rows.near_row_links(df, "k", ["t"], percent).collect()}
    assert found == brute_near_rows(rows, percent)
    groups = {r["k"]: (r["group_key"], r["tokens"]) for r in near_rows.near_row_groups(df, "k", ["t"], percent).collect()}
    assert len(groups) == 300 and all(groups[a][0] == groups[b][0] for a, b, _ in found)
    assert all(groups[k] == (k, 0) for k, t in rows if t is None)


def test_near_rows_by_bands_and_without_rows(spark):
    rows = [(1, 10.0, date(2024, 1, 1), True), (2, 11.4, date(2024, 1, 2), True), (3, 90.0, date(2020, 1, 1), True), (4, None, None, None)]
    df = spark.createDataFrame(rows, "k long, x double, d date, b boolean")
    found = near_rows.near_row_links(df, "k", percent=40, bands={"x": 2.0, "d": 10}).collect()
    assert [(r[0], r[1]) for r in found] == [(1, 2)]
    assert near_rows.near_row_links(df, "k", percent=40).collect() == []
    assert near_rows.near_row_groups(df.limit(0), "k").collect() == []


def test_frequent_tokens_bring_no_rows_together(spark):
    """Rows that share two of four words never meet."""
    rows = [(i, f"customer germany a{i} b{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t string")
    classes = near_rows._classes(near_rows._sets(df, "k", ["t"], None))
    assert near_rows._posted(classes, 80).count() == 0
    assert near_rows._posted(classes, 50).where("175 * left >= 2 * 75 * n").count() == 0


def test_crowded_tokens_bring_few_rows_together(spark, monkeypatch):
    """Rows that have their rare tokens in crowds meet by several tokens, and only there."""
    monkeypatch.setattr(near_rows, "CROWD", 3)
    random = np.random.default_rng(5)
    drawn = random.integers(0, 6, (500, 5))
    rows = [(i, " ".join(f"c{j}x{v}" for j, v in enumerate(r)) + (f" u{i}" if i % 4 else "")) for i, r in enumerate(drawn.tolist())]
    df = spark.createDataFrame(rows, "k long, t string")
    found = {(r[0], r[1], round(r[2], 9)) for r in near_rows.near_row_links(df, "k", ["t"], 60).collect()}
    assert found == brute_near_rows(rows, 60) and len(found) > 40


def test_pairs_of_long_rows_by_sketch(spark):
    """Long sets that share half their words are dropped before any sets are fetched."""
    random = np.random.default_rng(6)
    rows = []
    for i in range(240):
        words = [f"w{v}" for v in random.choice(160, 80, replace=False)] if i % 3 == 0 else rows[-1][1].split()[1:] + [f"v{i % 7}"]
        rows.append((i, " ".join(words if i % 24 else words[:18])))
    df = spark.createDataFrame(rows, "k long, t string")
    classes = near_rows._classes(near_rows._sets(df, "k", ["t"], None))
    pairs = near_rows._long_pairs(classes, near_rows._posted(classes, 70), 70)
    stored = [f for f in pairs.inputFiles()]
    links = brute_near_rows(rows, 70)
    assert {(min(r["key_a"], r["key_b"]), max(r["key_a"], r["key_b"])) for r in pairs.collect()} == {(a, b) for a, b, _ in links}
    candidates = min((spark.read.parquet(f.rsplit("/", 1)[0]) for f in stored if "id_b" in spark.read.parquet(f).columns), key=lambda t: len(t.columns))
    assert candidates.count() < 3 * len(links)


def near_families(random, families, size, words):
    """Texts that are drawn anew or from their neighbour, some of them parts of it."""
    rows = []
    for i in range(families * size):
        if i % size:
            held = rows[-1][1].split()
            held = held[int(random.integers(0, 1 + len(held) // 6)) :] + [f"v{random.integers(0, 40)}" for _ in range(3)]
        else:
            held = [f"w{v}" for v in random.choice(3 * words, words, replace=False)]
        rows.append((i, " ".join(held)))
    return rows


def test_pairs_of_long_rows_in_rounds_and_cells(spark, monkeypatch):
    """Postings and whole sets are dealt out in rounds, long sets meet by many tokens: no pair is lost."""
    for name, value in {"ROUND": 2000, "LONGER": 40, "BLOCK": 300, "VERIFIED": 6000, "SLOTS": 256, "TURN": 100}.items():
        monkeypatch.setattr(near_rows, name, value)
    rows = near_families(np.random.default_rng(9), 24, 7, 70)
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    found = {(r[0], r[1], round(r[2], 9)) for r in near_rows.near_row_links(df, "k", ["t"], 65).collect()}
    assert found == brute_near_rows(rows, 65) and len(found) > 20


def test_long_rows_that_share_rare_words_are_not_fetched(spark, monkeypatch):
    """Sets too long for their sketch have to meet by many tokens before any are fetched."""
    monkeypatch.setattr(near_rows, "LONGER", 700)
    random = np.random.default_rng(11)
    words = [[f"w{v}" for v in random.choice(12000, 1500, replace=False)] for _ in range(30)]
    rows = [(i, " ".join(held + [f"often{v}" for v in random.choice(3000, 2500, replace=False)])) for i, held in enumerate(words)]
    rows += [(100 + i, rows[i][1] + " x y z") for i in range(3)]
    classes = near_rows._classes(near_rows._sets(spark.createDataFrame(rows, "k long, t string"), "k", ["t"], None))
    pairs = near_rows._long_pairs(classes, near_rows._posted(classes, 70), 70)
    tables = [spark.read.parquet(f.rsplit("/", 1)[0]) for f in pairs.inputFiles()]
    assert {(r["key_a"], r["key_b"]) for r in pairs.collect()} == {(i, 100 + i) for i in range(3)}
    assert all(t.count() < 30 for t in tables if "id_b" in t.columns)


def test_near_rows_leave_little_on_disk(spark):
    """On disk is a row for each class, not for each posting, and of shuffles no more than some sums."""
    rows = near_families(np.random.default_rng(3), 10, 6, 90)
    df = spark.createDataFrame(rows, "k long, t string")
    classes = near_rows._classes(near_rows._sets(df, "k", ["t"], None))
    posted = near_rows._posted(classes, 70)
    assert sum(spark.read.parquet(f).count() for f in posted.inputFiles()) <= len(rows) < posted.count()
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def stored():
        files = blocks.getAllFiles()
        return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}

    before = stored()
    pairs = near_rows._long_pairs(classes, posted, 70)
    deadline = time.time() + 20
    while (kept := sum(size for f, size in stored().items() if f not in before)) > 2000 and time.time() < deadline:
        time.sleep(0.2)
    assert kept <= 2000
    assert {(min(r["key_a"], r["key_b"]), max(r["key_a"], r["key_b"])) for r in pairs.collect()} == {r[:2] for r in brute_near_rows(rows, 70)}


def test_bins_of_stacked_columns(spark):
    """One expression finds the bins of all columns: the plan does not grow with their number."""
    random = np.random.default_rng(8)
    values = {f"a.{i}": random.normal(0, 10.0**i, 400) for i in range(6)}
    values["a.3"][:3] = [np.inf, -np.inf, np.nan]
    df = spark.createDataFrame(pd.DataFrame(values))
    bins = distribution.bins_of(df, 7)
    counted = distribution.bin_counts(df, bins)
    found = {(r["column"], r["bin"]): r["count"] for r in counted.collect()}
    for name, column in values.items():
        kept = column[np.isfinite(column)]
        expected = np.histogram(kept, 7)[0]
        assert [found.get((name, b), 0) for b in range(7)] == expected.tolist()
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("CAST(FLOOR") + plan.upper().count("CAST(LEAST(FLOOR") <= 2


def test_quantiles_read_only_open_columns_again(spark):
    """What the first pass settles is not looked at again, nor what lies beyond the open parts."""
    df = spark.range(20_000).select((F.col("id") % 3 * 1.0).alias("few"), (F.col("id") * 1.0).alias("many"))
    seen = []
    table = quantiles.quantile_table

    def watched(stacked, shares, parts, within):
        def again(bounds):
            rows = within(bounds)
            seen.append({r["key"]: r["n"] for r in rows.where("value is not null").groupBy("key").agg(F.count("*").alias("n")).collect()})
            return rows

        return table(stacked, shares, parts, again)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quantiles, "quantile_table", watched)
        found = quantiles.exact_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5, 0.75])
    assert found == {"few": [0.0, 1.0, 2.0], "many": [4999.75, 9999.5, 14999.25]}
    assert list(seen[0]) == ["1"] and seen[0]["1"] < 11_000


def test_planted_outliers_score_lowest(spark):
    random = np.random.default_rng(2)
    normal = random.normal(0, 1, (2000, 2))
    planted = np.array([[30.0, 30.0], [-28.0, 25.0], [40.0, -35.0]])
    pdf = pd.DataFrame(np.vstack([normal, planted]), columns=["a", "b"])
    df = spark.createDataFrame(pdf.assign(id=range(len(pdf))))
    scored = anomaly.detect_anomalies(df, ["a", "b"])
    lowest = [r["id"] for r in anomaly.top_anomalies(scored, 3).collect()]
    assert set(lowest) == {2000, 2001, 2002}
    summary = anomaly.anomaly_summary(scored).first()
    assert summary["anomaly_percentage"] == pytest.approx(5, abs=0.3)
    assert summary["threshold_line"] < 0


def test_clusters_find_separate_groups(spark):
    random = np.random.default_rng(4)
    points = np.vstack([random.normal(c, 0.5, (100, 2)) for c in (0, 20, 50)])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"]))
    clustered = clustering.cluster_rows(df, k=3)
    assert sorted(r["size"] for r in clustering.cluster_sizes(clustered).collect()) == [100, 100, 100]
    stats = clustering.cluster_stats(clustered, columns=["a"], median=True).collect()
    assert sorted(round(r["median"], -1) for r in stats) == [0, 20, 50]
    with pytest.raises(ValueError):
        clustering.cluster_rows(df.select("a"))


# Schema -------------------------------------------------------------------------------


def test_schema_tables(spark):
    df = spark.createDataFrame([(1, 1.5, "2024-01-01", True)], "i bigint, x double, s string, b boolean")
    kinds = dict(rows(schema.type_distribution(df)))
    assert kinds == {"Numeric": 2, "DateTime": 0, "Boolean": 1, "Text": 1, "Categorical": 0, "Other": 0}
    meta = by_column(schema.column_meta(df, ["i"]))
    assert meta["s"]["likely_date"] and not meta["s"]["is_selected"] and meta["i"]["is_numeric"]
    assert dict(rows(schema.display_types(df)))["Numeric (Integer)"] == 1
    assert [r["column"] for r in schema.trend_date_columns(df).collect()] == ["s"]


def test_checks_by_name(spark):
    df = spark.createDataFrame([("a@b.io", "+49 30 12345", 130), ("nope", "1", 30)], "Email string, mobile string, age int")
    found = by_column(validity.validity_columns(df))
    assert {c: found[c]["valid_count"] for c in found} == {"Email": 1, "mobile": 1, "age": 1}
    assert found["age"]["status"] == "Invalid"
