"""The registered queries: every operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import AS_OF, TABLES, spark_input
from tabgauge.functions.checkpoints import scratch_path, use_checkpoint_dir
from tabgauge.functions import scoring
from tabgauge.functions.columns import pick_columns
from tabgauge.functions.together import together
from tabgauge.operators import (
    accuracy, anomaly, clustering, completeness, consistency, distribution, near_rows, profile,
    relations, remediate, schema, timeliness, trend, uniqueness, validity,
)
from tabgauge.plans import history, insights, report, summary
from tabgauge.plans.assess import Assessment, Options, assess, metrics
from tabgauge.sources import tables
from tabgauge.streaming import monitor, running

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 5
ASSESSED = ("dirty_lineitem", "text_orders", "mixed_events", "contacts", "spoiled")
DESCRIBED = ("customer", "orders", "lineitem", "events", "documents", "embeddings", "conversations")
RULES = {
    "small_discount": "l_discount <= 0.08",
    "low_tax": "l_tax < 0.08",
    "known_quantity": "l_quantity >= 5",
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def on(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on one input."""
    return lambda spark, folder: rounded(make(spark_input(spark, folder, name)))


def over(names: tuple[str, ...], make: Callable[[DataFrame], DataFrame]) -> Query:
    """A query on each of several inputs, with the input's name in front."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        def one(n: str) -> DataFrame:
            return make(spark_input(spark, folder, n)).select(F.lit(n).alias("table"), "*")

        parts = together(spark, *[partial(one, n) for n in names])
        return rounded(reduce(DataFrame.unionByName, parts))

    return run


def _without_ordinal(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: make(df).drop("ordinal")


def assessment(
    spark: SparkSession, folder: str, dimensions: tuple[str, ...] = (), distributions: bool = True
) -> Assessment:
    """The assessment of the views with dirt in them, all dimensions unless some are named."""
    dataset = {n: spark_input(spark, folder, n) for n in ASSESSED}
    options = Options(as_of=AS_OF, rules={"dirty_lineitem": RULES}, distributions=distributions)
    return assess(dataset, replace(options, dimensions=dimensions) if dimensions else options)


def assessed(make: Callable, *dimensions: str) -> Query:
    """A query on an assessment of what it needs; histograms only where metrics show them."""
    return lambda spark, folder: rounded(make(assessment(spark, folder, dimensions, False)))


def ranked(make: Callable) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = assessment(spark, folder, distributions=False)
        found = insights.prioritized(insights.insights(insights.signals(result)))
        return rounded(make(found, summary.overall_scores(result)))

    return run


def _type_consistency(df: DataFrame) -> DataFrame:
    found = consistency.type_consistency(df).drop("ordinal")
    joined = F.when(F.col("mixed_types"), F.array_join(F.array_sort("types_found"), ","))
    return found.withColumn("types_found", F.coalesce(joined, F.lit("one")))


def _labels(df: DataFrame) -> DataFrame:
    value = F.col("completeness_percentage")
    return completeness.completeness_columns(df).select(
        "column",
        scoring.rating(value).alias("three_bands"),
        scoring.rating(value, "five").alias("five_bands"),
        scoring.quality_level(value).alias("level"),
        scoring.score_text(value).alias("score_text"),
        scoring.parse_score(F.concat(F.format_string("%.2f", value), F.lit("%"))).alias("parsed"),
        scoring.clamp_score(value * 1.1).alias("clamped"),
    )


def _info(spark: SparkSession, folder: str) -> DataFrame:
    found = schema.dataset_info({t: spark_input(spark, folder, t) for t in TABLES})
    return found.select("table", "rows", "columns")


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return schema.dataset_totals(
        schema.dataset_info({t: spark_input(spark, folder, t) for t in TABLES})
    )


def _series(df: DataFrame) -> DataFrame:
    return trend.monthly_series(df, "o_orderdate", "o_totalprice")


def _month_text(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


def _snapshots(make: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = make(spark_input(spark, folder, "daily"))
        return rounded(found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd")))

    return run


def _stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of files, run until the input is used up."""
    base = use_checkpoint_dir(spark)
    run = spark.range(1).select(F.expr("uuid()")).first()[0]
    like = spark_input(spark, folder, "events")
    events = monitor.file_stream(spark, folder, like, "events.parquet")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = monitor.window_quality(
        timed, "ts", "value", "1 hour", "1 hour", valid="value BETWEEN 0 AND 50"
    )
    target = f"{base}/stream-{run}"
    query = (
        windows.writeStream.format("parquet")
        .option("path", f"{target}/windows")
        .option("checkpointLocation", f"{target}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rounded(_minutes(spark.read.schema(windows.schema).parquet(f"{target}/windows")))


def _minutes(windows: DataFrame) -> DataFrame:
    form = "yyyy-MM-dd HH:mm"
    return windows.withColumns(
        {c: F.date_format(c, form) for c in ("window_start", "window_end")}
    )


def _table_windows(df: DataFrame) -> DataFrame:
    timed = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return _minutes(monitor.window_quality(timed, "ts", "value", valid="value BETWEEN 0 AND 50"))


def _running_quality(df: DataFrame) -> DataFrame:
    """The rows in three batches, one of them sent twice, the first two folded into one state."""
    spark = df.sparkSession
    path = scratch_path(spark)
    dealt = F.pmod(F.xxhash64(*df.columns), F.lit(3))
    for k in (0, 1, 1, 2):
        running.put(running.state_of(df.where(dealt == k)), path, k)
        if k == 1:
            running.fold(spark, path)
    return running.quality(running.read(spark, path)).select(
        "column", "row_count", "missing_count", "completeness_percentage", "completeness_score",
        "mixed_types", "type_score", "consistency_percentage", "min", "max", "mean", "std", "skewness",
    )


def _load_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of a folder, found and loaded through Spark's file systems."""
    found = tables.load_tables(spark, folder)
    return schema.dataset_info({t: found[t] for t in TABLES}).select("table", "rows", "columns")


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as CSV and loaded again, with its types recognised."""
    path = f"{scratch_path(spark)}.csv"
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tables.write_table(spark_input(spark, folder, "orders").select(*names), path)
    return rounded(tables.load_table(spark, path))


def _column_names(names: str) -> list[str]:
    return names.split()


_ISSUES = _column_names("completeness consistency accuracy")
_ANOMALY = _column_names("l_quantity l_extendedprice l_discount l_tax")
_CLUSTER = _column_names("user_id value")


def _scored(df: DataFrame) -> DataFrame:
    return anomaly.detect_anomalies(df, _ANOMALY)


def _forest_paths(df: DataFrame) -> DataFrame:
    """Different rows, and those whose score is not what joins with the forest give."""
    forest = anomaly.Forest(trees=10)
    count = df.count()
    features = anomaly.mean_filled(df, _ANOMALY)
    nodes = anomaly.fit_forest(df, features, forest, count)
    sample = min(forest.sample, count)
    vector = F.struct(*[f.alias(f"f{i}") for i, f in enumerate(features)])
    scored = df.withColumn("score", anomaly._scorer(df, nodes, sample)(vector))
    scored = scored.groupBy(*_ANOMALY).agg(F.min("score").alias("least"), F.max("score").alias("most"))
    paths = anomaly.joined_paths(df, features, nodes, _ANOMALY, sample)
    expected = -F.pow(F.lit(2.0), -F.col("path_length") / F.lit(float(anomaly.expected_path(sample))))
    same = (F.abs(F.col("least") - expected) < 1e-9) & (F.abs(F.col("most") - expected) < 1e-9)
    return scored.join(paths, _ANOMALY).agg(F.count("*").alias("rows"), F.count_if(~same).alias("different"))


_NEAR_TEXT = ["text", "lang", "source"]
_NEAR_CONTACT = _column_names("c_nationkey c_acctbal c_mktsegment email phone zip_code")


def _insight_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "rank", "table", F.coalesce("column", F.lit("")).alias("column"), "rule", "dimension", "p",
        "priority", "business_impact", F.col("implementation.effort").alias("effort"),
        F.col("improved_metrics")["overall_quality"].alias("overall_gain"),
        F.col("roles")["executive"].alias("executive"), "priority_score",
    )


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    # Tables and schema
    q["dataset_info"] = _info
    q["dataset_totals"] = _totals
    q["table_stats"] = on("documents", schema.table_stats)
    q["table_preview"] = on(
        "customer", lambda df: schema.preview(df, ["c_custkey"])
    )
    q["likely_date"] = over(
        ("text_orders", "contacts", "mixed_events"), lambda df: schema.likely_dates(df)
    )
    q["column_subset"] = on(
        "customer", lambda df: pick_columns(df, ["c_custkey", "no_such", "c_acctbal"])
    )
    q["column_flags"] = over(
        ("text_orders", "contacts", "mixed_events", "dirty_lineitem"),
        lambda df: schema.column_meta(df, ["order_date", "email", "value", "l_tax"]),
    )
    q["trend_dates"] = over(
        ("text_orders", "contacts", "mixed_events", "dirty_lineitem", "daily"), schema.trend_date_columns
    )
    q["type_distribution"] = over(DESCRIBED, schema.type_distribution)
    q["display_types"] = over(DESCRIBED, schema.display_types)
    q["score_labels"] = on("dirty_lineitem", _labels)

    # Completeness
    q["completeness_overall"] = over(
        ("dirty_lineitem", "labelled"), completeness.completeness_overall
    )
    q["completeness_columns"] = over(
        ("dirty_lineitem", "labelled"), _without_ordinal(completeness.completeness_columns)
    )
    q["completeness_top5"] = on("dirty_lineitem", completeness.top_incomplete)
    q["missing_by_column"] = over(("dirty_lineitem", "labelled"), completeness.missing_by_column)
    q["valid_and_missing"] = on("dirty_lineitem", completeness.valid_and_missing)
    q["missing_pattern"] = over(("dirty_lineitem", "labelled"), completeness.missing_patterns)
    q["missing_sample"] = on(
        "dirty_lineitem", lambda df: completeness.missing_sample(df, ["l_orderkey", "l_linenumber"])
    )

    # Consistency
    q["type_consistency"] = over(("mixed_events", "contacts", "doc_texts"), _type_consistency)
    q["numeric_ranges"] = over(
        ("lineitem", "orders", "mixed_events"), _without_ordinal(consistency.numeric_ranges)
    )
    q["iqr_outliers"] = over(
        ("lineitem", "orders", "mixed_events"), _without_ordinal(consistency.iqr_outliers)
    )
    q["consistency_overall"] = over(("mixed_events", "contacts"), consistency.consistency_overall)

    # Accuracy and distributions
    q["zscore_outliers"] = over(
        ("lineitem", "mixed_events", "customer"), _without_ordinal(accuracy.zscore_outliers)
    )
    q["text_style"] = over(
        ("customer", "part", "doc_texts"), _without_ordinal(accuracy.text_style)
    )
    q["accuracy_overall"] = over(("customer", "mixed_events"), accuracy.accuracy_overall)
    q["skewness"] = over(("lineitem", "mixed_events"), _without_ordinal(distribution.skewness))
    q["histogram_auto"] = over(("lineitem", "events"), distribution.histogram)
    q["histogram_fixed"] = on("orders", lambda df: distribution.histogram(df, 20))
    q["histogram_peaks"] = over(("lineitem", "events"), distribution.peaks)
    q["distribution_quality"] = over(
        ("lineitem", "events"), _without_ordinal(distribution.distribution)
    )

    # Uniqueness
    q["duplicate_rows"] = over(("doc_texts", "lineitem", "orders"), uniqueness.duplicate_rows)
    q["column_uniqueness"] = over(
        ("doc_texts", "dirty_lineitem", "orders"), _without_ordinal(uniqueness.column_uniqueness)
    )
    q["key_candidates"] = over(("orders", "events", "customer"), uniqueness.key_candidates)
    q["high_cardinality"] = over(
        ("doc_texts", "orders", "lineitem", "events"), uniqueness.high_cardinality
    )

    # Timeliness
    q["timeliness_columns"] = over(
        ("text_orders", "dirty_lineitem", "events"),
        _without_ordinal(lambda df: timeliness.timeliness_columns(df, AS_OF)),
    )
    q["timeliness_overall"] = over(
        ("text_orders", "events", "customer"), lambda df: timeliness.timeliness_overall(df, AS_OF)
    )
    q["date_ranges"] = over(
        ("text_orders", "dirty_lineitem"), lambda df: timeliness.date_ranges(df, AS_OF)
    )

    # Validity
    q["validity_formats"] = over(
        ("contacts", "page_links"), _without_ordinal(validity.validity_columns)
    )
    q["validity_ranges"] = over(
        ("percents", "page_links"), _without_ordinal(validity.validity_columns)
    )
    q["validity_overall"] = over(("contacts", "percents", "orders"), validity.validity_overall)
    q["business_rules"] = on("dirty_lineitem", lambda df: validity.business_rules(df, RULES).drop("position"))

    # Relations
    q["combo_completeness"] = on(
        "pairs", lambda df: relations.combination_completeness(df, ["segment", "nation", "balance"])
    )
    q["co_missing"] = on(
        "pairs", lambda df: relations.co_missing(df, ["segment", "nation", "balance"])
    )
    q["functional_dependency"] = over(
        ("lineitem", "orders"),
        lambda df: relations.functional_dependencies(
            df, ["l_partkey", "l_suppkey", "l_returnflag", "o_custkey", "o_orderstatus", "o_orderpriority"]
        ).drop("first", "second", "reverse"),
    )
    q["pair_correlation"] = on(
        "lineitem", lambda df: relations.pair_correlation(df, "l_quantity", "l_extendedprice")
    )
    q["correlation_matrix"] = on("dirty_lineitem", relations.correlation_matrix)
    q["contingency"] = on(
        "pairs",
        lambda df: relations.contingency(
            df.withColumn("rich", F.col("balance") > 5000), "segment", "rich"
        ),
    )
    q["strong_associations"] = on(
        "lineitem", lambda df: relations.strong_associations(df, "l_returnflag", "l_linestatus")
    )
    q["combo_quality"] = on(
        "pairs", lambda df: relations.combination_quality(df, ["segment", "nation"])
    )
    q["combo_recommendations"] = on(
        "pairs",
        lambda df: relations.combination_advice(df, ["segment", "nation"]).select("position", "category", "finding"),
    )

    # Profiles and chart data
    q["profile_overview"] = over(("dirty_lineitem", "doc_texts"), profile.table_overview)
    q["profile_numeric"] = over(("dirty_lineitem", "orders"), profile.numeric_profile)
    q["profile_date"] = over(
        ("dirty_lineitem", "events"),
        lambda df: profile.date_profile(df)
        .withColumn("earliest", F.date_format("earliest", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss")),
    )
    q["profile_text"] = over(("orders", "part", "doc_texts"), profile.text_profile)
    q["top_values"] = on("part", lambda df: profile.top_values(df, "p_brand"))
    q["records_per_month"] = on("orders", lambda df: profile.records_per_month(df, "o_orderdate"))
    q["box_stats"] = over(("lineitem", "orders"), profile.box_stats)
    q["scatter"] = on(
        "mixed_events", lambda df: profile.scatter(df, "user_id", "sparse_value", "event_type")
    )

    # Assessment, issues, advice
    q["assessment_scores"] = assessed(summary.dimension_scores)
    q["overall_scores"] = assessed(summary.overall_scores)
    q["assessment_metrics"] = lambda spark, folder: rounded(metrics(assessment(spark, folder)))
    q["top_issues"] = assessed(summary.top_issues, *_ISSUES)
    q["table_issues"] = assessed(summary.table_issues, *_ISSUES)
    q["dimension_recommendations"] = assessed(
        lambda r: summary.recommendations(summary.overall_scores(r)).select("dimension", "priority")
    )
    q["strongest_weakest"] = assessed(
        lambda r: summary.strongest_and_weakest(summary.overall_scores(r))
    )
    q["critical_dimension"] = assessed(summary.quality_context)
    q["report_rows"] = assessed(report.report)
    q["narrative"] = assessed(report.narrative)
    q["history_snapshot"] = assessed(
        lambda r: history.snapshot(r, "views", AS_OF)
        .drop("ts", "day", "top_issues")
    )

    # Insights
    q["insight_signals"] = assessed(
        lambda r: insights.signals(r).select(
            "table", "rule", F.coalesce("column", F.lit("")).alias("column"), "p"
        )
    )
    q["insights"] = ranked(lambda found, scores: _insight_rows(found))
    q["insight_priority"] = lambda spark, folder: rounded(
        insights.prioritized(
            insights.insights(insights.signals(assessment(spark, folder, distributions=False))),
            "validity",
        ).select("rank", "table", "rule", F.coalesce("column", F.lit("")).alias("column"), "priority_score")
    )
    q["top_recommendations"] = ranked(
        lambda found, scores: _insight_rows(insights.top_recommendations(found))
    )
    q["insights_by_role"] = ranked(
        lambda found, scores: insights.insights_by_role(found).select(
            "role", "rank", "table", "rule", F.coalesce("column", F.lit("")).alias("column")
        )
    )
    q["insight_stakeholders"] = ranked(
        lambda found, scores: insights.with_stakeholders(found).select(
            "rank", "rule", F.array_join("stakeholders", ",").alias("stakeholders")
        )
    )
    q["insight_phases"] = ranked(
        lambda found, scores: insights.with_phase(found).select("rank", "rule", "phase", "phase_gain")
    )
    q["insight_improvements"] = ranked(insights.improvements)
    q["insight_top_gains"] = ranked(
        lambda found, scores: insights.top_gains(insights.improvements(found, scores))
    )
    q["insight_text"] = ranked(lambda found, scores: insights.insight_text(found))
    q["executive_summary"] = ranked(
        lambda found, scores: insights.executive_summary(found, insights.improvements(found, scores))
    )

    # Trend
    q["monthly_series"] = on("orders", lambda df: _month_text(_series(df)))
    q["linear_trend"] = on("orders", lambda df: trend.linear_trend(_series(df)))
    q["forecast"] = on("orders", lambda df: _month_text(trend.forecast(_series(df), 7)))
    q["history_and_forecast"] = on(
        "orders", lambda df: _month_text(trend.history_and_forecast(_series(df), 12))
    )
    q["trend_stats"] = on("orders", lambda df: trend.trend_stats(_series(df), 7))
    q["seasonal_decomposition"] = on(
        "orders", lambda df: _month_text(trend.seasonal_decomposition(_series(df)))
    )
    q["seasonal_pattern"] = on(
        "orders", lambda df: trend.seasonal_pattern(trend.seasonal_decomposition(_series(df)))
    )
    q["strongest_months"] = on(
        "orders",
        lambda df: trend.strongest_months(
            trend.seasonal_pattern(trend.seasonal_decomposition(_series(df)))
        ),
    )

    # History
    q["history_latest"] = _snapshots(history.latest)
    q["history_score_trend"] = _snapshots(history.score_trend)
    q["history_volume_trend"] = _snapshots(history.volume_trend)
    q["history_change"] = _snapshots(history.score_change)
    q["history_biggest_changes"] = _snapshots(history.biggest_changes)

    # Repairs
    q["remediate_median_fill"] = on(
        "mixed_events",
        lambda df: remediate.fill_with_median(df, "sparse_value").select("event_id", "sparse_value"),
    )
    q["remediate_ffill"] = on(
        "mixed_events",
        lambda df: remediate.forward_fill(df, "sparse_value", ["ts", "event_id"]).select(
            "event_id", "sparse_value"
        ),
    )
    q["remediate_ffill_by_type"] = on(
        "mixed_events",
        lambda df: remediate.forward_fill(df, "sparse_value", ["event_type", "event_id"]).select(
            "event_id", "sparse_value"
        ),
    )
    q["remediate_dedup"] = on(
        "doc_texts", lambda df: remediate.drop_duplicates(df).select(F.sha2("text", 256).alias("digest"), "lang", "source", "n_chars")
    )
    q["remediate_dup_keys"] = on(
        "labelled", lambda df: remediate.duplicates_by_key(df, ["lang", "n_chars"])
    )
    q["remediate_range"] = on(
        "lineitem", lambda df: remediate.outside_range(df, "l_quantity", 3, 48)
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    )
    q["remediate_zscore"] = on(
        "events", lambda df: remediate.zscore_outliers(df, "value").select("event_id", "value")
    )
    q["remediate_outdated"] = on(
        "text_orders",
        lambda df: remediate.outdated(df, "order_date", 365, AS_OF).select("o_orderkey", "order_date"),
    )
    q["remediate_not_matching"] = on(
        "contacts",
        lambda df: remediate.not_matching(df, "email", r"^[a-z0-9]+@[a-z.]+$").select("c_custkey", "email"),
    )
    q["remediate_cast"] = on(
        "mixed_events",
        lambda df: remediate.cast_or_null(df, "mixed", "double").select("event_id", "mixed"),
    )

    # Groups and anomalies
    q["cluster_sizes"] = on("events", lambda df: clustering.cluster_sizes(df, "event_type"))
    q["cluster_stats"] = on(
        "events",
        lambda df: clustering.cluster_stats(df, "event_type", ["user_id", "value"], median=True),
    )
    q["cluster_samples"] = on(
        "events",
        lambda df: clustering.cluster_samples(df, ["event_id"], "event_type").select(
            "event_type", "event_id", "value"
        ),
    )
    q["clusters"] = on(
        "events",
        lambda df: clustering.cluster_rows(df, _CLUSTER).select("event_id", "user_id", "value", "cluster"),
    )
    q["anomalies"] = on(
        "lineitem",
        lambda df: _scored(df).select("l_orderkey", "l_linenumber", *_ANOMALY, "anomaly_score", "is_anomaly"),
    )
    q["anomaly_summary"] = on("lineitem", lambda df: anomaly.anomaly_summary(_scored(df)))
    q["anomaly_histogram"] = on("lineitem", lambda df: anomaly.score_histogram(_scored(df)))
    q["top_anomalies"] = on(
        "lineitem",
        lambda df: anomaly.top_anomalies(_scored(df)).select("l_orderkey", "l_linenumber", *_ANOMALY, "anomaly_score"),
    )

    q["anomaly_counts"] = on(
        "lineitem", lambda df: anomaly.anomaly_summary(_scored(df)).select("rows", "anomalies")
    )

    q["anomaly_paths"] = on("lineitem", _forest_paths)

    # Near-duplicate rows
    q["near_row_links"] = on("documents", lambda df: near_rows.near_row_links(df, "doc_id", _NEAR_TEXT, 70))
    q["near_row_groups"] = on("documents", lambda df: near_rows.near_row_groups(df, "doc_id", _NEAR_TEXT, 70))
    q["near_contacts"] = on(
        "contacts",
        lambda df: near_rows.near_row_links(df, "c_custkey", _NEAR_CONTACT, 60, {"c_acctbal": 50}),
    )

    # Streaming, and the same measure over a table, which gives all windows
    q["stream_windows"] = _stream_windows
    q["table_windows"] = on("events", _table_windows)
    q["running_quality"] = over(("mixed_events", "dirty_lineitem"), _running_quality)

    # Loading and storing
    q["load_folder"] = _load_folder
    q["csv_round_trip"] = _csv_round_trip
    return q
