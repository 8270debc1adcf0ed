"""Monthly trends: series, linear forecast, seasonal pattern.

Rows are reduced to one per month first; the windows after that span months
only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions import fixed
from tabgauge.functions.columns import field_of, present
from tabgauge.functions.dates import as_timestamp

PERIOD = 12


def monthly_series(df: DataFrame, date: str, target: str) -> DataFrame:
    """Mean per calendar month, from the first to the last month without gaps.

    ``month`` is the last day, ``idx`` counts from 0; a month without values has
    a NULL value. Rows whose date cannot be read are left out.
    """
    date_field = field_of(df, date)
    month = F.last_day(as_timestamp(present(date_field), date_field.dataType).cast("date"))
    means = (
        df.select(month.alias("month"), present(field_of(df, target)).cast("double").alias("value"))
        .where("month IS NOT NULL")
        .groupBy("month")
        .agg(F.avg("value").alias("value"))
    )
    start = F.trunc("month", "MM")
    next_start = F.trunc(F.lead("month").over(Window.orderBy("month")), "MM")
    spans = means.withColumns(
        {
            "start": start,
            "until": F.coalesce(F.add_months(next_start, -1), start),
            "first": F.trunc(F.min("month").over(Window.partitionBy()), "MM"),
        }
    )
    # A month and the empty months after it.
    each = spans.select(
        "*", F.explode(F.sequence("start", "until", F.expr("interval 1 month"))).alias("each")
    )
    return each.select(
        F.last_day("each").alias("month"),
        F.round(F.months_between("each", "first")).cast("int").alias("idx"),
        F.when(F.col("each") == F.col("start"), F.col("value")).alias("value"),
    )


def _fit(series: DataFrame, *more) -> DataFrame:
    return series.agg(
        F.regr_slope("value", "idx").alias("slope"),
        F.regr_intercept("value", "idx").alias("intercept"),
        F.max("idx").alias("last_idx"),
        F.max("month").alias("last_month"),
        *more,
    )


def linear_trend(series: DataFrame) -> DataFrame:
    """Slope and intercept over the month index, skipping empty months."""
    return _fit(series).select("slope", "intercept")


def forecast(series: DataFrame, months: int = 7) -> DataFrame:
    """The fitted line continued for so many months, at least one."""
    if months < 1:
        raise ValueError("months must be at least 1")
    ahead = _fit(series).where("last_idx IS NOT NULL").withColumn(
        "ahead", F.explode(F.sequence(F.lit(1), F.lit(months)))
    )
    return ahead.select(
        F.last_day(F.add_months("last_month", F.col("ahead"))).alias("month"),
        (F.col("last_idx") + F.col("ahead")).alias("idx"),
        (F.col("slope") * (F.col("last_idx") + F.col("ahead")) + F.col("intercept")).alias("value"),
    )


def history_and_forecast(series: DataFrame, months: int = 7) -> DataFrame:
    """Chart data: the series followed by its forecast."""
    return series.select("month", "value", F.lit("Historical").alias("type")).unionByName(
        forecast(series, months).select("month", "value", F.lit("Forecast").alias("type"))
    )


def trend_stats(series: DataFrame, months: int = 7) -> DataFrame:
    """Mean change per month, direction, current and forecast value."""
    change = F.col("value") - F.lag("value").over(Window.orderBy("idx"))
    fitted = _fit(
        series.withColumn("change", change),
        F.avg("change").alias("average_change"),
        F.avg("value").alias("mean_value"),
        F.max_by("value", "idx").alias("current_value"),
    )
    end = F.col("slope") * (F.col("last_idx") + months) + F.col("intercept")
    return fitted.select(
        "average_change",
        (F.col("average_change") / F.nullif(F.col("mean_value"), F.lit(0.0)) * 100).alias(
            "percentage_change"
        ),
        F.when(F.col("average_change") > 0, "Increasing")
        .when(F.col("average_change") < 0, "Decreasing")
        .otherwise("Stable")
        .alias("direction"),
        "current_value",
        end.alias("forecast_end_value"),
        (end - F.col("current_value")).alias("forecast_delta"),
    )


def seasonal_decomposition(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """Additive trend, seasonal part and residual; empty below two full periods.

    The trend is a centred moving average over ``period`` months (half weight at
    both ends for an even period), so it is NULL at the ends of the series.
    """
    in_order = Window.orderBy("idx")
    half = period // 2
    if period % 2 == 0:
        inner = F.sum("value").over(in_order.rowsBetween(-(half - 1), half - 1))
        ends = F.lag("value", half).over(in_order) + F.lead("value", half).over(in_order)
        trend = (inner + ends / 2.0) / period
    else:
        trend = F.avg("value").over(in_order.rowsBetween(-half, half))
    everything = Window.partitionBy()
    complete = (F.col("idx") >= half) & (F.col("idx") <= F.max("idx").over(everything) - half)
    phase = Window.partitionBy("phase")
    first_of_phase = F.row_number().over(phase.orderBy("idx")) == 1
    return (
        series.withColumn("trend", F.when(complete, trend))
        .withColumn("phase", F.col("idx") % period)
        .withColumn("phase_mean", F.avg(F.col("value") - F.col("trend")).over(phase))
        .withColumn("of_phase", F.when(first_of_phase, F.col("phase_mean")))
        .withColumn("seasonal", F.col("phase_mean") - F.avg("of_phase").over(everything))
        .withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
        .withColumn("months", F.count(F.lit(1)).over(everything))
        .where(F.col("months") >= 2 * period)
        .select("month", "idx", "value", "trend", "seasonal", "residual")
    )


def seasonal_pattern(decomposed: DataFrame) -> DataFrame:
    """Mean seasonal effect per calendar month."""
    names = F.array(*[F.lit(m) for m in fixed.MONTHS])
    return (
        decomposed.groupBy(F.month("month").alias("month_number"))
        .agg(F.avg("seasonal").alias("seasonality"))
        .withColumn("month_name", F.element_at(names, F.col("month_number")))
    )


def strongest_months(pattern: DataFrame, rows: int = 3) -> DataFrame:
    """The months with the largest effect and its direction."""
    return (
        pattern.orderBy(F.desc(F.abs("seasonality")), "month_number")
        .limit(rows)
        .select(
            "month_name",
            F.when(F.col("seasonality") > 0, "increase").otherwise("decrease").alias("direction"),
            F.abs("seasonality").alias("effect"),
        )
    )
