"""Relations between columns: missing together, dependency, correlation.

A combination is a list of at least two existing column names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.columns import field_of, grouping_key, missing, names_of_kind, percent, present
from tabgauge.functions.scoring import correlation_strength, dependency_strength
from tabgauge.operators.completeness import complete_rows
from tabgauge.operators.pair_blocks import correlations, joint_counts

#: More different values than this make a table of shares unreadable.
MAX_CATEGORIES = 20


def combination(df: DataFrame, columns: list[str]) -> DataFrame:
    """The existing columns of a combination."""
    names = [c for c in columns if c in df.columns]
    if len(names) < 2:
        raise ValueError("a combination needs at least two existing columns")
    return df.select(*[present(field_of(df, n)).alias(n) for n in names])


def combination_completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every column of the combination has a value."""
    return complete_rows(combination(df, columns))


def _pairs_of(df: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """column_1, column_2 and the columns of found (first, second, …), also where it has no row.

    Pairs are made from positions in Spark: the plan does not grow with their number.
    """
    position, width = F.col("id"), len(names)
    first, second = F.floor(position / width).cast("int"), (position % width).cast("int")
    pairs = df.sparkSession.range(width**2).select(first.alias("first"), second.alias("second"))
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    # one row per pair of columns: the schema bounds it
    return (
        pairs.where("first <= second")
        .join(F.broadcast(found), ["first", "second"], "left")
        .withColumns({"column_1": F.get(listed, F.col("first")), "column_2": F.get(listed, F.col("second"))})
    )


def co_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per pair: missing together, missing each, and both conditional shares.

    One pass over the table for any number of columns.
    """
    table = combination(df, columns)
    names = table.columns
    counted = joint_counts(table, [missing(field_of(table, c)) for c in names])
    both, first, second = (F.coalesce(c, F.lit(0).cast("long")) for c in ("both", "with_first", "with_second"))
    return (
        _pairs_of(table, names, counted)
        .where("first < second")
        .select(
            "column_1",
            "column_2",
            both.alias("both_missing"),
            first.alias("missing_1"),
            second.alias("missing_2"),
            percent(both, first, 0.0).alias("second_missing_given_first"),
            percent(both, second, 0.0).alias("first_missing_given_second"),
        )
    )


def functional_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values of one column that fix the value of another.

    A value fixes another column when the smallest and the largest partner are
    the same, so one aggregation per determinant serves all partners, combines
    before the shuffle and never lists the partners of a frequent value. Partners
    are compared by two 64-bit hashes, whose extremes are numbers and so are
    aggregated by hashing, without a sort, whatever the partner's type.
    """
    table = combination(df, columns)
    fields = list(enumerate(table.schema.fields))
    keys = table.select(*[grouping_key(f).alias(f"k{i}") for i, f in fields])
    keys = keys.select(
        "*",
        *[F.when(F.col(f"k{i}").isNotNull(), F.xxhash64(f"k{i}")).alias(f"a{i}") for i, _ in fields],
        *[F.when(F.col(f"k{i}").isNotNull(), F.xxhash64(F.lit(1), f"k{i}")).alias(f"b{i}") for i, _ in fields],
    )

    def single(j: int) -> Column:
        same = (F.min(f"a{j}") == F.max(f"a{j}")) & (F.min(f"b{j}") == F.max(f"b{j}"))
        return F.coalesce(same, F.lit(False)).cast("int").alias(f"fixed{j}")

    names = table.columns
    parts = []
    for i, determinant in enumerate(names):
        others = [j for j in range(len(names)) if j != i]
        groups = (
            keys.where(F.col(f"k{i}").isNotNull())
            .groupBy(f"k{i}")
            .agg(*[single(j) for j in others])
        )
        counted = groups.agg(
            F.count(F.lit(1)).alias("groups"), *[F.sum(f"fixed{j}").alias(f"s{j}") for j in others]
        )
        rows = [
            F.struct(
                F.lit(min(i, j)).alias("first"),
                F.lit(max(i, j)).alias("second"),
                F.lit(i > j).alias("reverse"),
                F.lit(determinant).alias("determinant"),
                F.lit(names[j]).alias("dependent"),
                percent(F.col(f"s{j}"), F.col("groups")).alias("fd_score"),
            )
            for j in others
        ]
        parts.append(counted.where("groups > 1").select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts).select(
        "*",
        dependency_strength(F.col("fd_score")).alias("fd_strength"),
        (F.col("fd_score") == 100).alias("is_key"),
    )


def pair_correlation(df: DataFrame, first: str, second: str) -> DataFrame:
    """Correlation of two numeric columns and its strength."""
    table = combination(df, [first, second])
    values = [present(field_of(table, n)).cast("double").alias(v) for n, v in ((first, "a"), (second, "b"))]
    scale = F.nullif(F.stddev_samp("a") * F.stddev_samp("b"), F.lit(0.0))
    both = table.select(*values).where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg((F.covar_samp("a", "b") / scale).alias("pearson")).select(
        F.lit(first).alias("column_1"),
        F.lit(second).alias("column_2"),
        "pearson",
        correlation_strength(F.col("pearson")).alias("strength"),
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every two numeric columns, in both orders, and 1 with itself.

    Over the rows where both have a value; NULL if either is constant there. One pass over
    the table for any number of columns; without numeric columns there are no rows.
    """
    names = columns or names_of_kind(df, "Numeric")
    values = df.select(
        *[present(field_of(df, n)).cast("double").alias(f"v{i}") for i, n in enumerate(names)]
    )
    found = _pairs_of(df, names, correlations(values))
    turned = F.struct(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"))
    orders = F.when(F.col("first") == F.col("second"), F.array(F.struct("column_1", "column_2"))).otherwise(
        F.array(F.struct("column_1", "column_2"), turned)
    )
    return found.select(F.explode(orders).alias("pair"), "pearson").select("pair.*", "pearson")


def _value_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows per pair of values; counted before the shuffle, in one scan."""
    table = combination(df, [first, second])
    values = [F.col(f"`{c}`").cast("string").alias(f"value_{i}") for i, c in ((1, first), (2, second))]
    return table.select(*values).groupBy("value_1", "value_2").agg(F.count(F.lit(1)).alias("count"))


def category_counts(
    df: DataFrame, first: str, second: str, most: int | None = MAX_CATEGORIES
) -> DataFrame:
    """Different values of both columns, and whether `contingency` shows them."""
    counts = _value_pairs(df, first, second).agg(
        F.count_distinct("value_1").alias("values_1"), F.count_distinct("value_2").alias("values_2")
    )
    fits = F.lit(True) if most is None else F.greatest("values_1", "values_2") <= most
    return counts.withColumn("shown", fits)


def contingency(
    df: DataFrame, first: str, second: str, most: int | None = MAX_CATEGORIES
) -> DataFrame:
    """Share of rows per pair of values, when no column has more than ``most`` values.

    Otherwise empty: `category_counts` tells how many there are. ``most=None`` shows any
    number. Pairs that never occur are left out. The table is read and grouped once;
    everything else is derived from the pairs.
    """
    pairs = _value_pairs(df, first, second)
    total = F.sum(F.when(F.col("value_1").isNotNull() & F.col("value_2").isNotNull(), F.col("count")))
    whole = pairs.agg(
        total.alias("total"),
        F.greatest(F.count_distinct("value_1"), F.count_distinct("value_2")).alias("most"),
    )
    sizes = whole.select(F.struct("*")).scalar()
    shown = pairs.where("value_1 IS NOT NULL AND value_2 IS NOT NULL").withColumn("sizes", sizes)
    if most is not None:
        shown = shown.where(F.col("sizes.most") <= most)
    return shown.select(
        "value_1", "value_2", "count", (F.col("count") / F.col("sizes.total")).alias("share")
    )


def strong_associations(df: DataFrame, first: str, second: str, rows: int = 5) -> DataFrame:
    """The pairs of values that hold a tenth of the rows or more."""
    return (
        contingency(df, first, second)
        .where("share >= 0.1")
        .orderBy(F.desc("share"), "value_1", "value_2")
        .limit(rows)
        .select("value_1", "value_2", (F.col("share") * 100).alias("percentage"))
    )


def combination_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Completeness, mean dependency and their weighted sum."""
    complete = combination_completeness(df, columns)
    strength = functional_dependencies(df, columns).agg(
        F.coalesce(F.avg("fd_score"), F.lit(0.0)).alias("dependency_strength")
    )
    return complete.select(
        F.col("complete_rows_percentage").alias("completeness"),
        strength.scalar().alias("dependency_strength"),
    ).withColumn("overall", F.col("completeness") * 0.7 + F.col("dependency_strength") * 0.3)


def combination_advice(df: DataFrame, columns: list[str]) -> DataFrame:
    """What the relations suggest: one row per finding, in a fixed order."""
    names = combination(df, columns).columns
    complete = combination_completeness(df, columns).where("complete_rows_percentage < 95").select(
        F.lit(1).alias("position"),
        F.lit("Completeness").alias("category"),
        F.format_string("%.1f%% of the rows have a value in every column", "complete_rows_percentage").alias("finding"),
        F.lit("Check at entry that these columns are filled together.").alias("advice"),
    )
    together = co_missing(df, columns).where(
        "second_missing_given_first > 80 OR first_missing_given_second > 80"
    ).select(
        F.lit(2),
        F.lit("Co-missing Pattern"),
        F.format_string("%s and %s are mostly missing together", "column_1", "column_2"),
        F.lit("Find out which step of the process leaves both empty."),
    )
    strong = functional_dependencies(df, columns).where("fd_strength = 'Strong'").agg(
        F.array_sort(
            F.collect_list(
                F.struct("first", "second", "reverse", F.concat_ws("->", "determinant", "dependent").alias("name"))
            )
        ).alias("found")
    ).where("size(found) > 0").select(
        F.lit(3),
        F.lit("Functional Dependency"),
        F.concat(F.lit("One column fixes the other: "), F.array_join("found.name", ", ")),
        F.lit("Use it as a validation rule, or store the dependent column once."),
    )
    parts = [complete, together, strong]
    if len(names) == 2:
        if set(names) <= set(names_of_kind(df, "Numeric")):
            parts.append(
                pair_correlation(df, *names).where("abs(pearson) > 0.9").select(
                    F.lit(4),
                    F.lit("High Correlation"),
                    F.format_string("The columns move together (r = %.2f)", "pearson"),
                    F.lit("See whether one of them can be derived from the other."),
                )
            )
        parts.append(
            strong_associations(df, *names, rows=1).select(
                F.lit(5),
                F.lit("Value Association"),
                F.format_string("%s with %s makes up %.1f%% of the rows", "value_1", "value_2", "percentage"),
                F.lit("Ask whether this is a rule of the business, and check it."),
            )
        )
    return reduce(DataFrame.union, parts)
