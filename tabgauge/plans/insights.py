"""Insights: findings turned into ranked, costed proposals.

``signals`` derives from an assessment the percentages the rules look at; each
rule says when a signal is worth a proposal and what it is worth. All tables here
have at most columns x rules rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions import fixed
from tabgauge.operators.measures import settled
from tabgauge.plans.assess import Assessment

P = "p"


@dataclass(frozen=True)
class Rule:
    """When a signal fires, how much it matters and what acting on it brings.

    ``priorities``: (above, label, impact), first match wins; the last entry has
    no limit. ``efforts``: (below, label). ``gains``: metric to (factor, cap).
    ``executive``: (above, relevance then, relevance otherwise).
    """

    name: str
    dimension: str
    fires_above: float
    keep: int | None
    priorities: tuple
    efforts: tuple
    gains: dict
    data_team: float
    business_users: float
    executive: tuple
    title: str
    actions: tuple[str, ...]
    tools: tuple[str, ...]
    example: str
    #: What the signal is multiplied by to be a percentage.
    scale: int = 1


_SHARES = ((50, "critical", 0.9), (30, "high", 0.7), (15, "medium", 0.5), (None, "low", 0.3))

# Limits, weights and gains of the rules. Titles, actions, tools
# and examples are wording only.
RULES = (
    Rule(
        "missing_values", "completeness", 20, 3, _SHARES,
        ((30, "small"), (None, "moderate")),
        {"completeness_score": (1 / 2, 20), "overall_quality": (1 / 5, 10)},
        0.9, 0.7, (50, 0.3, 0.1),
        "Complete the column {c}",
        ("Trace where values of {c} are lost", "Make {c} mandatory on entry",
         "Fill the gaps where an estimate is acceptable"),
        ("entry forms", "imputation"),
        "remediate.fill_with_median(df, '{c}')",
    ),
    Rule(
        "type_consistency", "consistency", 10, 3,
        ((30, "critical", 0.9), (20, "high", 0.7), (10, "medium", 0.5), (None, "low", 0.3)),
        ((None, "small"),),
        {"consistency_score": (1 / 2, 15), "overall_quality": (1 / 6, 5)},
        0.9, 0.5, (None, 0.1, 0.1),
        "Use one type in {c}",
        ("Decide which type {c} should have", "Convert the values that differ",
         "Declare the type in the schema"),
        ("schema checks", "type conversion"),
        "remediate.cast_or_null(df, '{c}', 'double')",
    ),
    Rule(
        "value_ranges", "consistency", 0.3, 2, ((None, "medium", 0.6),),
        ((None, "moderate"),),
        {"consistency_score": (30, 15), "accuracy_score": (20, 10), "overall_quality": (15, 8)},
        0.8, 0.6, (None, 0.2, 0.2),
        "Agree on a value range for {c}",
        ("Write down the plausible range of {c}", "Check the range on entry",
         "Review the values outside it"),
        ("range checks", "rule engine"),
        "remediate.outside_range(df, '{c}', low, high)", 100,
    ),
    Rule(
        "outliers", "accuracy", 5, 3,
        ((20, "critical", 0.9), (10, "high", 0.7), (None, "medium", 0.5)),
        ((None, "moderate"),),
        {"accuracy_score": (1, 15), "overall_quality": (1 / 3, 5)},
        0.8, 0.7, (15, 0.3, 0.1),
        "Review the extreme values of {c}",
        ("Compare extreme values of {c} with their source", "Add plausibility rules",
         "Decide how analyses treat extremes"),
        ("statistics", "plausibility rules"),
        "remediate.zscore_outliers(df, '{c}')",
    ),
    Rule(
        "duplicates", "uniqueness", 1, None,
        ((10, "critical", 0.9), (5, "high", 0.8), (None, "medium", 0.6)),
        ((None, "small"),),
        {"uniqueness_score": (2, 20), "overall_quality": (1, 10)},
        0.9, 0.5, (5, 0.2, 0.1),
        "Remove duplicate rows",
        ("Drop rows that repeat another", "Find the load step that repeats them",
         "Declare a key"),
        ("deduplication", "unique constraints"),
        "remediate.drop_duplicates(df)",
    ),
    Rule(
        "duplicate_keys", "uniqueness", 0, None, ((None, "critical", 0.9),),
        ((None, "moderate"),),
        {"uniqueness_score": (5, 25), "consistency_score": (2, 10), "overall_quality": (3, 15)},
        0.9, 0.7, (None, 0.5, 0.5),
        "Make the key {c} unique",
        ("List the rows that share a value of {c}", "Correct them",
         "Put a unique constraint on {c}"),
        ("unique constraints", "load checks"),
        "remediate.duplicates_by_key(df, ['{c}'])",
    ),
    Rule(
        "outdated_records", "timeliness", 5, None,
        ((30, "critical", 0.9), (15, "high", 0.7), (None, "medium", 0.5)),
        ((None, "moderate"),),
        {"timeliness_score": (1, 20), "overall_quality": (1 / 3, 8)},
        0.7, 0.8, (20, 0.4, 0.2),
        "Refresh outdated rows",
        ("Reload the outdated rows", "Watch the age of the data", "Agree how often it is renewed"),
        ("scheduled loads", "freshness checks"),
        "remediate.outdated(df, date_column, days=365)  # for each date column",
    ),
    Rule(
        "missing_time_values", "timeliness", 10, None,
        ((25, "high", 0.6), (None, "medium", 0.6)),
        ((None, "small"),),
        {"timeliness_score": (1 / 2, 15), "completeness_score": (1 / 4, 7),
         "overall_quality": (1 / 5, 5)},
        0.8, 0.6, (None, 0.2, 0.2),
        "Complete the dates in {c}",
        ("Trace where dates of {c} are lost", "Check dates on entry",
         "Carry the last date forward where that is right"),
        ("date checks", "forward fill"),
        "remediate.forward_fill(df, '{c}', order_by=[...])",
    ),
    Rule(
        "format_violations", "validity", 5, None,
        ((25, "critical", 0.8), (15, "high", 0.7), (None, "medium", 0.5)),
        ((None, "moderate"),),
        {"validity_score": (1, 20), "overall_quality": (1 / 4, 6)},
        0.9, 0.5, (None, 0.2, 0.2),
        "Correct the format of {c}",
        ("Check the format of {c} on entry", "Unify how values are written",
         "Correct the values that do not fit"),
        ("pattern checks", "standardisation"),
        "remediate.not_matching(df, '{c}', pattern)",
    ),
    Rule(
        "business_rules", "validity", 0, None,
        ((10, "critical", 0.9), (5, "high", 0.8), (None, "medium", 0.6)),
        ((10, "moderate"), (None, "large")),
        {"validity_score": (2, 25), "consistency_score": (1, 10), "overall_quality": (1.5, 15)},
        0.8, 0.8, (5, 0.5, 0.3),
        "Restore the rule {c}",
        ("Correct the rows that break the rule", "Check the rule during loads",
         "Explain the rule where data is entered"),
        ("rule engine", "load checks"),
        "validity.business_rules(df, {{'{c}': ...}})",
    ),
)

# The user's rules come after the columns of a table.
_AFTER_COLUMNS = 1_000_000
_POSITION = {rule.name: i for i, rule in enumerate(RULES)}


def signals(result: Assessment) -> DataFrame:
    """Percentage per table, column and rule, as far as the assessment knows it.

    Rules about a whole table have no column.
    """
    columns, tables = result.columns, result.tables
    parts = []

    def add(name: str, source: DataFrame, condition, value: Column, subject: Column, ordinal: Column):
        parts.append(
            source.where(condition).select(
                "table_position", "table", F.lit(name).alias("rule"),
                ordinal.alias("ordinal"), subject.alias("column"), value.cast("double").alias(P),
            )
        )

    column, ordinal = F.col("column"), F.col("ordinal")
    whole, none = F.lit(None).cast("string"), F.lit(0)
    has = set(columns.columns)
    if "completeness_percentage" in has:
        lacking = 100 - F.col("completeness_percentage")
        add("missing_values", columns, F.lit(True), lacking, column, ordinal)
        if "is_date" in has:
            add("missing_time_values", columns, F.col("is_date"), lacking, column, ordinal)
    if "consistency_percentage" in has:
        add("type_consistency", columns, F.lit(True), 100 - F.col("consistency_percentage"), column, ordinal)
    if "iqr_outlier_percentage" in has:
        share = F.col("iqr_outlier_percentage") / 100
        add("value_ranges", columns, share.isNotNull(), share, column, ordinal)
    if "z_outlier_percentage" in has:
        share = F.col("z_outlier_percentage")
        add("outliers", columns, share.isNotNull(), share, column, ordinal)
    if "uniqueness_percentage" in tables.columns:
        add("duplicates", tables, F.lit(True), 100 - F.col("uniqueness_percentage"), whole, none)
    if "high_cardinality" in has:
        repeated = 100 * (1 - F.col("uniqueness_ratio"))
        add("duplicate_keys", columns, F.col("high_cardinality"), repeated, column, ordinal)
    if "outdated_percentage" in has:
        dated = columns.where("is_date").groupBy("table_position", "table").agg(
            F.sum("outdated_dates").alias("old"), F.sum("valid_dates").alias("valid")
        )
        share = F.coalesce(100.0 * F.col("old") / F.nullif(F.col("valid"), F.lit(0)), F.lit(0.0))
        add("outdated_records", dated, F.lit(True), share, whole, none)
    if "validity_percentage" in has:
        broken = 100 - F.col("validity_percentage")
        is_format, is_range = F.col("check_steps") == "format", F.col("check_steps") == "range"
        known = F.col("validity_percentage").isNotNull()
        add("format_violations", columns, known & is_format, broken, column, ordinal)
        add("business_rules", columns, known & is_range, broken, column, ordinal)
        rules = result.rules.join(tables.select("table", "table_position"), "table")
        after_columns = F.col("position") + _AFTER_COLUMNS
        add("business_rules", rules, F.lit(True), F.col("violation_percentage"), F.col("rule"), after_columns)
    return reduce(DataFrame.unionByName, parts)


def _first_above(steps: tuple, pick: int) -> Column:
    chosen = None
    for step in steps:
        limit, value = step[0], F.lit(step[pick])
        if limit is None:
            return value if chosen is None else chosen.otherwise(value)
        chosen = (F if chosen is None else chosen).when(F.col(P) > limit, value)
    return chosen


def _effort(steps: tuple) -> Column:
    chosen = None
    for limit, label in steps:
        if limit is None:
            return F.lit(label) if chosen is None else chosen.otherwise(label)
        chosen = (F if chosen is None else chosen).when(F.col(P) < limit, label)
    return chosen


def _filled(template: str) -> Column:
    parts = template.replace("{{", "{").replace("}}", "}").split("{c}")
    if len(parts) == 1:
        return F.lit(parts[0])
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [F.coalesce(F.col("column"), F.lit("")), F.lit(part)]
    return F.concat(*pieces)


def _gains(rule: Rule) -> Column:
    entries = []
    for metric, (factor, cap) in rule.gains.items():
        gain = F.bround(F.least(F.col(P) * F.lit(float(factor)), F.lit(float(cap))), 1)
        entries += [F.lit(metric), gain]
    return F.create_map(*entries)


def insights(found: DataFrame) -> DataFrame:
    """One row per signal that fires, with priority, effort, gains and audience."""
    worst_first = Window.partitionBy("table", "rule").orderBy(F.desc(P), "ordinal")
    placed = settled(found.withColumn("worst", F.row_number().over(worst_first)))
    parts = []
    for rule in RULES:
        above, then, otherwise = rule.executive
        executive = F.lit(otherwise) if above is None else F.when(F.col(P) > above, then).otherwise(otherwise)
        part = placed.where((F.col("rule") == rule.name) & (F.col(P) > rule.fires_above))
        if rule.keep is None:
            part = part.withColumn("place", F.col("ordinal"))
        else:
            part = part.withColumn("place", F.col("worst")).where(F.col("worst") <= rule.keep)
        parts.append(
            part.select(
                "table_position",
                F.lit(_POSITION[rule.name]).alias("rule_position"),
                "place",
                "table",
                "column",
                "rule",
                F.lit(rule.dimension).alias("dimension"),
                F.col(P),
                _filled(rule.title).alias("title"),
                F.format_string(
                    "%.1f%% (%s)", F.col(P) * rule.scale, F.lit(rule.name.replace("_", " "))
                ).alias("description"),
                F.array(*[_filled(a) for a in rule.actions]).alias("actions"),
                F.struct(
                    _filled(rule.example).alias("code_example"),
                    _effort(rule.efforts).alias("effort"),
                    F.array(*[F.lit(t) for t in rule.tools]).alias("tools"),
                ).alias("implementation"),
                _first_above(rule.priorities, 1).alias("priority"),
                _first_above(rule.priorities, 2).cast("double").alias("business_impact"),
                _gains(rule).alias("improved_metrics"),
                F.create_map(
                    F.lit("data_team"), F.lit(rule.data_team),
                    F.lit("business_users"), F.lit(rule.business_users),
                    F.lit("executive"), executive,
                ).alias("roles"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _weights(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def prioritized(found: DataFrame, focus: str | None = None) -> DataFrame:
    """Insights with their rank; ``focus`` puts one dimension first."""
    weights = fixed.RANK_WEIGHTS_FOCUSED if focus else fixed.RANK_WEIGHTS
    dimensions = dict(fixed.DIMENSION_WEIGHTS)
    if focus in dimensions:
        dimensions[focus] = 1.0
    score = (
        F.lit(weights["impact"]) * F.col("business_impact")
        + F.lit(weights["effort"]) * _weights(fixed.EFFORT_WEIGHTS)[F.col("implementation.effort")]
        + F.lit(weights["dimension"]) * _weights(dimensions)[F.col("dimension")]
    )
    order = Window.orderBy(
        F.desc("priority_score"), "table_position", "rule_position", "place"
    )
    return settled(
        found.withColumn("priority_score", F.round(score, 10)).withColumn(
            "rank", F.row_number().over(order)
        )
    )


def top_recommendations(ranked: DataFrame, rows: int = 5) -> DataFrame:
    return ranked.orderBy("rank").limit(rows)


def insights_by_role(ranked: DataFrame) -> DataFrame:
    """Who should see which insight, in the order of the ranking."""
    parts = [
        ranked.where(F.col("roles")[role] > above)
        .orderBy("rank")
        .limit(length)
        .select(F.lit(role).alias("role"), "*")
        for role, (above, length) in fixed.ROLE_VIEWS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def with_stakeholders(ranked: DataFrame) -> DataFrame:
    chosen = [
        F.when(F.col("roles")[role] > limit, F.lit(role))
        for role, limit in fixed.STAKEHOLDER_LIMITS.items()
    ]
    return ranked.withColumn("stakeholders", F.array_compact(F.array(*chosen)))


def with_phase(ranked: DataFrame) -> DataFrame:
    """When to act, by effort, and the gain to expect (10 at most)."""
    effort = F.col("implementation.effort")
    phase = (
        F.when(effort.isin("trivial", "small"), "quick_wins")
        .when(effort == "moderate", "medium_term")
        .otherwise("long_term")
    )
    gain = F.least(F.col("improved_metrics")["overall_quality"], F.lit(10.0))
    return ranked.withColumn("phase", phase).withColumn("phase_gain", gain)


def improvements(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """Current score, expected gain and projected score per dimension."""
    gains = ranked.select(F.explode("improved_metrics").alias("metric", "gain"))
    is_overall = F.col("metric") == "overall_quality"
    share = F.when(is_overall, fixed.OVERALL_GAIN_SHARE).otherwise(fixed.DIMENSION_GAIN_SHARE)
    summed = (
        gains.select(
            F.when(is_overall, "overall")
            .otherwise(F.regexp_replace("metric", "_score$", ""))
            .alias("dimension"),
            (F.col("gain") * share).alias("gain"),
        )
        .groupBy("dimension")
        .agg(F.sum("gain").alias("gain"))
    )
    current, gain = F.col("score"), F.coalesce("gain", F.lit(0.0))
    projected = F.least(F.lit(100.0), current + F.least(100.0 - current, gain))
    return scores.join(summed, "dimension", "full").select(
        "dimension", current.alias("current"), gain.alias("gain"), projected.alias("projected")
    )


def top_gains(improved: DataFrame, rows: int = 3) -> DataFrame:
    """Dimensions that gain most."""
    return (
        improved.where("dimension <> 'overall' AND gain > 0")
        .orderBy(F.desc("gain"), "dimension")
        .limit(rows)
        .select("dimension", "gain")
    )


def insight_text(ranked: DataFrame) -> DataFrame:
    """Each insight as a short text."""
    steps = F.array_join(
        F.transform("actions", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)), "\n"
    )
    gains = F.array_join(
        F.transform(
            F.map_entries("improved_metrics"),
            lambda e: F.format_string("%s +%.1f%%", e["key"], e["value"]),
        ),
        ", ",
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.col("title"), F.lit(" ["), F.col("priority"), F.lit("]")),
        "description",
        steps,
        F.concat(F.lit("Effort: "), F.col("implementation.effort")),
        F.concat(F.lit("Tools: "), F.array_join("implementation.tools", ", ")),
        F.concat(F.lit("Example: "), F.col("implementation.code_example")),
        F.concat(F.lit("Gain: "), gains),
    )
    return ranked.select("rank", "table", "title", text.alias("text"))


def executive_summary(ranked: DataFrame, improved: DataFrame) -> DataFrame:
    """The findings on one page: numbered lines of text."""
    top = ranked.where(F.col("rank") <= 3).select(
        F.lit(1).alias("section"),
        F.col("rank").alias("line"),
        F.concat(
            F.col("title"), F.lit(" ["), F.col("priority"), F.lit("]: "),
            F.array_join(F.slice("actions", 1, 2), "; "),
        ).alias("text"),
    )
    gain = improved.where("dimension = 'overall'").select(
        F.lit(2), F.lit(1), F.format_string("Overall quality can rise by %.1f points", "gain")
    )
    dimension_gain = F.row_number().over(Window.orderBy(F.desc("gain"), "dimension"))
    gains = top_gains(improved).select(
        F.lit(3), dimension_gain, F.format_string("%s: +%.1f points", "dimension", "gain")
    )
    phased = with_phase(ranked)
    place = F.row_number().over(Window.partitionBy("phase").orderBy("rank"))
    phases = phased.withColumn("place", place)
    quick = phases.where("phase = 'quick_wins' AND place <= 3").select(
        F.lit(4), "place", F.format_string("Soon: %s (+%.1f points)", "title", "phase_gain")
    )
    later = phases.where("phase = 'medium_term' AND place <= 2").select(
        F.lit(5), "place", F.concat(F.lit("Next: "), F.col("title"))
    )
    return reduce(DataFrame.union, [top, gain, gains, quick, later])
