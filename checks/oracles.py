"""SQL counterparts of the registered queries, for DuckDB.

Written from the definitions of the measures, without using the package.
"""

from __future__ import annotations

from checks.inputs import AS_OF, TABLES, columns_of, duckdb_input

DIGITS = 5
ASSESSED = ("dirty_lineitem", "text_orders", "mixed_events", "contacts", "spoiled")
DESCRIBED = ("customer", "orders", "lineitem", "events", "documents", "embeddings", "conversations")
RULES = {
    "small_discount": "l_discount <= 0.08",
    "low_tax": "l_tax < 0.08",
    "known_quantity": "l_quantity >= 5",
}
DATE_LIKE = r"^([0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}|[0-9]{2,4}[-/][0-9]{2}|[0-9]{8}|[0-9]{6})$"
CHECKS = {
    "email": ("email", "format", r"regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$')"),
    "phone": ("phone", "format", r"regexp_matches({c}, '^\+?[0-9\s\(\)-]{{7,20}}$')"),
    "zip_code": ("postal", "format", r"regexp_matches({c}, '^[0-9]{{4,5}}(-[0-9]{{4}})?$')"),
    "url": ("url", "format", r"regexp_matches({c}, '^(http|https)://[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}(/.*)?$')"),
    "page_id": ("numeric_range", "range", "{c} BETWEEN 0 AND 120"),
    "disc_pct": ("percentage", "range", "{c} BETWEEN 0 AND 100"),
}
STEPS = {
    "completeness": (95, 98, 99.5),
    "outliers": (95, 98, 99),
    "style": (70, 85, 95),
    "uniqueness": (95, 98, 99.5),
    "format": (90, 95, 99),
    "range": (95, 98, 99.5),
}
DIMENSIONS = ("completeness", "consistency", "accuracy", "uniqueness", "timeliness", "validity")


def steps(value: str, kind: str) -> str:
    g, e, x = STEPS[kind]
    return (
        f"CASE WHEN ({value}) IS NULL THEN NULL WHEN ({value}) >= {x} THEN 100e0"
        f" WHEN ({value}) >= {e} THEN 90e0 WHEN ({value}) >= {g} THEN 75e0"
        f" WHEN ({value}) >= {g}*0.8e0 THEN 60e0 WHEN ({value}) >= {g}*0.6e0 THEN 40e0 ELSE 20e0 END"
    )


def sources(*names: str, more: str = "") -> str:
    parts = [f"{n} AS ({duckdb_input(n)})" for n in names if n not in TABLES]
    if more:
        parts.append(more)
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


def rounded(sql: str, columns: str) -> str:
    """Round the named columns of a query, as the other side does."""
    replaced = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in columns.split())
    return f"SELECT * REPLACE ({replaced}) FROM (\n{sql}\n)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL BY NAME\n".join(f"SELECT * FROM ({p})" for p in parts)


def per_column(names, kinds: str, select) -> str:
    """UNION of one SELECT per column of each input, under the input's name."""
    parts = []
    for name in names:
        for i, c, k in columns_of(name, kinds):
            body = select(name, i, c, k)
            parts.append(f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", * FROM ({body})")
    return sources(*names) + union(parts)


def per_table(names, select) -> str:
    return sources(*names) + union(
        [f"SELECT '{n}' AS \"table\", * FROM ({select(n)})" for n in names]
    )


def pct(part: str, whole: str, empty: str = "NULL") -> str:
    return f"coalesce(100e0 * ({part}) / nullif(({whole})::DOUBLE, 0), {empty})"


# --- measures of one column -------------------------------------------------

TYPE_CLASS = (
    "CASE WHEN {c} IS NULL THEN NULL"
    " WHEN regexp_matches({c}, '^(?i:true|false)$') THEN 'boolean'"
    " WHEN regexp_matches({c}, '^[+-]?[0-9]+$') THEN 'integer'"
    r" WHEN regexp_matches({c}, '^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float'"
    " WHEN regexp_matches({c}, '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}})$') THEN 'date'"
    " ELSE 'text' END"
)


def completeness(name, i=None, c=None, k=None) -> str:
    return f"""
SELECT row_count, missing_count, completeness_percentage,
       {steps('completeness_percentage', 'completeness')} AS completeness_score
FROM (SELECT count(*) AS row_count, count(*) - count({c}) AS missing_count,
             coalesce(100e0 * (1 - (count(*) - count({c})) / nullif(count(*), 0)::DOUBLE), 100e0) AS completeness_percentage
      FROM {name})"""


def types(name, i, c, k) -> str:
    if k != "T":
        return """SELECT 'one' AS types_found, false AS mixed_types, 100e0 AS type_score,
                         100e0 AS consistency_percentage"""
    return f"""
SELECT CASE WHEN k > 1 THEN found ELSE 'one' END AS types_found, k > 1 AS mixed_types,
       CASE WHEN k <= 1 THEN 100e0 ELSE 100e0 - (k - 1) * 20e0 END AS type_score,
       coalesce(100e0 * top / total, 100e0) AS consistency_percentage
FROM (SELECT count(*) AS k, string_agg(cls, ',' ORDER BY cls) AS found, max(n)::DOUBLE AS top, sum(n)::DOUBLE AS total
      FROM (SELECT {TYPE_CLASS.format(c=c)} AS cls, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY 1))"""


def numbers(name, i, c, k) -> str:
    """Range, quartiles and both outlier counts of a numeric column."""
    return f"""
SELECT a.*, (SELECT count(*) FROM {name}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS lo, quantile_cont({c}::DOUBLE, 0.75) AS hi FROM {name}) f
             WHERE {c} < lo - 1.5e0 * (hi - lo) OR {c} > hi + 1.5e0 * (hi - lo)) AS iqr_outlier_count,
       (SELECT count(*) FROM {name}, (SELECT avg({c}::DOUBLE) AS m, stddev_samp({c}::DOUBLE) AS s FROM {name}) f
        WHERE abs(({c} - m) / nullif(s, 0)) > 3) AS z_outlier_count
FROM (SELECT count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}::DOUBLE) AS mean,
             quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median,
             quantile_cont({c}::DOUBLE, 0.75) AS q3, coalesce(stddev_samp({c}::DOUBLE), 0e0) AS std FROM {name}) a"""


def numeric_scores(name, i, c, k) -> str:
    inner = f"""
SELECT *, {pct('iqr_outlier_count', 'n', '0e0')} AS iqr_outlier_percentage,
       {pct('z_outlier_count', 'n')} AS z_outlier_percentage FROM ({numbers(name, i, c, k)})"""
    return f"""
SELECT *, {steps('100e0 - iqr_outlier_percentage', 'outliers')} AS value_score,
       {steps('100e0 - z_outlier_percentage', 'outliers')} AS numeric_accuracy_score FROM ({inner})"""


LETTER = r"[\p{Lu}\p{Ll}\p{Lt}]"


def style(name, i, c, k) -> str:
    title = (
        f"regexp_matches({c}, '{LETTER}') AND NOT regexp_matches({c}, '(^|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}])\\p{{Ll}}')"
        f" AND NOT regexp_matches({c}, '{LETTER}[\\p{{Lu}}\\p{{Lt}}]')"
    )
    return f"""
SELECT lower_count, upper_count, title_count, style_percentage,
       {steps('style_percentage', 'style')} AS text_accuracy_score
FROM (SELECT *, {pct('greatest(lower_count, upper_count, title_count)', 'n')} AS style_percentage
      FROM (SELECT count({c}) AS n,
                   count(*) FILTER (lower({c}) = {c} AND upper({c}) <> {c}) AS lower_count,
                   count(*) FILTER (upper({c}) = {c} AND lower({c}) <> {c}) AS upper_count,
                   count(*) FILTER ({title}) AS title_count FROM {name}))"""


def skew(name, i, c, k) -> str:
    return f"SELECT skewness({c}::DOUBLE) AS skewness FROM {name} HAVING count({c}) >= 30"


def distinct(name, i, c, k) -> str:
    return f"""
SELECT unique_values, total_values, unique_values::DOUBLE / nullif(total_values, 0) AS uniqueness_ratio,
       unique_values = total_values AS is_unique
FROM (SELECT count(DISTINCT {c}) AS unique_values, count({c}) AS total_values FROM {name})
WHERE total_values > 0"""


def days(later: str, earlier: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000e0)::BIGINT"


def date_expr(c: str, k: str) -> str:
    return c if k == "D" else f"try_strptime({c}, '%Y-%m-%d')"


KIND = (
    "CASE WHEN {0} IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'Numeric' WHEN {0} = 'DATE' OR {0} LIKE 'TIMESTAMP%'"
    " THEN 'DateTime' WHEN {0} = 'BOOLEAN' THEN 'Boolean' WHEN {0} = 'VARCHAR' THEN 'Text' ELSE 'Other' END"
)


def running_quality(name, i, c, k) -> str:
    number = k in "IN"
    spread = ", ".join(
        f"{f'{f}({c}::DOUBLE)' if number else 'max(NULL::DOUBLE)'} AS {a}"
        for f, a in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std"), ("skewness", "skewness"))
    )
    return f"""
SELECT row_count, missing_count, completeness_percentage, completeness_score, mixed_types, type_score,
       consistency_percentage, min, max, mean, std, skewness
FROM ({completeness(name, i, c, k)}), ({types(name, i, c, k)}), (SELECT {spread} FROM {name})"""


def column_flags(name, i, c, k) -> str:
    likely = f"coalesce(avg(regexp_matches({c}, '{DATE_LIKE}')::INT) > 0.7, false)" if k == "T" else "false"
    return f"""
SELECT {i}::INT AS ordinal, CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE t END AS dtype, {KIND.format('t')} AS kind,
       {c in ('order_date', 'email', 'value', 'l_tax')} AS is_selected, {KIND.format('t')} = 'Numeric' AS is_numeric,
       {KIND.format('t')} = 'DateTime' AS is_datetime, false AS is_categorical, likely_date
FROM (SELECT any_value(typeof({c})) AS t, {likely} AS likely_date FROM {name})"""


AGE_SCORE = (
    "CASE WHEN r IS NULL THEN 0e0 WHEN r > 365 THEN greatest(0e0, 100e0 - (r - 365) / 10e0)"
    " WHEN r > 180 THEN greatest(70e0, 100e0 - (r - 180) / 4e0)"
    " WHEN r > 30 THEN greatest(85e0, 100e0 - (r - 30) / 5e0) ELSE 100e0 END"
)
AGE_CATEGORY = (
    "CASE WHEN r IS NULL THEN 'Invalid Dates' WHEN r <= 30 THEN 'Current' WHEN r <= 180 THEN 'Recent'"
    " WHEN r <= 365 THEN 'Outdated' ELSE 'Obsolete' END"
)


def dates(name, i, c, k) -> str:
    """One row for a date column (declared, or mostly date-like text), else none."""
    chosen = "count(*) >= 0" if k == "D" else f"avg(regexp_matches({c}, '{DATE_LIKE}')::INT) > 0.7"
    now = f"TIMESTAMP '{AS_OF}'"
    return f"""
SELECT strftime(lo, '%Y-%m-%d') AS min_date, strftime(hi, '%Y-%m-%d') AS max_date,
       CASE WHEN hi > lo THEN {days('hi', 'lo')} ELSE 0 END AS time_span_days,
       r AS recency_days, {AGE_SCORE} AS timeliness_score, {AGE_CATEGORY} AS timeliness_category, valid, old
FROM (SELECT *, {days(now, 'hi')} AS r
      FROM (SELECT min(d) AS lo, max(d) AS hi, count(d) AS valid,
                   count(*) FILTER ({days(now, 'd')} > 365) AS old
            FROM (SELECT {date_expr(c, k)}::TIMESTAMP AS d FROM {name})
            HAVING (SELECT coalesce({chosen}, false) FROM {name})))"""


def checks(name, i, c, k) -> str:
    kind, group, condition = CHECKS[c]
    return f"""
SELECT '{kind}' AS check_type, '{group}' AS check_steps, valid_count, validity_percentage,
       {steps('validity_percentage', group)} AS validity_score,
       CASE WHEN validity_percentage >= 95 THEN 'Valid' WHEN validity_percentage >= 80 THEN 'Mostly Valid' ELSE 'Invalid' END AS status
FROM (SELECT count(*) FILTER ({condition.format(c=c)}) AS valid_count,
             100e0 * count(*) FILTER ({condition.format(c=c)}) / count({c}) AS validity_percentage
      FROM {name} HAVING count({c}) > 0)"""


def checked(names, group: str) -> str:
    parts = []
    for name in names:
        for i, c, k in columns_of(name):
            if c in CHECKS:
                parts.append(
                    f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", * EXCLUDE (check_steps) FROM ({checks(name, i, c, k)})"
                )
    return sources(*names) + union(parts)


def duplicates(name: str, columns: str | None = None) -> str:
    names = columns or ", ".join(c for _, c, _ in columns_of(name))
    return f"""
SELECT total_rows, duplicate_rows, uniqueness_percentage,
       {steps('uniqueness_percentage', 'uniqueness')} AS uniqueness_score
FROM (SELECT sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS duplicate_rows,
             100e0 * (1 - sum(n - 1)::DOUBLE / nullif(sum(n), 0)) AS uniqueness_percentage
      FROM (SELECT count(*) AS n FROM {name} GROUP BY {names}))"""


# --- histograms ---------------------------------------------------------------


def bins(name: str, c: str, k: str, fixed: int | None = None) -> str:
    """Bin layout and the bin of each value of a numeric column."""
    width = "least(greatest(2e0 * (q3 - q1) / pow(n, 1e0 / 3e0), (hi - lo) / sqrt(n) / 2e0), (hi - lo) / (log2(n) + 1e0))"
    if k == "I":
        width = f"greatest({width}, 1e0)"
    number = f"{fixed}" if fixed else f"CASE WHEN hi = lo THEN 1 ELSE greatest(1, ceil((hi - lo) / {width}))::INT END"
    edge = "CASE WHEN {b} >= b THEN h ELSE ({b}) * step + l END"
    return f"""
SELECT x, l, h, step, b, g - (x < {edge.format(b='g')})::INT + (x >= {edge.format(b='(g + 1)')} AND g <> b - 1)::INT AS bin
FROM (SELECT x, l, h, b, step, least(floor((x - l) / (h - l) * b::DOUBLE)::INT, b - 1) AS g
      FROM (SELECT {c}::DOUBLE AS x FROM {name} WHERE {c} IS NOT NULL),
           (SELECT *, (h - l) / b AS step
            FROM (SELECT CASE WHEN hi = lo THEN lo - 0.5e0 ELSE lo END AS l, CASE WHEN hi = lo THEN hi + 0.5e0 ELSE hi END AS h, {number} AS b
                  FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count({c})::DOUBLE AS n,
                               quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {name}))))"""


def histogram(name, i, c, k, fixed=None) -> str:
    layout = bins(name, c, k, fixed)
    return f"""
SELECT bin, CASE WHEN bin >= b THEN h ELSE bin * step + l END AS bin_start,
       CASE WHEN bin + 1 >= b THEN h ELSE (bin + 1) * step + l END AS bin_end, coalesce(n, 0) AS count
FROM (SELECT DISTINCT l, h, step, b, unnest(range(b))::INT AS bin FROM (SELECT any_value(l) AS l, any_value(h) AS h, any_value(step) AS step, any_value(b) AS b FROM ({layout})))
LEFT JOIN (SELECT bin, count(*) AS n FROM ({layout}) GROUP BY bin) USING (bin)"""


def peaks(name, i, c, k) -> str:
    return f"""
SELECT count(*) FILTER (n > before AND n > after) AS potential_modes
FROM (SELECT bin, count AS n, lag(count) OVER (ORDER BY bin) AS before, lead(count) OVER (ORDER BY bin) AS after
      FROM ({histogram(name, i, c, k)}))"""


def distribution(name, i, c, k) -> str:
    return f"""
SELECT *, CASE WHEN abs(skewness) < 1 AND potential_modes <= 2 THEN 'Good'
               WHEN abs(skewness) < 2 AND potential_modes <= 3 THEN 'Fair' ELSE 'Poor' END AS distribution_quality
FROM ({skew(name, i, c, k)}), ({peaks(name, i, c, k)})"""


# --- overall scores per table ---------------------------------------------------


def consistency_overall(name: str) -> str:
    type_scores = " UNION ALL ".join(
        f"SELECT type_score AS s FROM ({types(name, i, c, k)})" for i, c, k in columns_of(name)
    )
    value_scores = " UNION ALL ".join(
        f"SELECT value_score AS s FROM ({numeric_scores(name, i, c, k)})" for i, c, k in columns_of(name, "IN")
    )
    return _averages(type_scores, value_scores, "type_consistency_score", "value_consistency_score", "consistency_score")


def accuracy_overall(name: str) -> str:
    numeric = " UNION ALL ".join(
        f"SELECT numeric_accuracy_score AS s FROM ({numeric_scores(name, i, c, k)})" for i, c, k in columns_of(name, "IN")
    )
    text = " UNION ALL ".join(
        f"SELECT text_accuracy_score AS s FROM ({style(name, i, c, k)})" for i, c, k in columns_of(name, "T")
    ) or "SELECT NULL::DOUBLE AS s"
    return _averages(numeric, text, "numeric_accuracy_score", "text_accuracy_score", "accuracy_score")


def _averages(first: str, second: str, a: str, b: str, both: str) -> str:
    return f"""
SELECT coalesce((SELECT avg(s) FROM ({first})), 100e0) AS {a}, coalesce((SELECT avg(s) FROM ({second})), 100e0) AS {b},
       coalesce((SELECT avg(s) FROM (({first}) UNION ALL ({second}))), 100e0) AS {both}"""


def completeness_overall(name: str) -> str:
    names = [c for _, c, _ in columns_of(name)]
    lacking = " + ".join(f"(count(*) - count({c}))" for c in names)
    return f"""
SELECT total_cells, missing_cells, completeness_percentage, {steps('completeness_percentage', 'completeness')} AS completeness_score
FROM (SELECT *, 100e0 * (1 - missing_cells / nullif(total_cells, 0)::DOUBLE) AS completeness_percentage
      FROM (SELECT count(*) * {len(names)} AS total_cells, {lacking} AS missing_cells FROM {name}))"""


def all_dates(name: str) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, * FROM ({dates(name, i, c, k)})"
        for i, c, k in columns_of(name, "TD")
    ]
    return union(parts)


def timeliness_overall(name: str) -> str:
    return f"""
SELECT count(*) AS date_columns_found, avg(timeliness_score) AS timeliness_score,
       CASE WHEN count(*) = 0 THEN 'No date columns' ELSE 'Assessed' END AS timeliness_message
FROM ({all_dates(name)})"""


def validity_overall(name: str) -> str:
    parts = [
        f"SELECT validity_score FROM ({checks(name, i, c, k)})" for i, c, k in columns_of(name) if c in CHECKS
    ] or ["SELECT NULL::DOUBLE AS validity_score WHERE false"]
    return f"SELECT count(*) AS checks_performed, coalesce(avg(validity_score), 100e0) AS validity_score FROM ({' UNION ALL '.join(parts)})"


# --- the assessment ---------------------------------------------------------------


def table_scores() -> str:
    """CTEs ``scores`` (table, position, dimension, score) for the assessed views."""
    parts = []
    for p, name in enumerate(ASSESSED):
        for dimension, sql, column in (
            ("completeness", completeness_overall(name), "completeness_score"),
            ("consistency", consistency_overall(name), "consistency_score"),
            ("accuracy", accuracy_overall(name), "accuracy_score"),
            ("uniqueness", duplicates(name), "uniqueness_score"),
            ("timeliness", timeliness_overall(name), "timeliness_score"),
            ("validity", validity_overall(name), "validity_score"),
        ):
            parts.append(
                f"SELECT '{name}' AS \"table\", {p} AS position, '{dimension}' AS dimension,"
                f" {DIMENSIONS.index(dimension)} AS place, {column}::DOUBLE AS score FROM ({sql})"
            )
    return f"scores AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE score IS NOT NULL)"


OVERALL = """overall AS (SELECT coalesce(dimension, 'overall') AS dimension, avg(score) AS score
FROM scores GROUP BY ROLLUP (dimension))"""


def with_scores(sql: str, overall: bool = True) -> str:
    return sources(*ASSESSED, more=table_scores() + (",\n" + OVERALL if overall else "")) + sql


def issues() -> str:
    parts = []
    for p, name in enumerate(ASSESSED):
        for i, c, k in columns_of(name):
            here = f"'{name}' AS \"table\", {p} AS position, {i} AS ordinal, '{c}' AS \"column\""
            parts.append(
                f"SELECT {here}, 0 AS rule, format('Missing data ({{:.1f}}%)', 100 - completeness_percentage) AS issue,"
                f" 'Incomplete Data' AS table_issue, 'Completeness' AS dimension, (100 - completeness_percentage) / 10 AS severity,"
                f" completeness_percentage AS score FROM ({completeness(name, i, c, k)}) WHERE completeness_percentage < 95"
            )
            if k == "T":
                parts.append(
                    f"SELECT {here}, 1 AS rule, 'Mixed data types' AS issue, 'Mixed Data Types' AS table_issue, 'Consistency' AS dimension,"
                    f" (100 - type_score) / 10 AS severity, type_score AS score FROM ({types(name, i, c, k)}) WHERE mixed_types"
                )
            if k in "IN":
                parts.append(
                    f"SELECT {here}, 2 AS rule, format('High outliers ({{:.1f}}%)', z_outlier_percentage) AS issue,"
                    f" 'High Outlier %' AS table_issue, 'Accuracy' AS dimension, z_outlier_percentage / 10 AS severity,"
                    f" numeric_accuracy_score AS score FROM ({numeric_scores(name, i, c, k)}) WHERE z_outlier_percentage > 5"
                )
    return " UNION ALL ".join(parts)


ADVICE = {
    "completeness": (90, 75, "High", "Medium"),
    "consistency": (90, 75, "High", "Medium"),
    "accuracy": (90, 75, "High", "Medium"),
    "uniqueness": (95, 85, "High", "Medium"),
    "timeliness": (85, 70, "Medium", "Low"),
    "validity": (90, 75, "High", "Medium"),
}


def advice() -> str:
    parts = [
        f"SELECT '{d.capitalize()}' AS dimension, CASE WHEN score < {urgent} THEN '{a}' ELSE '{b}' END AS priority"
        f" FROM overall WHERE dimension = '{d}' AND score < {limit}"
        for d, (limit, urgent, a, b) in ADVICE.items()
    ]
    return " UNION ALL ".join(parts)


ENDS = """
SELECT a.dimension AS strongest, a.score AS strongest_score, a.score >= 75 AS is_strength,
       z.dimension AS weakest, z.score AS weakest_score, z.score < 75 AS needs_improvement
FROM (SELECT * FROM ranked ORDER BY score DESC, place LIMIT 1) a, (SELECT * FROM ranked ORDER BY score, place LIMIT 1) z"""


def ranked_scores() -> str:
    places = " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(DIMENSIONS))
    return f"""ranked AS (SELECT dimension, least(100e0, greatest(0e0, score)) AS score, CASE dimension {places} END AS place
FROM overall WHERE dimension <> 'overall')"""


def context() -> str:
    missing = " + ".join(f"(SELECT missing_cells FROM ({completeness_overall(n)}))" for n in ASSESSED)
    return f"""
SELECT quality_score, CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 75 THEN 'good'
            WHEN quality_score >= 60 THEN 'moderate' ELSE 'poor' END AS quality_level,
       (SELECT dimension FROM ranked WHERE score < 100 ORDER BY score, place LIMIT 1) AS critical_dimension,
       ({missing})::BIGINT AS issue_count
FROM (SELECT round_even(score, 0) AS quality_score FROM overall WHERE dimension = 'overall')"""


# --- insights ------------------------------------------------------------------------


def signals() -> str:
    parts = []
    for p, name in enumerate(ASSESSED):
        whole = f"'{name}' AS \"table\", {p} AS position, 0 AS ordinal"
        for i, c, k in columns_of(name):
            here = f"'{name}' AS \"table\", {p} AS position, {i} AS ordinal, '{c}' AS \"column\""
            parts.append(f"SELECT {here}, 'missing_values' AS rule, 100 - completeness_percentage AS p FROM ({completeness(name, i, c, k)})")
            parts.append(f"SELECT {here}, 'type_consistency', 100 - consistency_percentage FROM ({types(name, i, c, k)})")
            if k in "IN":
                parts.append(f"SELECT {here}, 'value_ranges', iqr_outlier_percentage / 100 FROM ({numeric_scores(name, i, c, k)})")
                parts.append(f"SELECT {here}, 'outliers', z_outlier_percentage FROM ({numeric_scores(name, i, c, k)})")
            if k in "TD":
                parts.append(
                    f"SELECT {here}, 'missing_time_values', 100 - completeness_percentage FROM ({completeness(name, i, c, k)})"
                    f" WHERE EXISTS (SELECT 1 FROM ({dates(name, i, c, k)}))"
                )
            parts.append(
                f"SELECT {here}, 'duplicate_keys', 100 * (1 - uniqueness_ratio) FROM ({distinct(name, i, c, k)})"
                " WHERE uniqueness_ratio > 0.9 AND uniqueness_ratio < 1 AND total_values > 100"
            )
            if c in CHECKS:
                rule = "format_violations" if CHECKS[c][1] == "format" else "business_rules"
                parts.append(f"SELECT {here}, '{rule}', 100 - validity_percentage FROM ({checks(name, i, c, k)})")
        parts.append(f"SELECT {whole}, '' AS \"column\", 'duplicates', 100 - uniqueness_percentage FROM ({duplicates(name)})")
        parts.append(
            f"SELECT {whole}, '' AS \"column\", 'outdated_records', coalesce(100e0 * sum(old) / nullif(sum(valid), 0), 0e0)"
            f" FROM ({all_dates(name)}) HAVING count(*) > 0"
        )
        if name == "dirty_lineitem":
            for j, (rule, condition) in enumerate(RULES.items()):
                parts.append(
                    f"SELECT {whole.replace('0 AS ordinal', f'{1_000_000 + j} AS ordinal')}, '{rule}' AS \"column\", 'business_rules', {pct(f'count(*) FILTER (NOT ({condition}))', f'count({condition})', '0e0')} FROM {name}"
                )
    return " UNION ALL ".join(parts)


# rule: position, dimension, fires above, rows kept per table, effort, priority, impact,
# gains (overall and others), data team, business users, executive
INSIGHT_RULES = {
    "missing_values": (0, "completeness", 20, 3, "CASE WHEN p < 30 THEN 'small' ELSE 'moderate' END",
        "CASE WHEN p > 50 THEN 'critical' WHEN p > 30 THEN 'high' WHEN p > 15 THEN 'medium' ELSE 'low' END",
        "CASE WHEN p > 50 THEN 0.9 WHEN p > 30 THEN 0.7 WHEN p > 15 THEN 0.5 ELSE 0.3 END",
        {"completeness": "least(p / 2, 20)", "overall": "least(p / 5, 10)"}, 0.9, 0.7, "CASE WHEN p > 50 THEN 0.3 ELSE 0.1 END"),
    "type_consistency": (1, "consistency", 10, 3, "'small'",
        "CASE WHEN p > 30 THEN 'critical' WHEN p > 20 THEN 'high' WHEN p > 10 THEN 'medium' ELSE 'low' END",
        "CASE WHEN p > 30 THEN 0.9 WHEN p > 20 THEN 0.7 WHEN p > 10 THEN 0.5 ELSE 0.3 END",
        {"consistency": "least(p / 2, 15)", "overall": "least(p / 6, 5)"}, 0.9, 0.5, "0.1"),
    "value_ranges": (2, "consistency", 0.3, 2, "'moderate'", "'medium'", "0.6",
        {"consistency": "least(30 * p, 15)", "accuracy": "least(20 * p, 10)", "overall": "least(15 * p, 8)"}, 0.8, 0.6, "0.2"),
    "outliers": (3, "accuracy", 5, 3, "'moderate'",
        "CASE WHEN p > 20 THEN 'critical' WHEN p > 10 THEN 'high' ELSE 'medium' END",
        "CASE WHEN p > 20 THEN 0.9 WHEN p > 10 THEN 0.7 ELSE 0.5 END",
        {"accuracy": "least(p, 15)", "overall": "least(p / 3, 5)"}, 0.8, 0.7, "CASE WHEN p > 15 THEN 0.3 ELSE 0.1 END"),
    "duplicates": (4, "uniqueness", 1, None, "'small'",
        "CASE WHEN p > 10 THEN 'critical' WHEN p > 5 THEN 'high' ELSE 'medium' END",
        "CASE WHEN p > 10 THEN 0.9 WHEN p > 5 THEN 0.8 ELSE 0.6 END",
        {"uniqueness": "least(2 * p, 20)", "overall": "least(p, 10)"}, 0.9, 0.5, "CASE WHEN p > 5 THEN 0.2 ELSE 0.1 END"),
    "duplicate_keys": (5, "uniqueness", 0, None, "'moderate'", "'critical'", "0.9",
        {"uniqueness": "least(5 * p, 25)", "consistency": "least(2 * p, 10)", "overall": "least(3 * p, 15)"}, 0.9, 0.7, "0.5"),
    "outdated_records": (6, "timeliness", 5, None, "'moderate'",
        "CASE WHEN p > 30 THEN 'critical' WHEN p > 15 THEN 'high' ELSE 'medium' END",
        "CASE WHEN p > 30 THEN 0.9 WHEN p > 15 THEN 0.7 ELSE 0.5 END",
        {"timeliness": "least(p, 20)", "overall": "least(p / 3, 8)"}, 0.7, 0.8, "CASE WHEN p > 20 THEN 0.4 ELSE 0.2 END"),
    "missing_time_values": (7, "timeliness", 10, None, "'small'",
        "CASE WHEN p > 25 THEN 'high' ELSE 'medium' END", "0.6",
        {"timeliness": "least(p / 2, 15)", "completeness": "least(p / 4, 7)", "overall": "least(p / 5, 5)"}, 0.8, 0.6, "0.2"),
    "format_violations": (8, "validity", 5, None, "'moderate'",
        "CASE WHEN p > 25 THEN 'critical' WHEN p > 15 THEN 'high' ELSE 'medium' END",
        "CASE WHEN p > 25 THEN 0.8 WHEN p > 15 THEN 0.7 ELSE 0.5 END",
        {"validity": "least(p, 20)", "overall": "least(p / 4, 6)"}, 0.9, 0.5, "0.2"),
    "business_rules": (9, "validity", 0, None, "CASE WHEN p < 10 THEN 'moderate' ELSE 'large' END",
        "CASE WHEN p > 10 THEN 'critical' WHEN p > 5 THEN 'high' ELSE 'medium' END",
        "CASE WHEN p > 10 THEN 0.9 WHEN p > 5 THEN 0.8 ELSE 0.6 END",
        {"validity": "least(2 * p, 25)", "consistency": "least(p, 10)", "overall": "least(1.5 * p, 15)"}, 0.8, 0.8, "CASE WHEN p > 5 THEN 0.5 ELSE 0.3 END"),
}
EFFORT = "CASE effort WHEN 'trivial' THEN 1.0 WHEN 'small' THEN 0.8 WHEN 'moderate' THEN 0.5 ELSE 0.2 END"
WEIGHTS = {"completeness": 0.9, "accuracy": 0.85, "consistency": 0.8, "validity": 0.75, "uniqueness": 0.7, "timeliness": 0.65}


def with_insights(sql: str, focus: str | None = None, scores: bool = False) -> str:
    parts = []
    for rule, (pos, dimension, above, keep, effort, priority, impact, gains, team, users, executive) in INSIGHT_RULES.items():
        gain = ", ".join(
            f"{f'round_even({gains[d]}, 1)' if d in gains else 'NULL'}::DOUBLE AS gain_{d}" for d in ("overall", *DIMENSIONS)
        )
        place = "row_number() OVER (PARTITION BY position ORDER BY p DESC, ordinal)" if keep else "ordinal"
        parts.append(
            f"SELECT position, {pos} AS rule_position, place, \"table\", \"column\", rule, '{dimension}' AS dimension, p,"
            f" {effort} AS effort, {priority} AS priority, ({impact})::DOUBLE AS business_impact, {gain},"
            f" {team}::DOUBLE AS data_team, {users}::DOUBLE AS business_users, ({executive})::DOUBLE AS executive"
            f" FROM (SELECT *, {place} AS place FROM signals WHERE rule = '{rule}' AND p > {above}) WHERE place <= {keep or 10 ** 9}"
        )
    weights = dict(WEIGHTS)
    a, b, d = (0.6, 0.3, 0.1)
    if focus:
        weights[focus] = 1.0
        a, b, d = (0.5, 0.2, 0.3)
    by_dimension = "CASE dimension " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " END"
    score = f"round({a} * business_impact + {b}::DOUBLE * {EFFORT} + {d}::DOUBLE * {by_dimension}, 10)"
    more = f"signals AS MATERIALIZED ({signals()}),\nfound AS ({' UNION ALL '.join(parts)}),\n"
    more += f"""insights AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY priority_score DESC, position, rule_position, place))::INT AS rank
FROM (SELECT *, {score} AS priority_score FROM found))"""
    if scores:
        more = table_scores() + ",\n" + OVERALL + ",\n" + more
    return sources(*ASSESSED, more=more) + sql


INSIGHT_COLUMNS = (
    'rank, "table", "column", rule, dimension, p, priority, business_impact, effort,'
    " gain_overall AS overall_gain, executive, priority_score"
)

GAINS = "SELECT 'overall' AS dimension, sum(gain_overall) * 0.1e0 AS gain FROM insights UNION ALL " + " UNION ALL ".join(
    f"SELECT '{d}', sum(gain_{d}) * 0.2e0 FROM insights HAVING count(gain_{d}) > 0" for d in DIMENSIONS
)

# --- trend -----------------------------------------------------------------------------

SERIES = """months AS (SELECT last_day(o_orderdate) AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1),
series AS (SELECT last_day(m) AS month, (row_number() OVER (ORDER BY m) - 1)::INT AS idx, value
FROM (SELECT unnest(range(date_trunc('month', lo), hi + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m
      FROM (SELECT min(month) AS lo, max(month) AS hi FROM months))
LEFT JOIN months ON months.month = last_day(m)),
fit AS (SELECT regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept, max(idx) AS last_idx, max(month) AS last_month FROM series)"""

DECOMPOSED = """parts AS (SELECT *, CASE WHEN idx >= 6 AND idx <= (SELECT max(idx) FROM series) - 6 THEN
    (sum(value) OVER (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
     + (lag(value, 6) OVER (ORDER BY idx) + lead(value, 6) OVER (ORDER BY idx)) / 2) / 12 END AS trend FROM series),
phases AS (SELECT idx % 12 AS phase, avg(value - trend) AS effect FROM parts GROUP BY 1),
decomposed AS (SELECT month, idx, value, trend, effect - (SELECT avg(effect) FROM phases) AS seasonal,
    value - trend - (effect - (SELECT avg(effect) FROM phases)) AS residual
    FROM parts JOIN phases ON phase = idx % 12 WHERE (SELECT count(*) FROM series) >= 24),
pattern AS (SELECT month(month)::INT AS month_number, avg(seasonal) AS seasonality,
    (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month(month)] AS month_name
    FROM decomposed GROUP BY 1, 3)"""


def with_series(sql: str, decomposed: bool = False) -> str:
    return "WITH " + SERIES + (",\n" + DECOMPOSED if decomposed else "") + "\n" + sql


FORECAST = """SELECT last_day(last_month + (i * INTERVAL 1 MONTH)) AS month, (last_idx + i)::INT AS idx,
slope * (last_idx + i) + intercept AS value FROM fit, (SELECT unnest(range(1, {n} + 1)) AS i)"""

# --- relations ----------------------------------------------------------------------------


def dependency(name: str, columns: list[str]) -> str:
    parts = []
    for a in columns:
        for b in columns:
            if a != b:
                parts.append(f"""
SELECT '{name}' AS "table", '{a}' AS determinant, '{b}' AS dependent, 100e0 * count(*) FILTER (n = 1) / count(*) AS fd_score
FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM {name} WHERE {a} IS NOT NULL GROUP BY {a}) HAVING count(*) > 1""")
    return union(parts)


def with_strength(sql: str) -> str:
    return f"""SELECT *, CASE WHEN fd_score >= 95 THEN 'Strong' WHEN fd_score >= 70 THEN 'Moderate' ELSE 'Weak' END AS fd_strength,
fd_score = 100 AS is_key FROM ({sql})"""


def together(a: str, b: str) -> str:
    return f"""
SELECT '{a}' AS column_1, '{b}' AS column_2, both_missing, missing_1, missing_2,
       {pct('both_missing', 'missing_1', '0e0')} AS second_missing_given_first, {pct('both_missing', 'missing_2', '0e0')} AS first_missing_given_second
FROM (SELECT count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS both_missing, count(*) - count({a}) AS missing_1, count(*) - count({b}) AS missing_2 FROM pairs)"""


COMPLETE = """SELECT total_rows, complete_rows, 100e0 * complete_rows / total_rows AS complete_rows_percentage
FROM (SELECT count(*) AS total_rows, count(*) FILTER ({condition}) AS complete_rows FROM pairs)"""

CONTINGENCY = """SELECT value_1, value_2, count(*) AS count, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share
FROM ({source}) WHERE value_1 IS NOT NULL AND value_2 IS NOT NULL GROUP BY 1, 2"""


def matrix() -> str:
    names = [c for _, c, _ in columns_of("dirty_lineitem", "IN")]
    return sources("dirty_lineitem") + " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS pearson FROM dirty_lineitem" for a in names for b in names
    )


# --- profiles ---------------------------------------------------------------------------------


def numeric_profile(name, i, c, k) -> str:
    return f"""
SELECT count({c}) AS count, count(*) - count({c}) AS missing, 100e0 * (count(*) - count({c})) / count(*) AS missing_percentage,
       avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
       stddev_samp({c}::DOUBLE) AS std, count(DISTINCT {c}) AS unique_values FROM {name}"""


def date_profile(name, i, c, k) -> str:
    return f"""
SELECT count({c}) AS count, count(*) - count({c}) AS missing, 100e0 * (count(*) - count({c})) / count(*) AS missing_percentage,
       strftime(date_trunc('second', min({c})), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(date_trunc('second', max({c})), '%Y-%m-%d %H:%M:%S') AS latest,
       {days(f'max({c})', f'min({c})')} AS range_days, count(DISTINCT {c}) AS unique_values FROM {name}"""


def text_profile(name, i, c, k) -> str:
    return f"""
SELECT (SELECT count({c}) FROM {name}) AS count, (SELECT count(*) - count({c}) FROM {name}) AS missing,
       (SELECT 100e0 * (count(*) - count({c})) / count(*) FROM {name}) AS missing_percentage,
       (SELECT count(DISTINCT {c}) FROM {name}) AS unique_values, {c} AS most_common, n AS most_common_count,
       100e0 * n / (SELECT count({c}) FROM {name}) AS most_common_percentage
FROM (SELECT {c}, count(*) AS n, CASE WHEN strlen({c}) < 64 THEN {c} ELSE sha256({c}) END AS key FROM {name} WHERE {c} IS NOT NULL
      GROUP BY {c} ORDER BY n DESC, key LIMIT 1)"""


def box(name, i, c, k) -> str:
    return f"""
SELECT a.min, (SELECT min({c})::DOUBLE FROM {name} WHERE {c} BETWEEN a.q1 - 1.5e0 * (a.q3 - a.q1) AND a.q3 + 1.5e0 * (a.q3 - a.q1)) AS whisker_low,
       a.q1, a.median, a.q3, (SELECT max({c})::DOUBLE FROM {name} WHERE {c} BETWEEN a.q1 - 1.5e0 * (a.q3 - a.q1) AND a.q3 + 1.5e0 * (a.q3 - a.q1)) AS whisker_high,
       a.max, a.iqr_outlier_count AS outliers FROM ({numbers(name, i, c, k)}) a"""


def overview(name: str) -> str:
    return f"""
SELECT total_rows, {len(columns_of(name))}::BIGINT AS total_columns, missing_cells, 100e0 * missing_cells / total_cells AS missing_percentage,
       duplicate_rows, 100e0 * duplicate_rows / total_rows AS duplicate_percentage
FROM ({duplicates(name)}), ({completeness_overall(name)})"""


def bands(value: str) -> str:
    return f"""CASE WHEN {value} >= 90 THEN 'Excellent' WHEN {value} >= 75 THEN 'Good' ELSE 'Needs Improvement' END AS three_bands,
CASE WHEN {value} >= 90 THEN 'Excellent' WHEN {value} >= 80 THEN 'Good' WHEN {value} >= 70 THEN 'Fair' WHEN {value} >= 50 THEN 'Poor' ELSE 'Critical' END AS five_bands,
CASE WHEN {value} >= 90 THEN 'excellent' WHEN {value} >= 75 THEN 'good' WHEN {value} >= 60 THEN 'moderate' ELSE 'poor' END AS level"""


def near_rows(tokens: list[str], percent: int) -> str:
    """CTEs: classes (k, rep, n) of rows with equal token sets, and links e (x, y) of them."""
    return f"""WITH tokens AS (SELECT DISTINCT k, t FROM ({' UNION ALL '.join(tokens)})),
        lists AS (SELECT k, count(*) AS n, string_agg(t, chr(0) ORDER BY t) AS held FROM tokens GROUP BY k),
        classes AS (SELECT k, n, min(k) OVER (PARTITION BY held) AS rep FROM lists),
        reps AS (SELECT rep, n FROM classes WHERE k = rep),
        common AS (SELECT a.k AS x, b.k AS y, count(*) AS c
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.k <> b.k
            WHERE a.k IN (SELECT rep FROM reps) AND b.k IN (SELECT rep FROM reps) GROUP BY ALL),
        e AS (SELECT x, y, c / (p.n + r.n - c) AS similarity FROM common
            JOIN reps p ON p.rep = x JOIN reps r ON r.rep = y WHERE 100 * c >= {percent} * (p.n + r.n - c))
        """


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    lists = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS columns" for t in TABLES
    )
    q["dataset_info"] = lists
    q["dataset_totals"] = f"SELECT count(*) AS tables, sum(rows)::BIGINT AS total_rows, sum(columns)::BIGINT AS total_columns FROM ({lists})"
    q["table_stats"] = """SELECT count(*) AS row_count, 5::BIGINT AS column_count, 5::BIGINT AS assessed_columns,
        (sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)))::BIGINT AS text_bytes FROM documents"""
    q["table_preview"] = rounded("SELECT * FROM customer ORDER BY c_custkey LIMIT 10", "c_acctbal")
    q["likely_date"] = rounded(
        per_column(("text_orders", "contacts", "mixed_events"), "T", lambda n, i, c, k: f"""
            SELECT share AS date_like_share, share > 0.7 AS likely_date FROM (SELECT coalesce(avg(regexp_matches({c}, '{DATE_LIKE}')::INT), 0e0) AS share FROM {n})"""),
        "date_like_share",
    )
    q["column_subset"] = rounded("SELECT c_custkey, c_acctbal FROM customer", "c_acctbal")
    q["column_flags"] = per_column(("text_orders", "contacts", "mixed_events", "dirty_lineitem"), "INTD", column_flags)
    q["trend_dates"] = per_column(("text_orders", "contacts", "mixed_events", "dirty_lineitem", "daily"), "TD", lambda n, i, c, k: f"""
        SELECT {i}::INT AS ordinal FROM {n} HAVING count({c}) > 0 AND count({c}) = count({date_expr(c, k)})""")
    q["type_distribution"] = union([f"""SELECT '{t}' AS "table", k AS kind, count(column_type) AS columns
        FROM (SELECT unnest(['Numeric', 'DateTime', 'Boolean', 'Text', 'Categorical', 'Other']) AS k)
        LEFT JOIN (SELECT column_type, {KIND.format('column_type')} AS kind FROM (DESCRIBE SELECT * FROM {t})) ON kind = k GROUP BY k""" for t in DESCRIBED])
    q["display_types"] = union([f"""SELECT '{t}' AS "table", CASE WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'Numeric (Float)'
        WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'Numeric (Integer)' WHEN column_type LIKE 'TIMESTAMP%' THEN 'Date/Time'
        WHEN column_type = 'VARCHAR' THEN 'Text' WHEN column_type = 'FLOAT[]' THEN 'array<float>' ELSE column_type END AS data_type, count(*) AS count
        FROM (DESCRIBE SELECT * FROM {t}) GROUP BY ALL""" for t in DESCRIBED])
    value = "completeness_percentage"
    q["score_labels"] = sources("dirty_lineitem") + union([
        f"""SELECT '{c}' AS "column", {bands(value)}, CASE WHEN {value} = floor({value}) THEN concat({value}::BIGINT, '/100') ELSE format('{{:.1f}}/100', {value}) END AS score_text,
            round(format('{{:.2f}}', {value})::DOUBLE, {DIGITS}) AS parsed, round(greatest(0e0, least(100e0, {value} * 1.1e0)), {DIGITS}) AS clamped
            FROM ({completeness('dirty_lineitem', i, c, k)})""" for i, c, k in columns_of("dirty_lineitem")])

    q["completeness_overall"] = rounded(per_table(("dirty_lineitem", "labelled"), completeness_overall), "completeness_percentage completeness_score")
    q["completeness_columns"] = rounded(per_column(("dirty_lineitem", "labelled"), "INTD", completeness), "completeness_percentage completeness_score")
    q["completeness_top5"] = sources("dirty_lineitem") + 'SELECT "column", round(completeness_percentage, 5) AS completeness_percentage FROM (' + union([
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", completeness_percentage FROM ({completeness('dirty_lineitem', i, c, k)})" for i, c, k in columns_of("dirty_lineitem")
    ]) + ") WHERE completeness_percentage < 100 ORDER BY completeness_percentage, ordinal LIMIT 5"
    q["missing_by_column"] = per_column(("dirty_lineitem", "labelled"), "INTD", lambda n, i, c, k: f"""
        SELECT count(*) - count({c}) AS missing_count, round(100e0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage FROM {n} HAVING count(*) > count({c})""")
    q["valid_and_missing"] = sources("dirty_lineitem") + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS valid, count(*) - count({c}) AS missing, round(100e0 * count({c}) / count(*), 5) AS complete_percentage FROM dirty_lineitem"
        for i, c, k in columns_of("dirty_lineitem")])
    q["missing_pattern"] = per_table(("dirty_lineitem", "labelled"), lambda n: "SELECT concat(" + ", ".join(
        f"({c} IS NULL)::INT" for _, c, _ in columns_of(n)) + f") AS pattern, count(*) AS count FROM {n} GROUP BY 1")

    q["type_consistency"] = rounded(per_column(("mixed_events", "contacts", "doc_texts"), "INTD", types), "type_score consistency_percentage")
    three = ("lineitem", "orders", "mixed_events")
    q["numeric_ranges"] = rounded(per_column(three, "IN", lambda *a: f"SELECT min, max, mean, median, std FROM ({numbers(*a)})"), "min max mean median std")
    q["iqr_outliers"] = rounded(per_column(three, "IN", lambda *a: f"SELECT q1, q3, iqr_outlier_count, iqr_outlier_percentage, value_score FROM ({numeric_scores(*a)})"), "q1 q3 iqr_outlier_percentage value_score")
    q["consistency_overall"] = rounded(per_table(("mixed_events", "contacts"), consistency_overall), "type_consistency_score value_consistency_score consistency_score")

    q["zscore_outliers"] = rounded(per_column(("lineitem", "mixed_events", "customer"), "IN", lambda *a: f"SELECT z_outlier_count, z_outlier_percentage, numeric_accuracy_score FROM ({numeric_scores(*a)})"), "z_outlier_percentage numeric_accuracy_score")
    q["text_style"] = rounded(per_column(("customer", "part", "doc_texts"), "T", style), "style_percentage text_accuracy_score")
    q["accuracy_overall"] = rounded(per_table(("customer", "mixed_events"), accuracy_overall), "numeric_accuracy_score text_accuracy_score accuracy_score")
    q["skewness"] = rounded(per_column(("lineitem", "mixed_events"), "IN", skew), "skewness")
    q["histogram_auto"] = rounded(per_column(("lineitem", "events"), "IN", histogram), "bin_start bin_end")
    q["histogram_fixed"] = rounded(union([f"SELECT '{c}' AS \"column\", * FROM ({histogram('orders', i, c, k, 20)})" for i, c, k in columns_of("orders", "IN")]), "bin_start bin_end")
    q["histogram_peaks"] = per_column(("lineitem", "events"), "IN", peaks)
    q["distribution_quality"] = rounded(per_column(("lineitem", "events"), "IN", distribution), "skewness")

    q["duplicate_rows"] = rounded(per_table(("doc_texts", "lineitem", "orders"), duplicates), "uniqueness_percentage uniqueness_score")
    q["column_uniqueness"] = rounded(per_column(("doc_texts", "dirty_lineitem", "orders"), "INTD", distinct), "uniqueness_ratio")
    q["key_candidates"] = per_column(("orders", "events", "customer"), "INTD", lambda n, i, c, k: f"SELECT count(DISTINCT {c}) AS unique_values FROM {n} HAVING count(DISTINCT {c}) = count(*)")
    q["high_cardinality"] = rounded(per_column(("doc_texts", "orders", "lineitem", "events"), "INTD", lambda *a: f"""
        SELECT unique_values, uniqueness_ratio, 100e0 * unique_values / total_values AS unique_percentage FROM ({distinct(*a)})
        WHERE uniqueness_ratio > 0.9 AND uniqueness_ratio < 1 AND total_values > 100"""), "uniqueness_ratio unique_percentage")

    q["timeliness_columns"] = rounded(per_column(("text_orders", "dirty_lineitem", "events"), "TD", lambda *a: f"SELECT * EXCLUDE (valid, old) FROM ({dates(*a)})"), "timeliness_score")
    q["timeliness_overall"] = rounded(per_table(("text_orders", "events", "customer"), timeliness_overall), "timeliness_score")
    q["date_ranges"] = per_column(("text_orders", "dirty_lineitem"), "TD", lambda *a: f"SELECT min_date, max_date FROM ({dates(*a)})")

    q["validity_formats"] = rounded(checked(("contacts", "page_links"), "format"), "validity_percentage validity_score")
    q["validity_ranges"] = rounded(checked(("percents", "page_links"), "range"), "validity_percentage validity_score")
    q["validity_overall"] = rounded(per_table(("contacts", "percents", "orders"), validity_overall), "validity_score")
    q["business_rules"] = sources("dirty_lineitem") + union([f"""SELECT '{r}' AS rule, count({e}) AS checked_rows, count(*) FILTER (NOT ({e})) AS violations,
        round({pct(f'count(*) FILTER (NOT ({e}))', f'count({e})', '0e0')}, 5) AS violation_percentage FROM dirty_lineitem""" for r, e in RULES.items()])

    all_three = "segment IS NOT NULL AND nation IS NOT NULL AND balance IS NOT NULL"
    q["combo_completeness"] = sources("pairs") + rounded(COMPLETE.format(condition=all_three), "complete_rows_percentage")
    q["co_missing"] = sources("pairs") + rounded(union([together(a, b) for a, b in (("segment", "nation"), ("segment", "balance"), ("nation", "balance"))]), "second_missing_given_first first_missing_given_second")
    q["functional_dependency"] = rounded(with_strength(dependency("lineitem", ["l_partkey", "l_suppkey", "l_returnflag"]) + "\nUNION ALL\n" + dependency("orders", ["o_custkey", "o_orderstatus", "o_orderpriority"])), "fd_score")
    q["pair_correlation"] = rounded("""SELECT 'l_quantity' AS column_1, 'l_extendedprice' AS column_2, r AS pearson,
        CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)""", "pearson")
    q["correlation_matrix"] = rounded(matrix(), "pearson")
    q["contingency"] = sources("pairs") + rounded(CONTINGENCY.format(source="SELECT segment AS value_1, (balance > 5000)::VARCHAR AS value_2 FROM pairs"), "share")
    flags = CONTINGENCY.format(source="SELECT l_returnflag AS value_1, l_linestatus AS value_2 FROM lineitem")
    q["strong_associations"] = rounded(f"SELECT value_1, value_2, share * 100 AS percentage FROM ({flags}) WHERE share >= 0.1 ORDER BY share DESC, value_1, value_2 LIMIT 5", "percentage")
    two = COMPLETE.format(condition="segment IS NOT NULL AND nation IS NOT NULL")
    q["combo_quality"] = sources("pairs") + rounded(f"""SELECT completeness, dependency_strength, completeness * 0.7e0 + dependency_strength * 0.3e0 AS overall
        FROM (SELECT (SELECT complete_rows_percentage FROM ({two})) AS completeness, (SELECT coalesce(avg(fd_score), 0e0) FROM ({dependency('pairs', ['segment', 'nation'])})) AS dependency_strength)""", "completeness dependency_strength overall")
    associations = CONTINGENCY.format(source="SELECT segment::VARCHAR AS value_1, nation::VARCHAR AS value_2 FROM pairs")
    q["combo_recommendations"] = sources("pairs") + f"""
        SELECT 1 AS position, 'Completeness' AS category, format('{{:.1f}}% of the rows have a value in every column', complete_rows_percentage) AS finding FROM ({two}) WHERE complete_rows_percentage < 95
        UNION ALL SELECT 2, 'Co-missing Pattern', 'segment and nation are mostly missing together' FROM ({together('segment', 'nation')}) WHERE second_missing_given_first > 80 OR first_missing_given_second > 80
        UNION ALL SELECT 3, 'Functional Dependency', concat('One column fixes the other: ', string_agg(concat(determinant, '->', dependent), ', ' ORDER BY determinant DESC)) FROM ({dependency('pairs', ['segment', 'nation'])}) WHERE fd_score >= 95 HAVING count(*) > 0
        UNION ALL (SELECT 5, 'Value Association', format('{{}} with {{}} makes up {{:.1f}}% of the rows', value_1, value_2, share * 100) FROM ({associations})
        WHERE share >= 0.1 AND (SELECT count(DISTINCT segment) <= 20 AND count(DISTINCT nation) <= 20 FROM pairs) ORDER BY share DESC, value_1, value_2 LIMIT 1)"""

    q["profile_overview"] = rounded(per_table(("dirty_lineitem", "doc_texts"), overview), "missing_percentage duplicate_percentage")
    q["profile_numeric"] = rounded(per_column(("dirty_lineitem", "orders"), "IN", numeric_profile), "missing_percentage mean median min max std")
    q["profile_date"] = rounded(per_column(("dirty_lineitem", "events"), "D", date_profile), "missing_percentage")
    q["profile_text"] = rounded(per_column(("orders", "part", "doc_texts"), "T", text_profile), "missing_percentage most_common_percentage")
    q["top_values"] = "SELECT value, count, round(100e0 * count / sum(count) OVER (), 5) AS percentage FROM (SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 20)"
    q["records_per_month"] = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1"
    q["box_stats"] = rounded(per_column(("lineitem", "orders"), "IN", box), "min whisker_low q1 median q3 whisker_high max")
    q["scatter"] = sources("mixed_events") + rounded("SELECT user_id AS x, sparse_value AS y, event_type AS colour FROM mixed_events WHERE user_id IS NOT NULL AND sparse_value IS NOT NULL", "y")

    q["assessment_scores"] = with_scores(rounded('SELECT "table", dimension, score FROM scores', "score"), False)
    q["overall_scores"] = with_scores(rounded("SELECT * FROM overall", "score"))
    q["top_issues"] = sources(*ASSESSED) + rounded(f'SELECT "table", "column", issue, dimension, severity FROM ({issues()}) ORDER BY severity DESC, position, rule, ordinal LIMIT 10', "severity")
    q["table_issues"] = sources(*ASSESSED) + rounded(f"""SELECT "table", rank, "column", table_issue AS issue, dimension, score
        FROM (SELECT *, (row_number() OVER (PARTITION BY "table" ORDER BY score, rule, ordinal))::INT AS rank FROM ({issues()})) WHERE rank <= 8""", "score")
    q["dimension_recommendations"] = with_scores(advice())
    ranked = table_scores() + ",\n" + OVERALL + ",\n" + ranked_scores()
    q["strongest_weakest"] = sources(*ASSESSED, more=ranked) + rounded(ENDS, "strongest_score weakest_score")
    q["critical_dimension"] = sources(*ASSESSED, more=ranked) + context()
    q["history_snapshot"] = with_scores(rounded(f"""SELECT 'views' AS name, {len(ASSESSED)}::BIGINT AS table_count, ({' + '.join(f'(SELECT count(*) FROM {n})' for n in ASSESSED)})::BIGINT AS total_rows,
        {sum(len(columns_of(n)) for n in ASSESSED)}::BIGINT AS total_columns, {', '.join(f"(SELECT score FROM overall WHERE dimension = '{d}') AS {d}" for d in ('overall', *DIMENSIONS))}""", " ".join(("overall", *DIMENSIONS))))

    q["insight_signals"] = sources(*ASSESSED) + rounded(f'SELECT "table", rule, "column", p FROM ({signals()})', "p")
    shown = "p business_impact overall_gain executive priority_score"
    q["insights"] = with_insights(rounded(f"SELECT {INSIGHT_COLUMNS} FROM insights", shown))
    q["insight_priority"] = with_insights(rounded('SELECT rank, "table", rule, "column", priority_score FROM insights', "priority_score"), "validity")
    q["top_recommendations"] = with_insights(rounded(f"SELECT {INSIGHT_COLUMNS} FROM insights ORDER BY rank LIMIT 5", shown))
    q["insights_by_role"] = with_insights(" UNION ALL ".join(
        f"(SELECT '{r}' AS role, rank, \"table\", rule, \"column\" FROM insights WHERE {r} > 0.5 ORDER BY rank LIMIT {n})" for r, n in (("data_team", 10), ("business_users", 7), ("executive", 5))))
    q["insight_stakeholders"] = with_insights("""SELECT rank, rule, concat_ws(',', CASE WHEN data_team > 0.6 THEN 'data_team' END,
        CASE WHEN business_users > 0.6 THEN 'business_users' END, CASE WHEN executive > 0.3 THEN 'executive' END) AS stakeholders FROM insights""")
    q["insight_phases"] = with_insights(rounded("""SELECT rank, rule, CASE WHEN effort IN ('trivial', 'small') THEN 'quick_wins' WHEN effort = 'moderate' THEN 'medium_term' ELSE 'long_term' END AS phase,
        least(gain_overall, 10e0) AS phase_gain FROM insights""", "phase_gain"))
    q["insight_improvements"] = with_insights(rounded(f"""SELECT coalesce(o.dimension, g.dimension) AS dimension, score AS current, coalesce(gain, 0e0) AS gain,
        least(100e0, score + least(100e0 - score, coalesce(gain, 0e0))) AS projected FROM overall o FULL JOIN ({GAINS}) g ON o.dimension = g.dimension""", "current gain projected"), scores=True)
    q["insight_top_gains"] = with_insights(rounded(f"SELECT * FROM ({GAINS}) WHERE dimension <> 'overall' AND gain > 0 ORDER BY gain DESC, dimension LIMIT 3", "gain"))

    month = "strftime(month, '%Y-%m-%d') AS month"
    q["monthly_series"] = with_series(rounded(f"SELECT {month}, idx, value FROM series", "value"))
    q["linear_trend"] = with_series(rounded("SELECT slope, intercept FROM fit", "slope intercept"))
    q["forecast"] = with_series(rounded(f"SELECT * REPLACE ({month}) FROM ({FORECAST.format(n=7)})", "value"))
    q["history_and_forecast"] = with_series(rounded(f"SELECT {month}, value, 'Historical' AS type FROM series UNION ALL SELECT {month}, value, 'Forecast' FROM ({FORECAST.format(n=12)})", "value"))
    q["trend_stats"] = with_series(rounded("""SELECT average_change, average_change / mean_value * 100 AS percentage_change,
        CASE WHEN average_change > 0 THEN 'Increasing' WHEN average_change < 0 THEN 'Decreasing' ELSE 'Stable' END AS direction, current_value,
        slope * (last_idx + 7) + intercept AS forecast_end_value, slope * (last_idx + 7) + intercept - current_value AS forecast_delta
        FROM fit, (SELECT avg(d) AS average_change, avg(value) AS mean_value, max_by(value, idx) AS current_value FROM (SELECT *, value - lag(value) OVER (ORDER BY idx) AS d FROM series))""",
        "average_change percentage_change current_value forecast_end_value forecast_delta"))
    q["seasonal_decomposition"] = with_series(rounded(f"SELECT * REPLACE ({month}) FROM decomposed", "value trend seasonal residual"), True)
    q["seasonal_pattern"] = with_series(rounded("SELECT * FROM pattern", "seasonality"), True)
    q["strongest_months"] = with_series(rounded("SELECT month_name, CASE WHEN seasonality > 0 THEN 'increase' ELSE 'decrease' END AS direction, abs(seasonality) AS effect FROM pattern ORDER BY abs(seasonality) DESC, month_number LIMIT 3", "effect"), True)

    last = "last10 AS (SELECT * FROM daily ORDER BY ts DESC LIMIT 10),\nchanges AS (SELECT ts, name, overall, lag(overall) OVER (ORDER BY ts) AS previous, overall - lag(overall) OVER (ORDER BY ts) AS change FROM last10)\n"
    day = "strftime(ts, '%Y-%m-%d') AS ts"
    daily = sources("daily", more=last)
    q["history_latest"] = daily + rounded(f"SELECT * REPLACE ({day}) FROM last10", "overall validity")
    q["history_score_trend"] = daily + rounded(f"SELECT {day}, 'overall' AS dimension, overall AS score FROM last10 UNION ALL SELECT {day}, 'validity', validity FROM last10", "score")
    q["history_volume_trend"] = daily + f"SELECT {day}, total_rows, total_columns FROM last10"
    q["history_change"] = daily + rounded(f"SELECT * REPLACE ({day}) FROM changes", "overall previous change")
    q["history_biggest_changes"] = daily + rounded(f"SELECT * REPLACE ({day}) FROM ((SELECT 'improvement' AS kind, * FROM changes WHERE change > 0 ORDER BY change DESC, ts LIMIT 3) UNION ALL (SELECT 'decline' AS kind, * FROM changes WHERE change < 0 ORDER BY change, ts LIMIT 3))", "overall previous change")

    events = sources("mixed_events")
    q["remediate_median_fill"] = events + rounded("SELECT event_id, coalesce(sparse_value, (SELECT quantile_cont(sparse_value, 0.5) FROM mixed_events)) AS sparse_value FROM mixed_events", "sparse_value")
    q["remediate_ffill"] = events + rounded("SELECT event_id, last_value(sparse_value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sparse_value FROM mixed_events", "sparse_value")
    q["remediate_ffill_by_type"] = events + rounded("SELECT event_id, last_value(sparse_value IGNORE NULLS) OVER (ORDER BY event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sparse_value FROM mixed_events", "sparse_value")
    q["remediate_dedup"] = "SELECT sha256(text) AS digest, lang, source, n_chars FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)"
    q["remediate_dup_keys"] = sources("labelled") + "SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY lang, n_chars) AS n FROM labelled) WHERE n > 1"
    q["remediate_range"] = rounded("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48", "l_quantity")
    q["remediate_zscore"] = rounded("SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / nullif(s, 0)) > 3", "value")
    q["remediate_outdated"] = sources("text_orders") + f"SELECT o_orderkey, order_date FROM text_orders WHERE {days(f'TIMESTAMP {chr(39)}{AS_OF}{chr(39)}', date_expr('order_date', 'T'))} > 365"
    q["remediate_not_matching"] = sources("contacts") + "SELECT c_custkey, email FROM contacts WHERE NOT coalesce(regexp_matches(email, '^[a-z0-9]+@[a-z.]+$'), false)"
    q["remediate_cast"] = events + rounded("SELECT event_id, TRY_CAST(mixed AS DOUBLE) AS mixed FROM mixed_events", "mixed")

    q["cluster_sizes"] = "SELECT event_type, size, round(100e0 * size / sum(size) OVER (), 5) AS percentage FROM (SELECT event_type, count(*) AS size FROM events GROUP BY 1)"
    q["cluster_stats"] = rounded(union([f"""SELECT event_type, '{c}' AS "column", count(*) AS size, 100e0 * count(*) / (SELECT count(*) FROM events) AS percentage, avg({c}::DOUBLE) AS mean, min({c})::DOUBLE AS min,
        max({c})::DOUBLE AS max, stddev_samp({c}::DOUBLE) AS std, quantile_cont({c}::DOUBLE, 0.5) AS median FROM events GROUP BY 1""" for c in ("user_id", "value")]), "percentage mean min max std median")
    q["cluster_samples"] = rounded("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 10", "value")

    q["anomaly_counts"] = "SELECT count(*) AS rows, (floor(0.05 * (count(*) - 1)) + 1)::BIGINT AS anomalies FROM lineitem"
    q["anomaly_paths"] = "SELECT count(*) AS rows, 0 AS different FROM (SELECT DISTINCT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    by_text = [f"SELECT doc_id AS k, '{c}:' || unnest({words.format(c)}) AS t FROM documents" for c in ("text", "lang", "source")]
    contacts = [f"SELECT c_custkey AS k, '{c}:' || unnest({words.format(c)}) AS t FROM contacts" for c in ("c_mktsegment", "email", "phone", "zip_code")]
    contacts.append("SELECT c_custkey, 'n:' || c_nationkey FROM contacts WHERE c_nationkey IS NOT NULL")
    contacts += [f"SELECT c_custkey, 'b{h}:' || floor(c_acctbal / 50 + {h}) FROM contacts WHERE c_acctbal IS NOT NULL" for h in (0, 0.5)]
    q["near_row_links"] = near_rows(by_text, 70) + "SELECT x AS left_key, y AS right_key, round(similarity, 5) AS similarity FROM e WHERE x < y"
    q["near_contacts"] = sources("contacts", more=near_rows(contacts, 60).replace("WITH", "", 1)) + "SELECT x AS left_key, y AS right_key, round(similarity, 5) AS similarity FROM e WHERE x < y"
    q["near_row_groups"] = near_rows(by_text, 70).replace("WITH", "WITH RECURSIVE", 1).rstrip() + """,
        reach AS (SELECT rep AS x, rep AS y FROM reps UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
        roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
        degrees AS (SELECT x, count(*) AS links FROM e GROUP BY x)
        SELECT doc_id, coalesce(root, doc_id) AS group_key, coalesce(c.n, 0) AS tokens, coalesce(links, 0) AS links
        FROM documents LEFT JOIN classes c ON c.k = doc_id LEFT JOIN roots ON roots.x = c.rep LEFT JOIN degrees d ON d.x = c.rep"""
    q["load_folder"] = q["dataset_info"]
    q["csv_round_trip"] = rounded("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders", "o_totalprice")
    q["narrative"] = sources(*ASSESSED, more=ranked) + f"""SELECT 1::INT AS line, format('Overall quality is {{:.1f}} of 100: {{}}.', score, three_bands) AS text
        FROM (SELECT score, {bands('score')} FROM overall WHERE dimension = 'overall')
        UNION ALL SELECT 2, format('The strongest dimension is {{}} ({{:.1f}}), the weakest {{}} ({{:.1f}}).', strongest, strongest_score, weakest, weakest_score) FROM ({ENDS})
        UNION ALL SELECT 3, format('{{}} columns need attention.', count(DISTINCT "table" || '/' || "column")) FROM ({issues()})"""
    windows = """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS window_end, count(*) AS rows,
        100e0 * (count(*) - count(value)) / count(*) AS missing_percentage, 100e0 * count(*) FILTER (value BETWEEN 0 AND 50) / count(value) AS valid_percentage, min(value) AS min, max(value) AS max
        FROM (SELECT date_trunc('hour', ts) AS w, value FROM events) GROUP BY w"""
    q["table_windows"] = rounded(windows, "missing_percentage valid_percentage min max")
    q["running_quality"] = rounded(per_column(("mixed_events", "dirty_lineitem"), "INTD", running_quality),
        "completeness_percentage completeness_score type_score consistency_percentage min max mean std skewness")
    q["missing_sample"] = sources("dirty_lineitem") + f"""SELECT {', '.join(f'({c} IS NULL)::INT AS {c}' for i, c, k in columns_of('dirty_lineitem'))}
        FROM dirty_lineitem ORDER BY md5(concat_ws(':', 42, l_orderkey, l_linenumber)), l_orderkey, l_linenumber LIMIT 100"""
    q["stream_windows"] = rounded(
        windows + " HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
        "missing_percentage valid_percentage min max",
    )
    return q
