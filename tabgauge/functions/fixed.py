"""Constants that decide the results and must not be changed.

Everything here is data (thresholds, patterns, labels, weights); the logic that
reads it lives in the operators.
"""

# Score steps (good, great, excellent) per kind of measure.
STEPS = {
    "completeness": (95.0, 98.0, 99.5),
    "value_consistency": (95.0, 98.0, 99.0),
    "numeric_accuracy": (95.0, 98.0, 99.0),
    "text_accuracy": (70.0, 85.0, 95.0),
    "uniqueness": (95.0, 98.0, 99.5),
    "format": (90.0, 95.0, 99.0),
    "range": (95.0, 98.0, 99.5),
}

# Quality dimensions in reporting order.
DIMENSIONS = (
    "completeness",
    "consistency",
    "accuracy",
    "uniqueness",
    "timeliness",
    "validity",
)

# Column kinds in reporting order.
KINDS = ("Numeric", "DateTime", "Boolean", "Text", "Categorical", "Other")

# A text column is a likely date column when more than this share
# of its values matches the pattern.
LIKELY_DATE_PATTERN = (
    r"^(\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{2,4}[-/]\d{2}|\d{8}|\d{6})$"
)
LIKELY_DATE_SHARE = 0.7

# Format checks for text columns, chosen by a word in the column
# name; the first match wins.
FORMAT_CHECKS = (
    ("email", ("email",), r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("phone", ("phone", "mobile", "tel"), r"^\+?[\d\s\(\)-]{7,20}$"),
    (
        "url",
        ("url", "website", "link"),
        r"^(http|https)://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(/.*)?$",
    ),
    ("postal", ("zip", "postal", "postcode"), r"^\d{4,5}(-\d{4})?$"),
)

# Range checks for numeric columns, chosen the same way.
RANGE_CHECKS = (
    ("numeric_range", ("age", "years"), 0, 120),
    ("percentage", ("percent", "pct", "rate", "ratio"), 0, 100),
)

# Tokens read as missing in delimited text files.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Outlier fences and distribution limits.
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
MIN_DISTRIBUTION_ROWS = 30

# Dimension advice (advise below, urgent below, urgent label,
# other label).
ADVICE_LIMITS = {
    "completeness": (90.0, 75.0, "High", "Medium"),
    "consistency": (90.0, 75.0, "High", "Medium"),
    "accuracy": (90.0, 75.0, "High", "Medium"),
    "uniqueness": (95.0, 85.0, "High", "Medium"),
    "timeliness": (85.0, 70.0, "Medium", "Low"),
    "validity": (90.0, 75.0, "High", "Medium"),
}

# Weights of the insight ranking, without and with a dimension
# the user puts first.
RANK_WEIGHTS = {"impact": 0.6, "effort": 0.3, "dimension": 0.1}
RANK_WEIGHTS_FOCUSED = {"impact": 0.5, "effort": 0.2, "dimension": 0.3}
EFFORT_WEIGHTS = {"trivial": 1.0, "small": 0.8, "moderate": 0.5, "large": 0.2}
DIMENSION_WEIGHTS = {
    "completeness": 0.9,
    "accuracy": 0.85,
    "consistency": 0.8,
    "validity": 0.75,
    "uniqueness": 0.7,
    "timeliness": 0.65,
}

# How much of an insight's gain counts towards the forecast.
OVERALL_GAIN_SHARE = 0.1
DIMENSION_GAIN_SHARE = 0.2

# Audience lists (minimum relevance, list length).
ROLE_VIEWS = {
    "data_team": (0.5, 10),
    "business_users": (0.5, 7),
    "executive": (0.5, 5),
}
STAKEHOLDER_LIMITS = {"data_team": 0.6, "business_users": 0.6, "executive": 0.3}

# Month labels.
MONTHS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
