"""Tests on text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabgauge.functions import fixed

# (?d): only \n ends a line; (?U): \d and \s cover all scripts.
_FLAGS = "(?dU)"

TYPE_CLASSES = ("boolean", "integer", "float", "date", "text")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def looks_like_date(text: Column) -> Column:
    # No match is longer than 12 characters, so long text skips the pattern.
    return (F.length(text) <= 13) & matches(text, fixed.LIKELY_DATE_PATTERN)


def is_lower(text: Column) -> Column:
    return (F.lower(text) == text) & (F.upper(text) != text)


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_title(text: Column) -> Column:
    """Each run of letters starts with a capital and goes on in lower case."""
    return (
        text.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]")
        & ~text.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")
        & ~text.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]")
    )


def type_class(text: Column) -> Column:
    """What a text value looks like: one of ``TYPE_CLASSES``.

    Most text is recognised by its first character, without any pattern.
    """
    starts_number = F.substring(text, 1, 1).isin(*"+-.0123456789")
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when((F.length(text) <= 5) & F.lower(text).isin("true", "false"), "boolean")
        .when(~starts_number, "text")
        .when(text.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(
            text.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"),
            "float",
        )
        .when(
            text.rlike(
                r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})$"
            ),
            "date",
        )
        .otherwise("text")
    )
