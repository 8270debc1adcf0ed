"""Dates: parsing, elapsed days and the reference point in time."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ways of writing a date, as (pattern, replacement) that turns it into
# year-month-day; month-first wins over day-first when both fit.
TEXT_FORMS = (
    (r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", "$1-$2-$3"),
    (r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$", "$3-$1-$2"),
    (r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$", "$3-$2-$1"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
    (r"^([0-9]{4})[-/]([0-9]{1,2})$", "$1-$2-01"),
    (r"^([0-9]{2})([0-9]{2})([0-9]{2})$", "20$1-$2-$3"),
)
_DATE = r"^[0-9]{1,4}[-/]?[0-9]{1,2}([-/]?[0-9]{1,4})?$"
_MOMENT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]"

_MICROS_PER_DAY = 86_400_000_000


def moment(as_of: str | date | datetime | None) -> Column:
    """The point in time ages are counted from; now when not given."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(str(as_of)).cast("timestamp")


def parse_date(text: Column) -> Column:
    """Timestamp of a date text, NULL when it is no date.

    What passes the anchored patterns is rewritten as year-month-day and cast, which
    never raises.
    """
    forms = [
        F.when(text.rlike(pattern), F.regexp_replace(text, pattern, form)).try_cast("timestamp")
        for pattern, form in TEXT_FORMS
    ]
    return F.when(text.rlike(_DATE), F.coalesce(*forms)).when(
        text.rlike(_MOMENT), text.try_cast("timestamp")
    )


def as_timestamp(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return parse_date(column)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp")
    return F.lit(None).cast("timestamp")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours between two timestamps, rounded down."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(_MICROS_PER_DAY).cast("double")).cast("bigint")
