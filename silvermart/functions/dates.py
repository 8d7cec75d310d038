"""Date parsing and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six accepted spellings of a date, one-digit day and month included.
# A dash between two numbers means month first, a slash means day first.
DATE_FORMATS = {
    "timestamp": "yyyy-M-d H:m:s",
    "iso": "yyyy-M-d",
    "month_first": "M-d-yyyy",
    "day_first": "d/M/yyyy",
    "day_month_name": "d-MMM-yyyy",
    "month_name_day": "MMM d yyyy",
}


def parse_date(text: Column) -> Column:
    """Date in any of the six spellings, NULL otherwise. Takes trimmed text.

    A failed parse costs several times a good one, so the separators choose the only spelling
    that can fit and each value is parsed once at most.
    """

    def read(name: str) -> Column:
        return F.try_to_timestamp(text, F.lit(DATE_FORMATS[name])).cast("date")

    dash = F.locate("-", text)
    after_dash = F.substring(text, dash + 1, F.lit(1))
    return (
        F.when(text.contains(":"), read("timestamp"))
        .when(text.contains("/"), read("day_first"))
        .when(text.contains(" "), read("month_name_day"))
        .when(dash == 0, None)
        .when(dash >= 5, read("iso"))
        .when(after_dash <= "9", read("month_first"))
        .otherwise(read("day_month_name"))
    )


def date_key(d: Column) -> Column:
    """YYYYMMDD as int."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def iso_day_of_week(d: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(d) + 1
