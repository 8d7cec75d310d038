"""Column expressions shared by every layer; all of them stay inside Spark's code generation."""

from silvermart.functions.dates import date_key, iso_day_of_week, parse_date
from silvermart.functions.numbers import (
    beyond_exact,
    exact,
    parse_money,
    parse_number,
    round_cents,
    whole,
)
from silvermart.functions.regions import normalize_region, prefix_region
from silvermart.functions.text import (
    blank_to_null,
    clean_text,
    clean_upper,
    is_missing,
    is_present,
    strip_all,
    trim_all,
    upper_to_null,
)

__all__ = [
    "beyond_exact", "blank_to_null", "clean_text", "clean_upper", "date_key", "exact", "is_missing", "is_present",
    "iso_day_of_week", "normalize_region", "parse_date", "parse_money", "parse_number",
    "prefix_region", "round_cents", "strip_all", "trim_all", "upper_to_null", "whole",
]
