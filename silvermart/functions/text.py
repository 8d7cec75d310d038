"""Text cleaning. In the raw layer a missing cell is the text 'nan', never a NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters TRIM strips (Unicode white space without the non-breaking spaces)
# and the spellings of a missing cell.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f "
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
)
MISSING = ("", "nan")
MISSING_UPPER = ("", "NAN")


def strip_all(c: Column) -> Column:
    """Strip white space of every kind; Spark's plain trim strips the space character alone."""
    return F.trim(c, F.lit(WHITESPACE))


def trim_all(c: Column) -> Column:
    """strip_all for columns that are mostly clean.

    Stripping a set of characters costs many times what a look at both ends costs, so a cell that
    begins and ends with a visible ASCII character passes through.
    """
    clean = c.between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(clean, c).otherwise(strip_all(c))


def is_present(trimmed: Column) -> Column:
    """False for a missing cell, NULL for NULL. Takes trimmed text, like the next two."""
    return ~trimmed.isin(*MISSING)


def blank_to_null(trimmed: Column) -> Column:
    """NULL for a missing cell; 'nan' is case-sensitive."""
    return F.when(is_present(trimmed), trimmed)


def clean_text(c: Column) -> Column:
    return blank_to_null(trim_all(c))


def upper_to_null(trimmed: Column) -> Column:
    """Upper-cased text; here 'nan' counts as missing in any case."""
    upper = F.upper(trimmed)
    return F.when(~upper.isin(*MISSING_UPPER), upper)


def clean_upper(c: Column) -> Column:
    return upper_to_null(trim_all(c))


def is_missing(c: Column) -> Column:
    """True for a raw cell that holds nothing: NULL, blank, or 'nan' in any case."""
    return c.isNull() | F.lower(trim_all(c)).isin(*MISSING)
