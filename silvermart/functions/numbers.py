"""Number parsing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that money columns carry around the digits.
MONEY_MARKS = "$,"

# Sums of money run over this type: the result does not depend on the order of the rows. Eight
# digits behind the point hold every amount as it was written; what lies beyond the type's range
# is left out of the sums and counted by the check of the money range.
EXACT_TYPE = "decimal(30,8)"

# From here on a double has no cents.
WHOLE_FROM = float(1 << 53)


def parse_number(c: Column) -> Column:
    """Text to double; NULL where it is no finite number.

    Spark reads 'nan' in any case as NaN, and NaN compares above infinity, so the one comparison
    takes out NaN and both infinities.
    """
    number = c.try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_money(c: Column) -> Column:
    """'$1,906.48' -> 1906.48."""
    for mark in MONEY_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return parse_number(c)


def whole(c: Column) -> Column:
    """Double to int, ties away from zero (a plain cast would cut the fraction off)."""
    return F.round(c).try_cast("int")


def round_cents(c: Column) -> Column:
    """Two digits, ties away from zero, computed on the double itself.

    Spark's round() goes through the decimal text: 0.285 would become 0.29 where binary
    arithmetic gives 0.28. Where the double itself has no cents any more it stays as it is.
    """
    cents = F.abs(c) * 100
    rounded = F.signum(c) * F.floor(F.when(cents < WHOLE_FROM, cents) + 0.5) / 100
    return F.when(cents >= WHOLE_FROM, c).otherwise(rounded)


def exact(c: Column) -> Column:
    """Money as decimal, for sums; NULL beyond the type's range."""
    return c.try_cast(EXACT_TYPE)


def beyond_exact(c: Column) -> Column:
    """Whether an amount is there but beyond the range of the sums."""
    return c.isNotNull() & exact(c).isNull()
