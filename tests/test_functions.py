from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from silvermart import functions as S

DAY = datetime.date(2020, 1, 5)


def evaluate(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_every_date_spelling(spark):
    spelled = [
        "2020-01-05 00:00:00", "2020-01-05", "01-05-2020", "05/01/2020", "05-Jan-2020",
        "Jan 05 2020", "2020-1-5", "1-5-2020", "5/1/2020", "5-JAN-2020", "jan 5 2020",
        "2020-01-05 23:59:59",
    ]
    assert evaluate(spark, S.parse_date, spelled) == [DAY] * len(spelled)


def test_dash_is_month_first_and_slash_day_first(spark):
    assert evaluate(spark, S.parse_date, ["03-04-2020", "03/04/2020"]) == [
        datetime.date(2020, 3, 4), datetime.date(2020, 4, 3),
    ]


def test_what_is_no_date(spark):
    wrong = [
        "13-04-2020", "2021-02-30", "NaT", "nan", "", None, "2020-01-05x", "05-Foo-2020", "-", "/",
        ":", "2020", "Jan 2020", "31/31/2020", "2020-01-05 25:00:00",
    ]
    assert evaluate(spark, S.parse_date, wrong) == [None] * len(wrong)


def test_date_choice_by_separator_equals_trying_all(spark):
    from itertools import product

    from silvermart.functions.dates import DATE_FORMATS

    values = [
        a + s + b + t + c
        for a, s, b, t, c in product(
            ["1", "12", "31", "2020", "Jan", ""], "-/ ", ["2", "Feb", "13"], "-/ ",
            ["2021", "5", "5 1:2:3", ""],
        )
    ]
    in_turn = lambda x: F.coalesce(
        *[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in DATE_FORMATS.values()]
    )
    assert evaluate(spark, S.parse_date, values) == evaluate(spark, in_turn, values)


def test_money(spark):
    texts = ["$1,906.48", "-1,359.99", "12", "nan", "NaN", "", "abc", None, "inf", "-Infinity"]
    assert evaluate(spark, S.parse_money, texts) == [1906.48, -1359.99, 12.0] + [None] * 7


def test_plain_numbers_take_no_money_marks(spark):
    assert evaluate(spark, S.parse_number, ["$5", "1,000", "2.5", "-0.2"]) == [
        None, None, 2.5, -0.2,
    ]


def test_whole_rounds_ties_away_from_zero(spark):
    values = [2.0, 2.4, 2.5, 3.5, -2.5, None, 1e12]
    assert evaluate(spark, S.whole, values, "double") == [2, 2, 3, 4, -3, None, None]


def test_round_cents_works_on_the_double(spark):
    values = [0.285, 1.005, 2.675, -0.285, 10.0, None]
    expected = [
        None if v is None else math.copysign(math.floor(abs(v) * 100 + 0.5) / 100, v)
        for v in values
    ]
    assert evaluate(spark, S.round_cents, values, "double") == expected
    assert expected[:2] == [0.28, 1.0]


def test_blanks(spark):
    texts = [" a ", "", "  ", "nan", " nan ", "NaN", "\tb\n", "　c ", None, "a b", "x\t"]
    assert evaluate(spark, S.clean_text, texts) == [
        "a", None, None, None, None, "NaN", "b", "c", None, "a b", "x",
    ]
    assert evaluate(spark, S.clean_upper, texts) == [
        "A", None, None, None, None, None, "B", "C", None, "A B", "X",
    ]
    assert evaluate(spark, S.is_missing, ["", " ", "NaN", None, "x"]) == [True] * 4 + [False]


def test_non_breaking_space_and_inner_space_stay(spark):
    texts = [" a ", "é", "~x~", "a b"]
    assert evaluate(spark, S.trim_all, texts) == texts


@pytest.mark.parametrize(
    "spelled, region",
    [
        ("ctr", "Central"), ("CENTRAL", "Central"), ("Central Region", "Central"),
        ("East", "East"), ("east region", "East"), ("Sth", "South"), ("South", "South"),
        ("south region", "South"), ("WST", "West"), ("West Region", "West"), ("wesT", "West"),
        ("North", "North"), (None, None),
    ],
)
def test_region(spark, spelled, region):
    assert evaluate(spark, S.normalize_region, [spelled]) == [region]


def test_prefix(spark):
    df = spark.createDataFrame(
        [("United States", "East"), ("Canada", "West"), ("Peru", "South"), ("Canada", None),
         (None, "East")],
        "c string, r string",
    )
    found = [r[0] for r in df.select(S.prefix_region(F.col("c"), F.col("r"))).collect()]
    assert found == ["US-East", "CA-West", "South", None, "East"]


def test_calendar_parts(spark):
    days = [datetime.date(2023, 12, 31), datetime.date(2024, 1, 1), None]
    assert evaluate(spark, S.date_key, days, "date") == [20231231, 20240101, None]
    assert evaluate(spark, S.iso_day_of_week, days, "date") == [7, 1, None]
