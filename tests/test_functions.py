import datetime

import pytest
from pyspark.sql import functions as F

from spendframe.functions import dates, money
from spendframe.functions.numbers import percent
from spendframe.operators.reports import category_of


def values(spark, rows, *columns):
    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    return [tuple(row) for row in frame.select(*columns).collect()]


TOLERANT = [
    ("$123.45", 123.45), ("€123,45", 123.45), ("£1,234.56", 1234.56), ("¥1234", 1234.0), ("CHF 123.45", 123.45),
    ("€1.234,56", 1234.56), (None, 0.0), ("invalid", 0.0), ("¥15,980", 15980.0), ("-$10.00", 10.0), ("1,234,567", 1234567.0),
]


def test_tolerant_amount(spark):
    got = values(spark, [t for t, _ in TOLERANT], money.tolerant_amount(F.col("t")))
    assert [g[0] for g in got] == [v for _, v in TOLERANT]


def test_signed_amount_keeps_the_sign(spark):
    assert values(spark, ["-$10.00"], money.tolerant_amount(F.col("t"), signed=True)) == [(-10.0,)]


STRICT = [
    ("$123.45", 123.45), ("55,45 €", 55.45), ("1.234,56 €", 1234.56), ("$1,234.56", 1234.56), ("-$10.00", -10.0),
    ("¥15,980", 15.98), ("", None), (None, None), ("words", None), ("£1234", 1234.0),
]


def test_strict_amount(spark):
    got = values(spark, [t for t, _ in STRICT], money.strict_amount(F.col("t")))
    assert [g[0] for g in got] == [v for _, v in STRICT]


def test_symbols_and_shapes(spark):
    rows = ["$1.00", "Fr. 123.45", "CHF 5.00", "12", "CUR123.45", "1.234,56 €"]
    got = values(spark, rows, money.currency_symbol(F.col("t")), money.is_money_text(F.col("t")))
    assert got == [("$", True), ("Fr", True), ("CHF", True), (None, False), (None, False), ("€", True)]


def test_money_texts(spark):
    frame = spark.createDataFrame([(123456,), (5,), (-250,)], "c bigint")
    got = frame.select(money.two_decimals(F.col("c")), money.european_amount(F.col("c")), money.grouped_decimals(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("1234.56", "1234,56 €", "1,234.56"), ("0.05", "0,05 €", "0.05"), ("-2.50", "-2,50 €", "-2.50")]


DATES = [
    ("November 8, 2025", "en", (2025, 11, 8)), ("8 November 2025", "en", (2025, 11, 8)), ("29. November 2025", "de", (2025, 11, 29)),
    ("1er novembre 2025", "fr", (2025, 11, 1)), ("15 DÉCEMBRE 2023", "fr", (2023, 12, 15)), ("30 noviembre 2025", "es", (2025, 11, 30)),
    ("29 novembre 2025", "it", (2025, 11, 29)), ("15.12.2023", "de", (2023, 12, 15)), ("03/04/2024", "en", (2024, 3, 4)),
    ("03/04/2024", "fr", (2024, 4, 3)), ("15/04/2024", "en", (2024, 4, 15)), ("2023年12月15日", "ja", (2023, 12, 15)),
    ("2023-12-15", "en", (2023, 12, 15)), ("29 February 2023", "en", None), ("29 February 2024", "en", (2024, 2, 29)),
    ("32 December 2023", "en", None), ("December 2023", "en", None), ("", "en", None), (None, "en", None),
]


@pytest.mark.parametrize("language", sorted({d[1] for d in DATES}))
def test_written_dates(spark, language):
    cases = [d for d in DATES if d[1] == language]
    got = values(spark, [c[0] for c in cases], dates.written_date(F.col("t"), language))
    assert [g[0] for g in got] == [c[2] and datetime.date(*c[2]) for c in cases]


def test_language_codes(spark):
    assert values(spark, ["French", "Klingon"], dates.language_code(F.col("t"))) == [("fr",), ("en",)]


def test_categories_take_the_first_hit(spark):
    rows = ["Echo Dot kitchen", "Notebook", "Pen", "Puzzle", "nothing", None]
    got = values(spark, rows, category_of(F.col("t")))
    assert [g[0] for g in got] == ["Electronics", "Books", "Office Supplies", "Toys & Games", "Other", "Other"]


def test_percent_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(2, 3), (0, 0)], "a bigint, b bigint")
    assert [tuple(r) for r in frame.select(percent(F.col("a"), F.col("b"), 1), percent(F.col("a"), F.col("b"))).collect()] == [(66.7, 67.0), (0.0, 0.0)]
