from datetime import datetime

import pytest

from tallyline.functions import as_double, as_int, as_timestamp


def evaluate(spark, values, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").selectExpr(expression).collect()]


TEXT_NUMBERS = {
    "3.7": (4, 3.7),
    "2.5": (3, 2.5),
    "-2.5": (-3, -2.5),
    "1e3": (1000, 1000.0),
    " 12 ": (12, 12.0),
    "+5": (5, 5.0),
    ".5": (1, 0.5),
    "5.": (5, 5.0),
    "inf": (None, float("inf")),
    "-Infinity": (None, float("-inf")),
    "3000000000": (None, 3e9),
    "": (None, None),
    "abc": (None, None),
    "1,5": (None, None),
    "1d": (None, None),
    "2F": (None, None),
    "5L": (None, None),
    "1e": (None, None),
    None: (None, None),
}


def test_text_to_int(spark):
    got = evaluate(spark, list(TEXT_NUMBERS), "string", as_int("v", "string"))
    assert got == [i for i, _ in TEXT_NUMBERS.values()]


def test_text_to_double(spark):
    got = evaluate(spark, list(TEXT_NUMBERS), "string", as_double("v", "string"))
    assert got == [d for _, d in TEXT_NUMBERS.values()]


@pytest.mark.parametrize(
    "dtype, values, want",
    [
        ("double", [3.7, 2.5, 3.5, -2.5, 3e9, float("nan"), None], [4, 2, 4, -2, None, None, None]),
        ("bigint", [1, 3_000_000_000, None], [1, None, None]),
    ],
)
def test_number_to_int(spark, dtype, values, want):
    assert evaluate(spark, values, dtype, as_int("v", dtype)) == want


def test_text_to_timestamp(spark):
    full = datetime(2018, 1, 2, 3, 4, 5)
    day = datetime(2018, 1, 2)
    cases = {
        "2018-01-02 03:04:05": full,
        "2018-01-02T03:04:05": full,
        "2018-01-02 3:4:5": full,
        "2018-01-02 03:04:05+03:00": full,
        "2018-01-02 03:04:05Z": full,
        "2018-01-02 03:04:05.123456": full.replace(microsecond=123456),
        "2018-01-02 03:04": full.replace(second=0),
        "2018-01-02": day,
        " 2018-1-2": day,
        "2018/01/02": day,
        "2018-01/02": None,
        "2018-01-02 ": None,
        "2018-01-02 03": None,
        "2018": None,
        "2018-01": None,
        "20180102": None,
        "2018-02-30": None,
        "02/01/2018": None,
        "12:00:00": None,
        "": None,
        None: None,
    }
    assert evaluate(spark, list(cases), "string", as_timestamp("v", "string")) == list(cases.values())


def test_timestamp_passes_through(spark):
    when = datetime(2018, 1, 2, 3, 4, 5)
    got = evaluate(spark, [when, None], "timestamp_ntz", as_timestamp("v", "timestamp_ntz"))
    assert got == [when, None]


def test_column_names_are_quoted(spark):
    df = spark.createDataFrame([("7",)], "`a b` string")
    assert df.selectExpr(as_int("a b", "string")).first()[0] == 7
