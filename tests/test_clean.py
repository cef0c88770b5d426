"""Cleaning rules on inline edge-case rows (FIXTURES §4)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from ludex.functions import clean


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_mixed_dates(spark):
    good = ["2018-01-04", "Jan 2018", "2018", "November 5, 2011.", "July 15, 2011", "4 Jul, 2018", "2017-09"]
    want = [dt.date(2018, 1, 4), dt.date(2018, 1, 1), dt.date(2018, 1, 1), dt.date(2011, 11, 5),
            dt.date(2011, 7, 15), dt.date(2018, 7, 4), dt.date(2017, 9, 1)]
    assert col_values(spark, good, clean.parse_mixed_dates) == want
    more = ["November 2014", "4 July, 2018", "5 Nov 2011", "Nov 5 2011", "2018/01/04", "2018-01-04 00:00:00", "Sept 2014",
            "february 29, 2016"]
    want = [dt.date(2014, 11, 1), dt.date(2018, 7, 4), dt.date(2011, 11, 5), dt.date(2011, 11, 5), dt.date(2018, 1, 4),
            dt.date(2018, 1, 4), dt.date(2014, 9, 1), dt.date(2016, 2, 29)]
    assert col_values(spark, more, clean.parse_mixed_dates) == want
    assert col_values(spark, ["February 30, 2016", "Novembre 2014", "13/2014"], clean.parse_mixed_dates) == [None] * 3
    bad = ["September 3.", "Soon..", "Q2 2017", "", None]
    assert col_values(spark, bad, clean.parse_mixed_dates) == [None] * 5


# Spellings that the source's parse (the pandas one) reads; compared with it below.
SPELLINGS = [
    "Thu, 4 Jan 2018", "4/1/2018", "01/04/2018", "31/12/2018", "4th July 2018", "2018.01.04", "20180104", "Jan-04-2018", "04-Jan-2018",
    "2018 Jan 4", "2018-01-04T12:30:00+02:00", "Jul 4, 2018 12:00 PM", "1/4/18", "2018Q1", "4Q2018", "1.4.2018", "4 1 2018", "Jan 4 18",
    "July of 2018", "4th of July, 2018", "12:30 Jan 4 2018", "Jan 2018 4", "1-2018", "Jan 4, 2018 12PM", "20180104T1230", "20180104123000",
    "2018-01-04 12:30:00.123456", "2018-01-04 12:30:00 UTC", "Tuesday 2018-01-04", "2018-01-04 Thu", "Jan/4/2018", "2018-Jan", "5 Nov, 2011.",
    "2018-01-04 12:00-05", "2018-01-04 12:00 -0500", "Jan 99", "  2018-01-04  ", "29 February 2016"]
# And texts that it does not read.
NO_DATES = ["13/2014", "2018/13/01", "2018-02-30", "Jan 4, 2018 25:00", "Jan 4, 2018 12:61", "Jan 4, 2018 13:00 PM", "2018-004", "1 Jan", "Jan", "4",
            "45", "123", "12345", "Coming 2018", "2018 or 2019", "Thursday", "9999-01-01", "Jan 0 2018", "Jan 32 2018", "0/1/2018", "Q1 2018",
            "12-2018-01", "", "   ", "Friday May 2008", "29 February 2015", "6.2018"]


def source_date(text):
    """What the source's parse gives: a date, or None."""
    got = pd.to_datetime(pd.Series([text]), format="mixed", errors="coerce")[0]
    return None if pd.isna(got) else got.date()


def test_mixed_dates_equal_the_sources_parse(spark):
    assert all(source_date(x) for x in SPELLINGS) and not any(source_date(x) for x in NO_DATES)
    assert col_values(spark, SPELLINGS, clean.parse_mixed_dates) == [source_date(x) for x in SPELLINGS]
    assert col_values(spark, NO_DATES, clean.parse_mixed_dates) == [None] * len(NO_DATES)


def test_made_up_spellings_equal_the_sources_parse(spark):
    rng = random.Random(3)
    months = ["January", "Feb", "March", "apr", "MAY", "June", "Jul", "August", "Sept", "November", "Dec"]
    texts = []
    for _ in range(1500):
        y, d = str(rng.randint(1980, 2030)), str(rng.randint(1, 31))
        m = rng.choice([rng.choice(months), str(rng.randint(1, 13)), str(rng.randint(1, 12)).zfill(2)])
        if not m.isdigit():
            d += rng.choice(["", "", "th"])
        text = rng.choice([" ", "-", "/", ", "]).join(rng.choice([[y, m, d], [d, m, y], [m, d, y], [m, y], [y, m]]))
        texts.append(text + rng.choice(["", "", " 12:30", " 23:59:59", ", 1:02 pm", "T00:00+05:30" if text[-1].isdigit() else ""]))
    assert col_values(spark, texts, clean.parse_mixed_dates) == [source_date(x) for x in texts]


def test_release_year_unknown_is_zero(spark):
    vals = col_values(spark, ["2018", "Soon.."], lambda c: clean.release_year(clean.parse_mixed_dates(c)))
    assert vals == [2018, 0]


def test_price_rules(spark):
    texts = ["4.99", "1449.0", "Free To Play", "Install Now", "Starting at $499.00", None, "odd text",
             "Starting at $449.00", "Third-party", "NaN", "1d"]
    got = col_values(spark, texts, clean.normalize_price)
    assert got == [4.99, 1449.0, 0.0, 0.0, 499.0, None, None, 449.0, 0.0, None, None]
    flags = col_values(spark, texts, clean.unparsed_price)
    assert [t for t, f in zip(texts, flags) if f] == ["odd text", "NaN", "1d"]


def test_numbers_with_sign_and_exponent(spark):
    texts = ["1d", "1f", "-1.0", "1E3", " 2.5 ", "+.5", "Infinity", "1.2.3", None]
    want = [None, None, -1.0, 1000.0, 2.5, 0.5, None, None, None]
    assert col_values(spark, texts, clean.numeric_coerce) == want
    assert col_values(spark, texts, clean.normalize_price) == want


def test_rounding_is_that_of_numpy(spark):
    assert col_values(spark, [0.575, 1.015, 100 * 23 / 4000, 2.675], clean.round2, "double") == [0.57, 1.01, 0.57, 2.68]


def test_percent_label_half_even(spark):
    ratios = [1 / 32, 3 / 32, 1 / 3, 0.0, 1.0]
    got = col_values(spark, ratios, clean.percent_label, "double")
    assert got == ["3.12%", "9.38%", "33.33%", "0.0%", "100.0%"]


def test_strip_prefix_and_hours(spark):
    assert col_values(spark, ["Posted November 5, 2011."], clean.strip_prefix) == ["November 5, 2011."]
    assert col_values(spark, [7, 90, None], clean.minutes_to_hours, "bigint") == [0.12, 1.5, None]


def test_replace_in_array(spark):
    df = spark.createDataFrame([(["Action&amp;Adventure", "RPG"],), (None,)], "g array<string>")
    got = [r[0] for r in df.select(clean.replace_in_array(F.col("g"))).collect()]
    assert got == [["ActionandAdventure", "RPG"], None]


def test_year_label(spark):
    assert col_values(spark, [0, 2012], clean.year_label, "int") == ["no data", "2012"]


def test_dates_outside_source_range_are_null(spark):
    got = col_values(spark, ["1677-09-21", "1677-09-22", "2262-04-11", "2262-04-12", "0100-01-01"],
                     lambda c: clean.parse_mixed_dates(c).cast("string"))
    assert got == [None, "1677-09-22", "2262-04-11", None, None]
