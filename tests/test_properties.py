"""Randomised equivalence checks for the optimised expressions."""

import random
import re

from pyspark.sql import functions as F

from ludex.functions import clean

MONTHS = ["January", "Jan", "February", "Feb", "May", "September", "Sep", "Sept", "june", "DEC", "Foo"]
PIECES = ["2018", "1999", "+12018", "7", "07", "31", "32", "0", "-", ", ", " ", ".", ",", "Q2", "Soon", "", "-1"]


def _random_texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(MONTHS + PIECES) for _ in range(rnd.randint(1, 5))]
        out.append("".join(parts))
    # plus well-formed values of every format
    out += ["2018-01-04", "Jan 2018", "2018", "November 5, 2011.", "July 15, 2011", "Nov 5, 2011",
            "4 Jul, 2018", "2017-09", "2017-9", "2018-1-4", "May 5, 2011", "5 May, 2011"]
    return out


# Spellings that the source's date parse reads, as formats.
FORMATS = ("yyyy-MM-dd", "MMM yyyy", "yyyy", "MMMM d, yyyy.", "MMMM d, yyyy", "MMM d, yyyy", "d MMM, yyyy", "yyyy-MM")


def test_patterns_never_change_a_parse(spark):
    """Where a format parses a text, the patterns give the same date. (Digit runs longer than
    four can make the format parser fail the task, so the comparison leaves them out.)"""
    texts = [t for t in _random_texts(4000, 7) if not re.search(r"[0-9]{5,}", t)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    s = F.col("s")
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS]).cast("date")
    in_range = F.when(parsed.between(F.lit(clean.DATE_MIN).cast("date"), F.lit(clean.DATE_MAX).cast("date")), parsed)
    out = df.select("s", clean.parse_mixed_dates(s).alias("g"), in_range.alias("u")).where("u is not null")
    diff = out.where(~F.col("g").eqNullSafe(F.col("u"))) \
              .select("s", F.col("g").cast("string"), F.col("u").cast("string")).collect()
    assert diff == []
    assert out.count() >= 12


def test_overflowing_years_are_null_not_errors(spark):
    texts = ["201819992018", "+12018", "+999999999", "Jan 2018201820182018", "99999999999-01-01",
             "November 5, 20182018."] + _random_texts(2000, 3)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = df.select("s", clean.parse_mixed_dates(F.col("s")).cast("string").alias("d")).collect()
    assert all(r.d is None or clean.DATE_MIN <= r.d <= clean.DATE_MAX for r in out)
    assert all(r.d is None for r in out[:6])


def test_price_rules_match_plain_python(spark):
    rnd = random.Random(11)
    words = ["Free", "free to play", "Install", "Play", "Third", "449", "499", "4.99", "1449.0", "12", "$",
             "Starting at", " ", "x", "1d", "NaN", ".", "0"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(2000)]

    def py_rule(t):
        if re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", t):
            return float(t)
        low = t.lower()
        for w in clean.PRICE_FREE_WORDS:
            if w in low:
                return 0.0
        for w, v in clean.PRICE_NUMBER_WORDS:
            if w in low:
                return v
        return None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.p for r in df.select("i", clean.normalize_price(F.col("s")).alias("p")).collect()}
    assert all(got[i] == py_rule(t) for i, t in enumerate(texts))
