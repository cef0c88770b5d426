"""Cleaning rules as JVM-side column expressions (no Python per row).

Each function takes and returns a ``Column`` so the rules fuse into whole-stage codegen
with whatever projection uses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source project's cleaning rules for the
# results to match; they are listed here in the order the rules apply.
#
# Names of months and weekdays, full and short, and the other words a date text may hold:
# day part, ordinal endings, joining words, the letter before a clock, zone names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
            "mon", "tue", "wed", "thu", "fri", "sat", "sun")
DATE_WORDS = {"sept": "M", "am": "P", "pm": "P", "st": "O", "nd": "O", "rd": "O", "th": "O", "of": "J", "on": "J",
              "at": "J", "and": "J", "t": "T", "z": "Z", "utc": "Z", "gmt": "Z", "q": "Q"}
# A year of two digits lies within this many years of today.
CENTURY_WINDOW = 50
# Price text: a cell containing one of these words (case-insensitive) is free.
PRICE_FREE_WORDS = ("free", "install", "play", "third")
# Price text: a cell containing one of these digit runs is that price.
PRICE_NUMBER_WORDS = (("449", 449.0), ("499", 499.0))
# Representable range of the source's date type (nanosecond timestamps): a date outside
# it is unknown there, so it is null here too.
DATE_MIN, DATE_MAX = "1677-09-22", "2262-04-11"
# Prefix of the review date text.
POSTED_PREFIX = "Posted "
# HTML entity found inside genre names and its replacement.
GENRE_ENTITY = "&amp;"
GENRE_ENTITY_REPLACEMENT = "and"
# Label of the unknown release year in the per-year frequency table.
UNKNOWN_YEAR_LABEL = "no data"
# ---------------------------------------------------------------------------

# A decimal number: sign, exponent and outer blanks allowed. try_cast alone would also
# accept "1d", "NaN" and "Infinity".
_NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Tokens of a lower-cased date text: digit runs, letter runs, single signs.
_DATE_TOKEN = r"([0-9]+|[a-z]+|[^0-9a-z\s])"
# Kind of a digit run by its length: day-like, year, YYYYMMDD, YYYYMMDDhhmm(ss); others only as
# a fraction of a second.
_NUMBER_KINDS = {1: "d", 2: "d", 4: "y", 8: "k", 12: "e", 14: "e"}
_WORD_KINDS = {**{w: "W" for w in WEEKDAYS}, **{m: "M" for m in MONTHS + SHORT_MONTHS}, **DATE_WORDS}
_SIGNS = "-/.,:+"
# Roles of numbers outside the date, by their neighbours: C clock, F fraction, o offset.
_ROLES = ((r"(?<=:)d|d(?=:)|d(?=P)", "C"), (r"(?<=C:C\.)[dynke]", "F"), (r"(?<=[CPZF][-+])[dy]", "o"))
# The grammar over kinds. Parts of a date stand in any order that the slots can be read from.
_SEP = "[-/.,J]*"
_N = "[-/.,]*"
_TWO = "[-/,]*"                  # 6.2018 is a decimal number, no date (2018.6 is one)
_DAY_MONTH_YEAR = (f"(?:dO?{_SEP}M{_SEP}(?:y|dO?)|M{_SEP}dO?{_SEP}[yd]|M{_SEP}y{_SEP}dO?|y{_SEP}M{_SEP}dO?|y{_SEP}dO?{_SEP}M"
                   f"|y{_N}dO?{_N}dO?|dO?{_N}dO?{_N}(?:y|dO?)|k)")
_DATE = (f"(?:(?:W[.,]?)?{_DAY_MONTH_YEAR}[.,]*(?:W[.,]?)?|M{_SEP}[yd]|[yd]{_SEP}M"
         f"|y{_TWO}dO?|dO?{_TWO}y|dO?{_TWO}dO?|y|yQd|dQy)")
_CLOCK = r"(?:C:C(?::C(?:\.F)?)?P?|CP)(?:Z|Z?[-+](?:C:C|o))?"
_DATE_TEXT = rf"^(?:{_DATE}[.,]*(?:[TJ,-]*{_CLOCK})?[.,]?|{_CLOCK}[J,-]*{_DATE}[.,]*|y\.d|e|kT[dye])$"

# The spellings that the store writes itself: a named month, a day and a year; and without year.
_MONTH_NAME = "^(?:" + "|".join(MONTHS + SHORT_MONTHS) + ")"
_PLAIN_DATE = _MONTH_NAME + " [0-9]{1,2}, [0-9]{4}[.]?$"
_PLAIN_DAY = _MONTH_NAME + " (?:[0-2]?[0-9]|3[01])[.]?$"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda variable, not an expression that
    is repeated (which also keeps generated methods small)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(token: Column) -> Column:
    """One letter for a token; ``X`` for what no date holds."""
    words = F.create_map(*[F.lit(x) for pair in _WORD_KINDS.items() for x in pair])
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _NUMBER_KINDS.items() for x in pair]), F.length(token)), F.lit("n"))
    return (F.when(token.rlike("^[0-9]"), number).when(token.rlike("^[a-z]"), F.coalesce(F.element_at(words, token), F.lit("X")))
             .when(F.lit(_SIGNS).contains(token), token).otherwise(F.lit("X")))


def parse_mixed_dates(c: Column) -> Column:
    """Date text in mixed spellings -> DATE; text that is no date (or null, or no such day,
    or a day without a year) -> null.

    The lower-cased text is cut into number, word and sign tokens. Each token has a kind, and
    the kinds in a row must match a grammar of date, weekday, clock and zone. Numbers beside
    ":" or a day part are the clock's, those after its sign the offset's; what is left are the
    date's numbers, which take the slots year, month and day:

    - a named month is the month. Of two numbers the four-digit one (or one above 31) is the
      year; otherwise day then year (year then day where the month comes last);
    - without a name, three numbers read year-month-day if the first is a year or above 31,
      day-month-year if it is above 12, else month-day-year; two numbers hold one year;
    - a missing month or day counts as the first (but not beside a weekday); ``2018Q3`` is a
      quarter's first day.

    Clocks must be possible times and are dropped, as is the offset: the date is local.
    The store's own spellings (``November 5, 2011.``, and the same without a year) are read at
    once, with the grammar's result.
    Dates outside the source's representable range give null. Not read: six-digit dates,
    clocks without a date, zone names but UTC and GMT."""
    def parsed(tokens: Column) -> Column:
        kinds = F.array_join(F.transform(tokens, _kind), "")
        for pattern, role in _ROLES:
            kinds = F.regexp_replace(kinds, pattern, role)
        return _once(kinds, lambda k: F.when(k.rlike(_DATE_TEXT), _slots(tokens, k)))

    low = F.lower(c)
    d = (F.when(low.rlike(_PLAIN_DATE), _plain_date(low)).when(~low.rlike(_PLAIN_DAY), _once(
        F.regexp_extract_all(low, F.lit(_DATE_TOKEN), F.lit(1)), parsed)))
    return F.when(d.between(F.lit(DATE_MIN).cast("date"), F.lit(DATE_MAX).cast("date")), d)


def _plain_date(low: Column) -> Column:
    """The date of a lower-cased text like ``november 5, 2011.``"""
    month = (F.instr(F.lit("".join(SHORT_MONTHS)), F.substring(low, 1, 3)) + 2) / 3
    parts = (F.substring(F.split_part(low, F.lit(" "), F.lit(3)), 1, 4), month.cast("int").cast("string"),
             F.rtrim(F.split_part(low, F.lit(" "), F.lit(2)), F.lit(",")))
    return F.concat_ws("-", *parts).try_cast("date")


def _slots(tokens: Column, kinds: Column) -> Column:
    """The date of tokens whose kinds match the grammar."""
    of = lambda letters: F.filter(tokens, lambda t, i: F.lit(letters).contains(F.substr(kinds, i + 1, F.lit(1))))
    position = lambda t: F.greatest(F.array_position(F.array(*map(F.lit, SHORT_MONTHS)), F.substring(t, 1, 3)), F.lit(0)).cast("int")
    parts = F.struct(of("dyke").alias("n"), of("C").try_cast("array<int>").alias("clock"), F.array_join(of("P"), "").alias("half"),
                     position(F.get(of("M"), F.lit(0))).alias("month"), F.regexp_replace(kinds, "[^dyMQke]", "").alias("k"))
    return _once(parts, lambda p: F.when(_possible_time(p["clock"], p["half"]), _date_of(p)))


def _possible_time(clock: Column, half: Column) -> Column:
    """The first clock number is an hour (of half a day with am or pm), the others below 60."""
    hour = F.coalesce(F.get(clock, F.lit(0)), F.lit(0))
    return (hour <= F.when(half == "", 23).otherwise(12)) & F.forall(clock, lambda x: x < 60)


def _date_of(p: Column) -> Column:
    n, k, month = p["n"], p["k"], p["month"]
    at = lambda i: F.get(n, F.lit(i)).try_cast("int")
    is_year = lambda i: (F.length(F.get(n, F.lit(i))) > 2) | (at(i) > 31)
    compact = F.get(n, F.lit(0))
    digits = lambda x, a, b: F.substring(x, a, b).try_cast("int")
    ymd = lambda y, m, d, text=None: F.struct(
        _full_year(y, F.lit(None) if text is None else text).alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    num = lambda i: F.get(n, F.lit(i))
    one = F.lit(1)
    found = (F.when(k.rlike("^[ke]"), ymd(digits(compact, 1, 4), digits(compact, 5, 2), digits(compact, 7, 2)))
              .when(k == "yQd", F.when(at(1).between(1, 4), ymd(at(0), at(1) * 3 - 2, one)))
              .when(k == "dQy", F.when(at(0).between(1, 4), ymd(at(1), at(0) * 3 - 2, one)))
              .when((month > 0) & (F.size(n) == 1), F.when(is_year(0), ymd(at(0), month, one, num(0))))
              .when((month > 0) & (k.startswith("M") | k.substr(2, 1).eqNullSafe("M")),
                    F.when(is_year(1), ymd(at(1), month, at(0), num(1))).when(is_year(0), ymd(at(0), month, at(1), num(0)))
                     .otherwise(ymd(at(1), month, at(0), num(1))))
              .when(month > 0, F.when(is_year(1), ymd(at(1), month, at(0), num(1))).otherwise(ymd(at(0), month, at(1), num(0))))
              .when(F.size(n) == 1, ymd(at(0), one, one))
              .when(F.size(n) == 2, F.when(is_year(0), ymd(at(0), at(1), one, num(0))).when(is_year(1), ymd(at(1), at(0), one, num(1))))
              .when(is_year(0), ymd(at(0), at(1), at(2), num(0)))
              .when(at(0) > 12, ymd(at(2), at(1), at(0), num(2)))
              .otherwise(ymd(at(2), at(0), at(1), num(2))))
    two = lambda v, width=2: F.lpad(v.cast("string"), width, "0")
    return _once(found, lambda f: F.concat(two(f["y"], 4), F.lit("-"), two(f["m"]), F.lit("-"), two(f["d"])).try_cast("date"))


def _full_year(year: Column, text: Column) -> Column:
    """A year written with two digits moves to the century nearest to today."""
    now = F.year(F.current_date())
    near = year + now - now % 100
    near = F.when(near >= now + CENTURY_WINDOW, near - 100).when(near < now - CENTURY_WINDOW, near + 100).otherwise(near)
    return F.when((F.length(text) <= 2) & (year < 100), near).otherwise(year).cast("int")


def release_year(date_col: Column) -> Column:
    """Year of a release date, 0 when the date is unknown."""
    return F.coalesce(F.year(date_col), F.lit(0)).cast("int")


def numeric_coerce(c: Column) -> Column:
    """Tolerant numeric cast: text that is not a decimal number -> null, never an error."""
    return F.when(c.cast("string").rlike(_NUMERIC_TEXT), F.trim(c.cast("string")).try_cast("double"))


def normalize_price(c: Column) -> Column:
    """Price text -> double.

    Numbers stay as they are. Otherwise the first matching rule wins: a free word -> 0,
    then a digit run -> its price. Text matching no rule -> null (see ``unparsed_price``).
    """
    low = F.lower(c)
    out = F.when(c.rlike(_NUMERIC_TEXT), numeric_coerce(c))
    for word in PRICE_FREE_WORDS:
        out = out.when(low.contains(word), F.lit(0.0))
    for word, value in PRICE_NUMBER_WORDS:
        out = out.when(low.contains(word), F.lit(value))
    return out


def unparsed_price(c: Column) -> Column:
    """True for non-null price text that ``normalize_price`` cannot turn into a number."""
    return c.isNotNull() & normalize_price(c).isNull()


def strip_prefix(c: Column, prefix: str = POSTED_PREFIX) -> Column:
    """Remove every occurrence of a literal substring."""
    return F.replace(c, F.lit(prefix), F.lit(""))


def minutes_to_hours(c: Column) -> Column:
    """Minutes -> hours at 2 decimals. Whole minutes never sit on a rounding tie."""
    return F.bround(c / F.lit(60.0), 2)


def percent_label(ratio: Column) -> Column:
    """Ratio -> text like ``'36.36%'``, rounded as numpy does (``round2``)."""
    return F.concat(round2(ratio * F.lit(100.0)).cast("string"), F.lit("%"))


def round2(x: Column) -> Column:
    """Two decimals as numpy rounds: the scaled double to the nearest integer (ties to
    even), scaled back. Differs from decimal rounding where scaling meets a tie."""
    return F.rint(x * F.lit(100.0)) / F.lit(100.0)


def replace_in_array(arr: Column, old: str = GENRE_ENTITY, new: str = GENRE_ENTITY_REPLACEMENT) -> Column:
    """Replace a literal substring inside every element of an array of strings."""
    return F.transform(arr, lambda e: F.replace(e, F.lit(old), F.lit(new)))


def year_label(year: Column) -> Column:
    """Release year as text, the unknown year 0 shown as ``UNKNOWN_YEAR_LABEL``."""
    return F.when(year == 0, F.lit(UNKNOWN_YEAR_LABEL)).otherwise(year.cast("string"))
