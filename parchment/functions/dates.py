"""Dates in texts: eighteen formats, day before month, month before day only where nothing else fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import collapse, let

# Date tokens and a time at the end.
DATE_TOKEN = r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{2,4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}"
TRAILING_TIME = r"(?iU)[\sT,]+\d{1,2}[:.]\d{2}(?:[:.]\d{2})?\s*(?:[ap]\.?m\.?|hrs?|h)?\s*$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MAY_HOLD_DATE = r"\d[./-]\d{1,2}[./-]\d|(?i:" + "|".join(x[:3] for x in MONTHS) + ")"
# (pattern, group of the year, of the month, of the day, whether the month is a name), in the order they are tried;
# the patterns exclude each other but for the last.
FORMATS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3, False),
    (r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})$", 4, 3, 1, False),
    (r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})$", 1, 3, 4, False),
    (r"^(\d{1,2}) ([A-Za-z]+) (\d{4}|\d{2})$", 3, 2, 1, True),
    (r"^([A-Za-z]+) (\d{1,2}), (\d{4})$", 3, 1, 2, True),
    (r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$", 1, 2, 3, False),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", 3, 1, 2, False),
)
SHORTEST = 6  # characters of a date in any format


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date if it exists and its year is 1900 or later; two-digit years from 69 on are of the last century."""

    def made(full: Column) -> Column:
        return F.when(full >= 1900, F.try_make_timestamp(full, month.try_cast("int"), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))

    def whole(given: Column) -> Column:
        y = given.try_cast("int")
        return F.when(F.length(given) == 2, F.when(y >= 69, y + 1900).otherwise(y + 2000)).otherwise(y)

    return let(let(year, whole), made)


def month_number(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in dict.fromkeys((m, m[:3])) for x in (x, i)])
    return F.element_at(names, F.lower(name))


def by_format(text: Column) -> Column:
    """The date that the first fitting format reads; formats with a name of a month and those without have no text in common."""

    def reading(pattern: str, year: int, month: int, day: int, named: bool) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, i) for i in (year, month, day))
        return F.when(text.rlike(pattern), day_of(y, month_number(m) if named else m, d))

    named, numeric = (F.coalesce(*(reading(*x) for x in FORMATS if x[4] == kind)) for kind in (True, False))
    return F.when(F.length(text) >= SHORTEST, F.when(text.rlike("[A-Za-z]"), named).otherwise(numeric))


def parse_date(text: Column) -> Column:
    """Date or null: of the whole text, else without a time at its end, else of its first word."""

    def read(whole: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(whole, TRAILING_TIME, ""), r"^[ ,]+|[ ,]+$", "")
        parts = (let(x, lambda part: F.when(part != whole, by_format(part))) for x in (bare, F.substring_index(whole, " ", 1)))
        return F.coalesce(by_format(whole), *parts)

    return let(collapse(text), read)


def may_hold_date(text: Column) -> Column:
    """False where no token of the text is a date: numbers are none without two separators, words none without a month's first letters."""
    return text.rlike(MAY_HOLD_DATE)


def date_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE_TOKEN), F.lit(0))
