import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.config import Settings
from parchment.functions import fuzzy, text
from parchment.functions.dates import parse_date
from parchment.functions.numbers import money_values, parse_number
from parchment.sources import files

# Texts and what they must give.
NUMBERS = [
    ("1.234,56 €", 1234.56), ("1,234.56", 1234.56), ("12,50", 12.5), ("-3,00", -3.0), ("RM 9.00", 9.0), ("$8.20", 8.2), ("0.250", 0.25), ("7", 7.0),
    ("", None), ("EUR", None), (None, None), ("9.00.", 900.0), ("Fr. 9.00", 900.0), ("1,234.5,6", None), ("€ -3,00", 3.0), ("(3.00)", -3.0), ("5-", -5.0),
    ("1.234.567", 1234567.0), ("1.234", 1234.0), (".250", 0.25), ("5.", 5.0),
]
DATES = [
    ("2018-12-25", (2018, 12, 25)), ("25/12/2018", (2018, 12, 25)), ("12-01-19", (2019, 1, 12)), ("05 MAR 2018", (2018, 3, 5)), ("28 MAR 18", (2018, 3, 28)),
    ("20180304", (2018, 3, 4)), ("12/28/2017", (2017, 12, 28)), ("25/12/2018 8:13:39 PM", (2018, 12, 25)), ("05 MAR 2018 18:24", (2018, 3, 5)),
    ("05 Mar 2018 6:24 PM", (2018, 3, 5)), ("2018-12-25T18:24:00", (2018, 12, 25)), ("Mar 5, 2018 18:24", (2018, 3, 5)), ("not a date", None), ("25/12/85", (1985, 12, 25)), ("31/02/2018", None), (None, None),
]


def column(spark, values, body):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[1] for r in rows.select("i", body(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    assert column(spark, [x for x, _ in NUMBERS], parse_number) == [y for _, y in NUMBERS]


def test_dates(spark):
    assert column(spark, [x for x, _ in DATES], parse_date) == [y and datetime.date(*y) for _, y in DATES]


def test_texts(spark):
    assert column(spark, [" a ", "None", "n/a", "", None, "x"], text.clean_text) == ["a", None, None, None, None, "x"]
    assert column(spark, ["€", "rm", "US$", "sek", None], text.currency) == ["EUR", "MYR", "USD", "SEK", None]
    assert column(spark, ["../../etc/passwd", "my receipt (1).jpg", None], text.safe_file_name) == ["passwd", "my receipt _1_.jpg", "upload"]
    assert column(spark, ["total 9.00 and 1,234.50", "9.000", "25/12/2018"], money_values) == [[9.0, 1234.5], [], []]
    assert column(spark, ["NO.53 55,57 & 59"], text.compact) == ["no535557&59"]


def test_signatures(spark):
    rows = spark.createDataFrame([(".pdf", bytearray(b"%PDF-1.7")), (".PNG", bytearray(b"\x89PNG\r\n\x1a\n")), (".jpg", bytearray(b"\xff\xd8\xff")), (".pdf", bytearray(b"text")), (".txt", bytearray(b"%PDF"))], "s string, h binary")
    assert [r[0] for r in rows.select(files.has_valid_signature(F.col("s"), F.col("h"))).collect()] == [True, True, True, False, False]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_the_plain_definition(a, b):
    want = 100.0 if not a and not b else 200.0 * subsequence(a, b) / (len(a) + len(b))
    assert fuzzy.ratio(a, b) == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=1, max_size=6), st.text("ab", min_size=1, max_size=12))
def test_partial_ratio_is_the_best_part(a, b):
    if len(a) > len(b):
        a, b = b, a
    parts = {b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1) if j - i == len(a) or (j - i < len(a) and (i == 0 or j == len(b)))}
    best = max(fuzzy.ratio(a, p) for p in parts)
    if len(a) == len(b):
        best = max(best, max(fuzzy.ratio(b, p) for p in {a[:i] for i in range(1, len(a) + 1)} | {a[-i:] for i in range(1, len(a))}))
    assert fuzzy.partial_ratio(a, b) == pytest.approx(best)


@settings(max_examples=100, deadline=None)
@given(st.text("abc é", min_size=1, max_size=9), st.lists(st.text("abcd é", min_size=9, max_size=30), min_size=1, max_size=5))
def test_many_parts_at_once_are_the_best_parts(short, longs):
    assert fuzzy.best_parts(short, longs).tolist() == pytest.approx([fuzzy.best_part(short, x) for x in longs])


def test_longest_needles_and_nulls(spark):
    needle = "".join(chr(97 + i * 7 % 26) for i in range(64))
    rows = [(needle, "x" + needle[:60] + "yyyy" + needle), (needle, "z" * 80), (needle + "q", needle + "pq"), (None, "a"), ("abcd", None), ("abcd", "abxcd"), ("abcd", "abc"), ("abcd", "dcba")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").coalesce(1).select(fuzzy.fuzzy_text_udf("x", "y")).collect()]
    want = [None if x is None or y is None else round(fuzzy.partial_ratio(x, y) if len(y) >= len(x) else fuzzy.ratio(x, y), 1) for x, y in rows]
    assert got == want


def test_settings_from_environment():
    got = Settings.from_env(environ={"PARCHMENT_MAX_FILES": "3", "PARCHMENT_USE_FALLBACK": "no"})
    assert got.max_files == 3 and got.use_fallback is False and got.max_pages == Settings().max_pages
