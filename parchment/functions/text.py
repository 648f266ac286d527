"""Cleaning, normalising and displaying text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "nothing", and currency names by symbol.
NOTHING = ("null", "none", "n/a")
CURRENCIES = {"€": "EUR", "EURO": "EUR", "$": "USD", "US$": "USD", "£": "GBP", "RM": "MYR", "FR.": "CHF"}


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body names it; keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space (of any alphabet) at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """Stripped; empty texts and words for nothing become null."""
    return let(strip(text), lambda bare: F.when((bare != "") & ~F.lower(bare).isin(*NOTHING), bare))


def currency(text: Column) -> Column:
    """Upper-case code; known symbols become codes, the rest passes."""
    names = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return let(F.upper(clean_text(text)), lambda upper: F.coalesce(F.element_at(names, upper), upper))


def loose(text: Column) -> Column:
    return F.lower(collapse(text))


def compact(text: Column) -> Column:
    """Lower case, letters, digits and & only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}&]", "")


def whole_word(needle: Column, haystack: Column) -> Column:
    return F.regexp_like(haystack, F.concat(F.lit(r"(?<![0-9a-z])\Q"), needle, F.lit(r"\E(?![0-9a-z])")))


def safe_file_name(name: Column) -> Column:
    """Last path part with unusual characters as _, without spaces and dots at the ends; 'upload' if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"[^/]*$", 0)
    kept = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._ -]", "_"), r"^[ .]+|[ .]+$", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", "upload").otherwise(kept)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def show_money(value: Column, commas: bool = False) -> Column:
    """Two decimals; from whole cents, so that every engine writes the same digits."""
    cents = F.round(F.abs(value) * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    digits = F.format_number(whole, 0) if commas else whole.cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), digits, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def show_quantity(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def display(kind: Column, text: Column, number: Column, day: Column) -> Column:
    """A value as people see it: money, whole quantities, ISO dates, escaped text; a dash for nothing."""
    shown = F.when(kind == "quantity", show_quantity(number)).when(number.isNotNull(), show_money(number, commas=True)).when(day.isNotNull(), F.date_format(day, "yyyy-MM-dd")).otherwise(escape_html(text))
    return F.when(F.coalesce(shown, F.lit("")) == "", "—").otherwise(shown)
