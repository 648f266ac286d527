"""Numbers in texts, European and English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import let, strip

# Number tokens, and money with exactly two decimals.
NUMBER_TOKEN = r"-?\d[\d.,]*"
MONEY_TOKEN = r"(?<![\d.,])-?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?!\d)"
EASY_NUMBER = r"^(?:[0-9][0-9,]*\.[0-9]{1,2}|[0-9]+)\z"  # commas can only be thousands
ONLY_AMOUNT = r"(?U)^\s*(?:rm|\$|€|£|usd|myr)?\s*[\d.,]+\s*\w?\s*$"


def parse_number(text: Column) -> Column:
    """Double or null.

    The later of both separators is the decimal one; a single kind is thousands if it
    repeats or has three digits after a leading part other than nothing or 0. A minus at
    either end of the text, or brackets around it, makes the number negative.
    """

    def read(given: Column) -> Column:
        hard = let(strip(given), lambda bare: let(F.regexp_replace(bare, r"[^\d.,]", ""), lambda digits: signed(bare, digits)))
        return F.when(given.rlike(EASY_NUMBER), F.translate(given, ",", "").try_cast("double")).otherwise(hard)

    return let(text, read)


def signed(bare: Column, digits: Column) -> Column:
    negative = bare.startswith("-") | bare.endswith("-") | (bare.startswith("(") & bare.endswith(")"))
    has_dot, has_comma = digits.contains("."), digits.contains(",")
    comma_last = F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")
    english = F.replace(digits, F.lit(","), F.lit(""))
    european = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    parts = F.split(digits, "[.,]")
    head, tail = F.element_at(parts, 1), F.element_at(parts, -1)
    single = F.when((F.size(parts) > 2) | (F.length(tail) == 3) & ~head.isin("", "0"), F.array_join(parts, ""))
    single = single.otherwise(F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), F.when(tail == "", "0").otherwise(tail)))
    plain = F.when(has_dot & has_comma, F.when(comma_last, european).otherwise(english)).when(has_dot | has_comma, single).otherwise(digits)
    value = F.when(digits.rlike(r"\d"), plain).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(0))


def money_values(text: Column) -> Column:
    """All amounts with exactly two decimals, left to right."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(MONEY_TOKEN), F.lit(0)), parse_number), lambda x: x.isNotNull())
