"""Numbers, dates, normalised texts and best windows for queries written as SQL text.

The scalar functions are SQL functions over built-in ones, so that they stay in the JVM and Catalyst sees through them;
they read what the column functions of the same names read. `best_windows` is a table function in Python,
which gets one page a call.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from parchment.config import DEFAULTS
from parchment.functions.dates import FORMATS, MONTHS, TRAILING_TIME
from parchment.functions.search import best_windows


def reading(pattern: str, year: int, month: int, day: int, named: bool) -> str:
    part = [f"regexp_extract(x, r'{pattern}', {i})" for i in (year, month, day)]
    number = f"parchment_month({part[1]})" if named else f"try_cast({part[1]} AS INT)"
    return f"CASE WHEN x RLIKE r'{pattern}' THEN parchment_day(parchment_year({part[0]}), {number}, try_cast({part[2]} AS INT)) END"


def definitions() -> dict[str, str]:
    """Head and body of each function; later ones use earlier ones."""
    months = ", ".join(f"'{name}', {i}" for i, m in enumerate(MONTHS, 1) for name in dict.fromkeys((m, m[:3])))
    return {
        "strip_text(x STRING) RETURNS STRING": r"regexp_replace(x, r'(?U)^\s+|\s+$', '')",
        "collapse_text(x STRING) RETURNS STRING": r"strip_text(regexp_replace(x, r'(?U)\s+', ' '))",
        "loose_text(x STRING) RETURNS STRING": "lower(collapse_text(x))",
        "parchment_decimal(head STRING, tail STRING) RETURNS STRING": "concat(CASE WHEN head = '' THEN '0' ELSE head END, '.', CASE WHEN tail = '' THEN '0' ELSE tail END)",
        "parchment_single(digits STRING, head STRING, tail STRING, parts INT) RETURNS STRING": """CASE
            WHEN parts > 2 OR length(tail) = 3 AND head NOT IN ('', '0') THEN regexp_replace(digits, '[.,]', '') ELSE parchment_decimal(head, tail) END""",
        "parchment_plain(digits STRING) RETURNS STRING": """CASE
            WHEN contains(digits, '.') AND contains(digits, ',') THEN CASE
                WHEN instr(reverse(digits), ',') < instr(reverse(digits), '.') THEN replace(replace(digits, '.', ''), ',', '.')
                ELSE replace(digits, ',', '') END
            WHEN contains(digits, '.') OR contains(digits, ',')
                THEN parchment_single(digits, split(digits, '[.,]')[0], element_at(split(digits, '[.,]'), -1), size(split(digits, '[.,]')))
            ELSE digits END""",
        "parchment_value(digits STRING) RETURNS DOUBLE": r"CASE WHEN digits RLIKE r'\d' THEN try_cast(parchment_plain(digits) AS DOUBLE) END",
        "parchment_signed(bare STRING, value DOUBLE) RETURNS DOUBLE": """CASE
            WHEN startswith(bare, '-') OR endswith(bare, '-') OR startswith(bare, '(') AND endswith(bare, ')') THEN -value ELSE value END""",
        "parse_number(x STRING) RETURNS DOUBLE": r"parchment_signed(strip_text(x), parchment_value(regexp_replace(strip_text(x), r'[^\d.,]', '')))",
        "parchment_month(x STRING) RETURNS INT": f"try_element_at(map({months}), lower(x))",
        "parchment_year(x STRING) RETURNS INT": "CASE WHEN length(x) = 2 THEN try_cast(x AS INT) + CASE WHEN try_cast(x AS INT) >= 69 THEN 1900 ELSE 2000 END ELSE try_cast(x AS INT) END",
        "parchment_day(y INT, m INT, d INT) RETURNS DATE": "CASE WHEN y >= 1900 THEN CAST(try_make_timestamp(y, m, d, 0, 0, 0) AS DATE) END",
        "parchment_date(x STRING) RETURNS DATE": f"coalesce({', '.join(reading(*x) for x in FORMATS)})",
        "parchment_dates(x STRING) RETURNS DATE": rf"coalesce(parchment_date(x), parchment_date(regexp_replace(regexp_replace(x, r'{TRAILING_TIME}', ''), r'^[ ,]+|[ ,]+$', '')), parchment_date(split(x, ' ')[0]))",
        "parse_date(x STRING) RETURNS DATE": "parchment_dates(collapse_text(x))",
    }


class BestWindows:
    """The best window of a page for each text wanted on it.

    To be called with a table of (doc_id long, page int, line_no int, text string, y0 double, y1 double, wanted string),
    partitioned by doc_id and page and ordered by line_no: a row with `wanted` asks for that text, any other one is a line
    of the page with the upper and lower edge of its box. Texts are compared as they come, so pass
    them through loose_text. Lines without text stand for nothing; an empty or null `wanted`, and a page without lines,
    give no row. Repeated wishes give a row each.
    """

    def __init__(self) -> None:
        self.key: tuple[int, int] | None = None
        self.lines: list[tuple[int, str, float, float]] = []
        self.wanted: list[str] = []

    def eval(self, row: Row) -> None:
        self.key = row["doc_id"], row["page"]
        if row["wanted"]:
            self.wanted.append(row["wanted"])
        elif row["wanted"] is None and row["text"]:
            self.lines.append((row["line_no"], row["text"], row["y0"] or 0.0, row["y1"] or 0.0))

    def terminate(self) -> Iterator[tuple]:
        if not self.lines or not self.wanted:
            return
        numbers, texts, tops, bottoms = (list(x) for x in zip(*self.lines, strict=True))
        n = len(self.wanted)
        found = best_windows(self.wanted, [texts] * n, [tops] * n, [bottoms] * n, DEFAULTS.window_lines)
        for wanted, best in zip(self.wanted, found, strict=True):
            if best is not None:
                at, size, score = best
                yield *self.key, wanted, numbers[at], size, " ".join(texts[at : at + size]), float(score)


RESULT = "doc_id long, page int, wanted string, line_no int, lines int, text string, score double"


def register(spark: SparkSession) -> None:
    """Make strip_text, collapse_text, loose_text, parse_number, parse_date and best_windows known to SQL of this session."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("best_windows", udtf(BestWindows, returnType=RESULT))
