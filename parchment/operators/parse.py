"""Model answers to typed invoices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.dates import parse_date
from parchment.functions.numbers import parse_number
from parchment.functions.text import clean_text, currency, let

PROMPTS = ("v1", "v2", "v3")
TEXTS = ("vendor_name", "vendor_address", "invoice_number", "invoice_date", "currency", "subtotal", "tax", "total_amount")
ITEM_TEXTS = ("description", "quantity", "unit_price", "total")
LENIENT = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}


def json_text(raw: Column) -> Column:
    """From the first { to the last }, which leaves code fences around it out; null if there is none."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def lenient_json(text: Column) -> Column:
    """Variant of an object with repeated keys, of which the last counts, or with NaN and infinite numbers; null of anything else.

    The strict reader takes neither. Only known fields are read; they may hold anything but an object with
    repeated keys, and line items must be objects.
    """
    item = ", ".join(f"{x}: variant" for x in ITEM_TEXTS)

    def read(items: str) -> Column:
        fields = ", ".join(f"{x}: variant" for x in TEXTS)
        # In brackets, so that anything after the object is an error.
        return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{fields}, line_items: {items}>>", LENIENT)

    def again(items: str) -> Column:
        return let(F.get(read(items), F.lit(0)), lambda found: F.when(found["line_items"].isNotNull(), F.to_variant_object(found)))

    def by_items(rows: Column) -> Column:
        found = F.get(rows, F.lit(0))
        given = F.substring(found["line_items"], 1, 1)
        none = F.when(given.isNull() & (F.size(rows) == 1), F.to_variant_object(found))
        return F.when(given == "[", again(f"array<struct<{item}>>")).when(given == "{", again(f"struct<{item}>")).otherwise(none)

    return let(read("string"), by_items)


def parsed_json(raw: Column) -> Column:
    """Variant: strict first; if that fails, without trailing commas and with None as null; else with repeated keys and NaN."""

    def read(text: Column) -> Column:
        repaired = F.regexp_replace(F.regexp_replace(text, r",(\s*[}\]])", "$1"), r"(?<=[:\[,\s])None(?=\s*[,}\]])", "null")
        return F.coalesce(F.try_parse_json(text), let(repaired, lambda other: otherwise(text, other)))

    def otherwise(text: Column, other: Column) -> Column:
        changed = other != text
        return F.coalesce(F.when(changed, F.try_parse_json(other)), lenient_json(text), F.when(changed, lenient_json(other)))

    return let(json_text(raw), read)


def scalar(answer: Column, path: str) -> Column:
    return F.try_variant_get(answer, f"$.{path}", "string")


def number(answer: Column, path: str) -> Column:
    """JSON numbers as they are, texts by the rules for texts; other JSON has no number."""

    def read(value: Column) -> Column:
        given = F.try_variant_get(value, "$", "double")
        return let(F.schema_of_variant(value), lambda shape: F.when(shape == "STRING", parse_number(F.try_variant_get(value, "$", "string"))).when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), given))

    return let(F.try_variant_get(answer, f"$.{path}", "variant"), read)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def given_items(answer: Column) -> Column:
    """Line items as given, an array of variants: a single object counts as one, nothing as none, anything else as null."""
    none = F.expr("cast(array() as array<variant>)")

    def read(raw: Column) -> Column:
        listed = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.when(is_object(raw), F.array(raw)))
        return F.when(raw.isNull() | F.is_variant_null(raw), none).otherwise(listed)

    return let(F.try_variant_get(answer, "$.line_items", "variant"), read)


def clean_item(item: Column) -> Column:
    return F.struct(
        clean_text(scalar(item, "description")).alias("description"),
        number(item, "quantity").alias("quantity"),
        number(item, "unit_price").alias("unit_price"),
        number(item, "total").alias("total"),
    )


def faults(answer: Column, items: Column) -> Column:
    """What is wrong with an answer, the first three faults; null if nothing is."""
    bad = F.transform(items, lambda item, i: F.when(item.isNull() | F.is_variant_null(item) | ~is_object(item), F.concat(F.lit("line_items."), i.cast("string"), F.lit(": must be an object"))))
    bad = F.slice(F.array_compact(bad), 1, 3)
    found = F.when(items.isNull(), "line_items: must be a list of objects").when(F.size(bad) > 0, F.array_join(bad, "; "))
    return F.when(answer.isNull(), "no JSON object in the answer").otherwise(F.concat(F.lit("JSON does not match the schema: "), found))


def invoice(answer: Column, only: Sequence[str] | None = None) -> Column:
    """Struct of the typed fields, or of those named, and `error`; with an error all fields are null."""

    def typed(items: Column) -> Column:
        return let(faults(answer, items), lambda error: cleaned(items, error))

    def cleaned(items: Column, error: Column) -> Column:
        fields = {x: clean_text(scalar(answer, x)) for x in ("vendor_name", "vendor_address", "invoice_number")}
        fields |= {"invoice_date": parse_date(scalar(answer, "invoice_date")), "currency": currency(scalar(answer, "currency"))}
        fields |= {x: number(answer, x) for x in ("subtotal", "tax", "total_amount")}
        fields["line_items"] = F.transform(items, clean_item)
        return F.struct(*(F.when(error.isNull(), value).alias(name) for name, value in fields.items() if only is None or name in only), error.alias("error"))

    return let(given_items(answer), typed)


def clean_answers(answers: DataFrame, second: DataFrame | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, invoice fields, n_attempts, error) of answers (doc_id, prompt_version, raw).

    `second` has answers of a repeated request, at most one per document; it counts where the
    first has an error. An answer that is no JSON object, or whose line items are neither object
    nor list of objects, has an error and null fields. Unknown keys are dropped. `only` names the
    fields to type, if not all.
    """
    typed = partial(invoice, only=only)
    first = answers.select("doc_id", parsed_json(F.col("raw")).alias("answer"))
    # The id makes a struct non-deterministic, so the optimiser neither copies nor moves its parsing.
    fixed = F.monotonically_increasing_id() >= 0
    rows = first.select("doc_id", F.when(fixed, let(F.col("answer"), lambda a: typed(a))).alias("invoice"))
    if second is None:
        return rows.select("doc_id", "invoice.*").withColumn("n_attempts", F.lit(1))
    rows = rows.join(second.select("doc_id", F.col("raw").alias("again")), "doc_id", "left")
    repeated = F.col("invoice.error").isNotNull() & F.col("again").isNotNull()
    rows = rows.select("doc_id", "invoice", F.when(fixed & repeated, let(parsed_json(F.col("again")), lambda a: typed(a))).alias("other"))
    taken = F.col("other").isNotNull()
    return rows.select("doc_id", F.when(taken, F.col("other")).otherwise(F.col("invoice")).alias("invoice"), F.when(taken, 2).otherwise(1).alias("n_attempts")).select("doc_id", "invoice.*", "n_attempts")


def prompt_prefix(n_pages: Column) -> Column:
    """What a request says about several pages of one document."""
    return F.when(n_pages > 1, F.concat(F.lit("The images are "), n_pages.cast("string"), F.lit(" pages of one document. "))).otherwise("")


def check_prompt(version: str) -> str:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version {version!r}; known: {', '.join(PROMPTS)}")
    return version
