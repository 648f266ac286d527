"""Answers and OCR lines to results: parse, match, repair, warn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.config import DEFAULTS, Settings
from parchment.operators.fallback import apply_fallback
from parchment.operators.match import by_document, long_fields, match_fields
from parchment.operators.parse import clean_answers
from parchment.sources.files import truncation_warning
from parchment.sources.tables import joined, written
from parchment.types import FIELD_LABELS


def extract(answers: DataFrame, lines: DataFrame, settings: Settings = DEFAULTS, second: DataFrame | None = None, ocr_errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, fields) of all answers; a document that fails is a row with an error and has no fields.

    documents: doc_id, error, n_pages, n_lines, warnings; fields: one row per field, repaired.
    A document without OCR lines keeps its values at low confidence, without a warning for them. `ocr_errors`
    (doc_id, ocr_error) has documents whose OCR failed: they have no lines, and a warning after that on truncation.
    """
    invoices = written(clean_answers(answers, second), "invoices")
    lines = written(lines.select("doc_id", "page", "line_no", "text", "box", "confidence"), "lines")
    if ocr_errors is not None:
        lines = lines.join(ocr_errors.select("doc_id"), "doc_id", "left_anti")
    good = invoices.where("error IS NULL")
    used = lines.where((F.col("page") < settings.max_pages) & (F.col("confidence") >= settings.min_ocr_confidence))
    fields = apply_fallback(match_fields(long_fields(by_document(good)), used, settings), used, settings)
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"), F.count("*").alias("n_lines"))
    order = F.create_map(*[F.lit(x) for i, name in enumerate(FIELD_LABELS) for x in (name, i)])
    label = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    at = F.element_at(order, F.col("field"))
    top = fields.where("item_no IS NULL").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct((-at).alias("at"), F.col("warning").alias("text"))))).alias("said"),
        F.array_sort(F.collect_list(F.when(F.col("confidence") == "low", F.struct(at.alias("at"), F.element_at(label, F.col("field")).alias("text"))))).alias("low"),
    )
    rows = joined(joined(invoices.select("doc_id", "error"), pages, "doc_id", "left"), top, "doc_id", "left")
    unread = F.lit(None).cast("string")
    if ocr_errors is not None:
        rows = rows.join(ocr_errors.select("doc_id", "ocr_error"), "doc_id", "left")
        unread = F.concat(F.lit("OCR failed, so no confidence could be checked: "), F.col("ocr_error"))
    low = F.when((F.size("low") > 0) & (F.coalesce("n_lines", F.lit(0)) > 0), F.concat(F.lit("Not found on the document: "), F.array_join(F.col("low")["text"], ", ")))
    warnings = F.array_compact(F.concat(F.array(truncation_warning(F.col("n_pages"), settings), unread), F.coalesce(F.col("said")["text"], F.array().cast("array<string>")), F.array(low)))
    documents = rows.select("doc_id", "error", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), warnings.alias("warnings"))
    return documents, fields


def nested(fields: DataFrame) -> DataFrame:
    """(doc_id, fields): a map of top-level results by name."""
    result = F.struct("value", "confidence", "box", "match_score", "matched_text", "source")
    return fields.where("item_no IS NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", result))).alias("fields"))


def health(loading: bool, error: str | None) -> tuple[int, dict[str, str]]:
    """State of a service around these plans."""
    if error:
        return 503, {"status": "error", "error": error}
    return (503, {"status": "loading"}) if loading else (200, {"status": "ok"})
