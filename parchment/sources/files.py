"""Files: scanning folders, sniffing types, upload rules, pages, raw OCR and saved predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.config import DEFAULTS, Settings
from parchment.functions import geometry
from parchment.functions.text import strip
from parchment.types import PREDICTION

# The first bytes of each known type.
SIGNATURES = {".pdf": "25504446", ".png": "89504E470D0A1A0A", ".jpg": "FFD8FF", ".jpeg": "FFD8FF"}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, suffix, length, head) of all files; only the first 16 bytes of content go on.

    Spark's reader leaves files without content out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return files.select(name.alias("file_name"), suffix_of(name).alias("suffix"), "length", F.substring("content", 1, 16).alias("head"))


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))


def has_valid_signature(suffix: Column, head: Column) -> Column:
    """Whether the suffix is known and the content starts as its type does."""
    rule = F.lit(False)
    for known, start in SIGNATURES.items():
        rule = rule | ((F.lower(suffix) == known) & (F.hex(F.substring(head, 1, len(start) // 2)) == start))
    return F.coalesce(rule, F.lit(False))


def upload_error(suffix: Column, length: Column, head: Column, settings: Settings = DEFAULTS) -> Column:
    """struct<code, error> of the first rule that an upload breaks, or null: type, empty, size, content."""

    def fault(code: int, text: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(text).alias("error"))

    known = F.coalesce(F.lower(suffix).isin(*SIGNATURES), F.lit(False))
    return (
        F.when(~known, fault(415, "unsupported file type"))
        .when(F.coalesce(length, F.lit(0)) == 0, fault(400, "empty file"))
        .when(length > settings.max_upload_bytes, fault(413, "file too large"))
        .when(~has_valid_signature(suffix, head), fault(415, "content does not match the file type"))
    )


def upload_message(name: Column, there: Column, length: Column, head: Column, settings: Settings = DEFAULTS) -> Column:
    """What a form says about the first rule that a file breaks, with its name, or null: type, existence, size, content."""
    suffix = suffix_of(name)
    known = ", ".join(sorted(x.lstrip(".").upper() for x in SIGNATURES))
    tenths = F.floor((length * 10 + (1 << 19)) / (1 << 20)).cast("long")  # of MB, rounded
    size = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    said = (
        F.when(~suffix.isin(*SIGNATURES), F.lit(f"this type of file is not supported ({known} are)."))
        .when(~F.coalesce(there, F.lit(False)), "the file was not found.")
        .when(F.coalesce(length, F.lit(0)) == 0, "the file is empty.")
        .when(length > settings.max_upload_bytes, F.concat(F.lit("the file has "), size, F.lit(f" MB, more than {settings.max_upload_bytes >> 20} MB.")))
        .when(~has_valid_signature(suffix, head), F.concat(F.lit("the content is not that of a "), F.upper(F.ltrim(suffix, F.lit("."))), F.lit(" file.")))
    )
    return F.concat(name, F.lit(": "), said)


def failure_message(name: Column, error_class: Column) -> Column:
    """A failed document's error in words for people, by its class."""
    said = {
        "UnsupportedFile": "this type of file is not supported.",
        "PdfError": "the PDF could not be read; it may be broken or have a password.",
        "UnreadableImage": "the image could not be read.",
        "ExtractionError": "the model could not read this document.",
    }
    texts = F.create_map(*[F.lit(x) for pair in said.items() for x in pair])
    return F.when(error_class.isNotNull(), F.concat(name, F.lit(": "), F.coalesce(F.element_at(texts, error_class), F.lit("something went wrong with this file."))))


def http_code(error_class: Column) -> Column:
    """Status of a failed document: unreadable input is the caller's, a failed extraction is 422, others 500."""
    return F.when(error_class.isin("UnsupportedFile", "UnreadableImage", "PdfError"), 400).when(error_class == "ExtractionError", 422).when(error_class.isNotNull(), 500)


def batch_error(n_files: int, settings: Settings = DEFAULTS) -> tuple[int, str] | None:
    if n_files == 0:
        return 400, "no files"
    return (413, "too many files") if n_files > settings.max_files else None


def examples(files: DataFrame, limit: int = 4) -> DataFrame:
    """The first files by name with a known suffix."""
    return files.where(F.col("suffix").isin(*SIGNATURES)).orderBy("file_name").limit(limit)


def first_pages(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages up to the limit; the filter reaches the scan."""
    return pages.where(F.col("page") < settings.max_pages)


def truncation_warning(n_pages: Column, settings: Settings = DEFAULTS) -> Column:
    used = F.lit(settings.max_pages)
    return F.when(n_pages > used, F.concat(F.lit("The document has "), n_pages.cast("string"), F.lit(" pages; only the first "), used.cast("string"), F.lit(" were used.")))


def ocr_scan(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """OCR lines from (doc_id, page, line_no, text, xs, ys, confidence): boxes of polygons, without empty and doubtful lines."""
    text = strip(F.col("text"))
    return raw.where((text != "") & (F.col("confidence") >= settings.min_ocr_confidence)).select("doc_id", "page", "line_no", text.alias("text"), geometry.of_polygon(F.col("xs"), F.col("ys"), F.col("page")).alias("box"), "confidence")


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Saved predictions, the last record of each key; blank lines are skipped."""
    saved = spark.read.schema(PREDICTION).json(path)
    return last_by_key(saved)


def last_by_key(records: DataFrame) -> DataFrame:
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return records.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
