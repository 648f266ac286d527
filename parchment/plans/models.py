"""Callers' own models in the plan: OCR of pages and answers to requests, run where Spark puts the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.config import DEFAULTS, Settings
from parchment.operators.parse import clean_answers
from parchment.plans.extract import extract
from parchment.sources.files import ocr_scan
from parchment.sources.tables import written

ROWS = 16  # that a worker holds at a time
LINES = pa.list_(pa.struct([("text", pa.string()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("confidence", pa.float64())]))

_loaded: dict[str, Any] = {}  # of this worker, by name


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """The worker's own function of that name, loaded if it isn't there yet."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def called(rows: DataFrame, load: Callable[[], Callable[[dict], Any]], name: str, kind: pa.DataType, ddl: str, tasks: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """`rows` with `result` (of Arrow type `kind`, `ddl` in Spark's words) and `failure`: what the loaded function says to each row.

    `load` runs once in a Python worker, whatever number of tasks this gets, and its function is kept there by
    `name`. A row's exception is its `failure`, and an exception in loading that of all rows of the task. At most `tasks` calls run
    at once, or as many as the resource profile (GPUs, say) has room for. A row whose task is repeated is asked again.
    """
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"result {ddl}, failure string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                results, failures = [], []
                for row in part.to_pylist():
                    try:
                        results.append(loaded(name, load)(row))
                        failures.append(None)
                    except Exception as error:  # noqa: BLE001  a model may raise anything; it is this row's failure
                        results.append(None)
                        failures.append(str(error) or type(error).__name__)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(results, kind), pa.array(failures, pa.string())], schema.names)

    dealt = rows.repartition(tasks) if tasks else rows
    return dealt.mapInArrow(run, schema, profile=profile)


def read_lines(pages: DataFrame, load: Callable[[], Callable[[dict], list[dict]]], name: str = "ocr", settings: Settings = DEFAULTS, tasks: int | None = None, profile: ResourceProfile | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, failures) of pages (doc_id, page and what the function reads): OCR lines with boxes, and (doc_id, ocr_error).

    The function gives a list of dicts with text, xs, ys and confidence for a page's row. If it fails on any page, the
    document has no lines at all and the first such page's failure; it goes on without them.
    """
    found = written(called(pages.where(F.col("page") < settings.max_pages), load, name, LINES, "array<struct<text: string, xs: array<double>, ys: array<double>, confidence: double>>", tasks, profile).select("doc_id", "page", "result", "failure"), "ocr")
    failures = found.where("failure IS NOT NULL").groupBy("doc_id").agg(F.min_by("failure", "page").alias("ocr_error"))
    raw = found.join(failures.select("doc_id"), "doc_id", "left_anti").select("doc_id", "page", F.posexplode("result").alias("nth", "line"))
    raw = raw.select("doc_id", "page", (F.col("page").cast("long") * (1 << 20) + F.col("nth")).cast("int").alias("line_no"), "line.*")  # lines in order of pages
    return ocr_scan(raw, settings), failures


def ask(requests: DataFrame, load: Callable[[], Callable[[dict], str]], name: str = "model", tasks: int | None = None, profile: ResourceProfile | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, second, failures) to requests (doc_id, prompt_version and what the function reads).

    The function gets a request's row as a dict, `fault` null at first. Answers that `clean_answers` finds faults with are
    asked for once more with that fault; the second answer is final. An exception, at first, is the document's failure
    and isn't repeated.
    """
    none = F.lit(None).cast("string")
    first = written(called(requests.withColumn("fault", none), load, name, pa.string(), "string", tasks, profile), "asked")
    answers = first.select("doc_id", "prompt_version", F.col("result").alias("raw"))
    failures = first.where("failure IS NOT NULL").select("doc_id", F.col("failure").alias("model_error"))
    faulty = clean_answers(answers.where("raw IS NOT NULL"), only=[]).where("error IS NOT NULL").select("doc_id", F.col("error").alias("fault"))
    again = called(requests.join(faulty, "doc_id"), load, name, pa.string(), "string", tasks, profile)
    return answers, written(again.where("result IS NOT NULL").select("doc_id", F.col("result").alias("raw")), "again"), failures


def process(
    pages: DataFrame,
    requests: DataFrame,
    load_ocr: Callable[[], Callable[[dict], list[dict]]],
    load_model: Callable[[], Callable[[dict], str]],
    settings: Settings = DEFAULTS,
    tasks: int | None = None,
    profile: ResourceProfile | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, fields) of `extract`, from pages and requests and the caller's two models.

    A document whose OCR fails keeps its values at low confidence and says so in its warnings; one whose
    model fails is a row with that error. Neither touches any other.
    """
    lines, ocr_failures = read_lines(pages, load_ocr, settings=settings, tasks=tasks, profile=profile)
    answers, second, failures = ask(requests, load_model, tasks=tasks, profile=profile)
    documents, fields = extract(answers, lines, settings, second, ocr_failures)
    told = documents.join(failures, "doc_id", "left")
    return told.withColumn("error", F.coalesce("model_error", "error")).drop("model_error"), fields
