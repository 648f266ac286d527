"""Callers' models in the plan: loads, calls, retries and failures."""

import json
import os

from pyspark.sql import functions as F

from parchment.config import Settings
from parchment.plans.models import ask, process, read_lines


def logger(folder):
    """A function of its own, which goes to the workers whole; one file for each event, as tasks run in several processes."""

    def logged(kind, text):
        with open(f"{folder}/{kind}-{os.getpid()}-{text}-{len(os.listdir(folder))}", "a") as f:
            f.write("x")

    return logged


def events(folder, kind):
    return [x for x in os.listdir(folder) if x.startswith(f"{kind}-")]


def ocr_loader(folder):
    logged = logger(folder)

    def load():
        logged("load", "ocr")

        def read(row):
            logged("call", f"{row['doc_id']}p{row['page']}")
            if row["doc_id"] == 3 and row["page"] == 1:
                raise RuntimeError("no ink")
            texts = ["Acme Ltd", f"TOTAL {row['doc_id']}.50", " "] if row["page"] == 0 else ["page two"]
            return [{"text": x, "xs": [1.0, 90.0, 90.0, 1.0], "ys": [20.0 * i, 20.0 * i, 20.0 * i + 16, 20.0 * i + 16], "confidence": 0.9} for i, x in enumerate(texts)]

        return read

    return load


def model_loader(folder):
    logged = logger(folder)

    def load():
        logged("load", "model")

        def answer(row):
            again = row["fault"] is not None
            logged("ask", f"{row['doc_id']}{'again' if again else ''}")
            if row["doc_id"] == 5:
                raise MemoryError
            if row["doc_id"] == 6 or row["doc_id"] == 7 and not again:
                return "I can't read it."
            return json.dumps({"vendor_name": "Acme Ltd", "total_amount": row["doc_id"] + 0.5})

        return answer

    return load


def test_loads_calls_retries_and_failures(spark, tmp_path):
    folder = str(tmp_path)
    pages = spark.createDataFrame([(d, p) for d in range(1, 10) for p in range(3)], "doc_id long, page int")
    requests = spark.createDataFrame([(d, "v3") for d in range(1, 10)], "doc_id long, prompt_version string")
    documents, fields = process(pages, requests, ocr_loader(folder), model_loader(folder), Settings(max_pages=2), tasks=2)
    rows = {r.doc_id: r for r in documents.collect()}
    assert len(events(folder, "call")) == 18  # third pages are not read
    asked = [x.split("-")[2] for x in events(folder, "ask")]
    assert sorted(asked) == sorted([str(d) for d in range(1, 10)] + ["6again", "7again"])
    loads = [x.split("-")[1:3] for x in events(folder, "load")]
    assert len(loads) == len({tuple(x) for x in loads}), "a worker loads a model once"
    assert rows[5].error == "MemoryError" and rows[6].error == "no JSON object in the answer" and all(rows[d].error is None for d in (1, 2, 3, 4, 7, 8, 9))
    assert rows[3].warnings == ["OCR failed, so no confidence could be checked: no ink"] and rows[3].n_lines == 0 and rows[1].warnings == [] and rows[1].n_lines == 3
    found = {(r.doc_id, r.field): r.confidence for r in fields.where("value IS NOT NULL AND item_no IS NULL").collect()}
    assert found[1, "total_amount"] == "high" and found[3, "total_amount"] == "low" and found[7, "vendor_name"] == "high"


def test_lines_in_order_of_pages_and_failures_by_first_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (3, 0)], "doc_id long, page int")
    lines, failures = read_lines(pages, ocr_loader(str(tmp_path)), name="other")
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["Acme Ltd", "TOTAL 1.50", "page two"]
    assert [tuple(r) for r in failures.collect()] == [(3, "no ink")]


def test_a_model_that_does_not_load(spark, tmp_path):
    def load():
        raise OSError("no weights")

    requests = spark.createDataFrame([(d, "v3") for d in range(3)], "doc_id long, prompt_version string")
    answers, second, failures = ask(requests, load, name="absent")
    assert failures.where(F.col("model_error") == "no weights").count() == 3 and second.count() == 0 and answers.where("raw IS NULL").count() == 3
    assert ask(requests.limit(0), load, name="absent")[0].count() == 0
