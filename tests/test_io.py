"""Files in and out, streams, reports and the small rules around them."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parchment.config import Settings
from parchment.functions import text
from parchment.operators import evaluate, export
from parchment.operators.parse import check_prompt, clean_answers
from parchment.plans import extract as plans
from parchment.sources import files
from parchment.sources.tables import shared_folder
from parchment.streaming.resume import process_new

BOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
LINE = f"doc_id long, page int, line_no int, text string, box {BOX}, confidence double"


def test_folders_are_scanned(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.pdf", b"%PDF-1.7 and more"), ("a.PNG", b"\x89PNG\r\n\x1a\nrest"), ("sub/c.txt", b"text"), ("d.jpg", b"%PDF"), ("e.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, str(tmp_path))
    rows = {r["file_name"]: r for r in found.collect()}
    assert rows["b.pdf"]["length"] == 17 and bytes(rows["b.pdf"]["head"]) == b"%PDF-1.7 and mor" and rows["a.PNG"]["suffix"] == ".png"
    fault = files.upload_error(F.col("suffix"), F.col("length"), F.col("head"))
    faults = {r["file_name"]: r["fault"] for r in found.select("file_name", fault.alias("fault")).collect()}
    assert {k: v and v["code"] for k, v in faults.items()} == {"b.pdf": None, "a.PNG": None, "c.txt": 415, "d.jpg": 415}
    assert [r["file_name"] for r in files.examples(found, 2).collect()] == ["a.PNG", "b.pdf"]


def test_limits_of_batches_and_pages(spark):
    assert files.batch_error(0)[0] == 400 and files.batch_error(21)[0] == 413 and files.batch_error(3) is None
    pages = spark.createDataFrame([(1, p) for p in range(9)], "doc_id long, page int")
    assert files.first_pages(pages, Settings(max_pages=4)).count() == 4
    assert [check_prompt(x) for x in ("v1", "v2", "v3")] == ["v1", "v2", "v3"]
    with pytest.raises(ValueError, match="v9"):
        check_prompt("v9")


def test_saved_predictions_last_one_wins(spark, tmp_path):
    rows = [{"key": "a", "seq": 1, "seconds": 2.5, "labels": {"total": "1.00"}}, {"key": "b", "seq": 2, "error": "broken"}, {"key": "a", "seq": 3, "seconds": 7.0}]
    (tmp_path / "p.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    got = {r["key"]: r for r in files.load_predictions(spark, str(tmp_path / "p.jsonl")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["seconds"] == 7.0 and got["b"]["error"] == "broken"


def test_json_of_results(spark, tmp_path):
    answers = spark.createDataFrame([(1, "v3", '{"vendor_name": "Ä & Co", "total_amount": 3.5, "line_items": [{"description": "x"}]}'), (2, "v3", "none")], "doc_id long, prompt_version string, raw string")
    invoices = clean_answers(answers)
    documents = spark.createDataFrame([(1, "a.pdf", None, 2, 1.5, ["w"]), (2, "b.pdf", "no JSON", None, None, None)], "doc_id long, file_name string, error string, n_pages int, seconds double, warnings array<string>")
    export.write_json(documents, invoices, str(tmp_path / "out"))
    got = {r["file_name"]: r for r in (json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect())}
    assert got["b.pdf"] == {"status": "error", "file_name": "b.pdf", "error": "no JSON"}
    ok = got["a.pdf"]
    assert ok["status"] == "ok" and ok["invoice"]["vendor_name"] == "Ä & Co" and ok["invoice"]["total_amount"] == 3.5 and ok["invoice"]["tax"] is None and ok["warnings"] == ["w"] and ok["num_pages"] == 2
    assert export.export_name("invoices", ".json", datetime(2024, 1, 2, 3, 4, 5)) == "invoices_20240102_030405.json"


def test_report_of_a_run(spark):
    scores = spark.createDataFrame(
        [("total", "total_amount", True, 100.0, "high", "model"), ("total", "total_amount", False, 80.0, "low", "model"), ("total", "total_amount", None, None, "high", "model"), ("date", "invoice_date", True, 100.0, "medium", "ocr_fallback")],
        "label_field string, field string, exact boolean, fuzzy double, confidence string, source string",
    )
    stats = evaluate.run_stats(spark.createDataFrame([(1.0, None), (4.0, None), (9.0, "failed")], "seconds double, error string"))
    lines = evaluate.report(evaluate.field_metrics(scores), evaluate.calibration(scores), evaluate.fallback_usage(scores), stats, "Run 7").splitlines()
    assert lines[0] == "# Run 7" and "- Documents: 3 (failed: 1)" in lines and "- Mean time: 2.5 s, median 2.5 s" in lines
    assert "| total_amount | 50.0% | 50.0% | 90.0 | 2 |" in lines and "| invoice_date | high | – | 0 |" in lines and "| invoice_date | 1 | 100.0% |" in lines
    a, b = (evaluate.field_metrics(scores.where(x)) for x in ("field = 'total_amount'", "true"))
    assert {(r["field"], r["change"]) for r in evaluate.compare_runs(a, b).collect()} == {("total_amount", 0.0), ("invoice_date", None)}


def test_new_answers_are_processed_once(spark, tmp_path):
    lines = spark.createDataFrame([(i, 0, 0, f"TOTAL {i}.50", (0.0, 0.0, 50.0, 16.0, 0), 0.9) for i in (1, 2, 3)], LINE)
    folder, out, state = (str(tmp_path / x) for x in ("answers", "out", "state"))
    answer = lambda i: spark.createDataFrame([(i, "v3", f'{{"total_amount": "{i}.50"}}')], "doc_id long, prompt_version string, raw string").write.mode("append").parquet(folder)
    seen = []
    for batch in ((1, 2), (), (3,)):
        for i in batch:
            answer(i)
        process_new(spark, folder, lines, out, state).awaitTermination()
        fields = spark.read.parquet(f"{out}/fields").where("field = 'total_amount'")
        seen.append(sorted((r["doc_id"], r["value_num"], r["confidence"]) for r in fields.collect()))
    assert seen == [[(1, 1.5, "high"), (2, 2.5, "high")]] * 2 + [[(1, 1.5, "high"), (2, 2.5, "high"), (3, 3.5, "high")]]


def test_small_rules(spark):
    one = spark.createDataFrame([(1,)], "x int")
    value = lambda c: one.select(c.alias("y")).first()[0]
    none = [F.lit(None).cast(x) for x in ("string", "double", "date")]
    assert value(text.display(F.lit("number"), none[0], F.lit(-1234.5), none[2])) == "-1,234.50"
    assert value(text.display(F.lit("quantity"), none[0], F.lit(2.5), none[2])) == "2.5" and value(text.display(F.lit("text"), F.lit("a<b"), none[1], none[2])) == "a&lt;b"
    place = lambda x0, y0: tuple(value(export.label_place(F.lit(100.0), F.lit(40.0), F.lit(10.0), F.lit(x0), F.lit(y0), F.lit(y0 + 20))))
    assert place(80.0, 50.0) == (60.0, 40.0) and place(-5.0, 4.0) == (0.0, 24.0)
    assert plans.health(True, None)[0] == 503 and plans.health(False, "x") == (503, {"status": "error", "error": "x"}) and plans.health(False, None)[0] == 200
    fields = spark.createDataFrame([(1, None, "tax", "3", "high"), (1, 0, "total", "4", "low")], "doc_id long, item_no int, field string, value string, confidence string")
    fields = fields.withColumns({"box": F.lit(None).cast(BOX), "match_score": F.lit(100.0), "matched_text": F.lit("t"), "source": F.lit("model")})
    assert set(plans.nested(fields).first()["fields"]) == {"tax"}


def test_shared_tables_need_a_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)
