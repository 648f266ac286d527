import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from parchment.operators import evaluate, export, fallback, match
from parchment.operators.parse import clean_answers
from parchment.plans.extract import extract

BOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"


def lines_of(spark, *texts, doc=1):
    rows = [(doc, 0, i, t, (0.0, 20.0 * i, 100.0, 20.0 * i + 16, 0), 0.9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, page int, line_no int, text string, box {BOX}, confidence double")


def answers(spark, *raws):
    return spark.createDataFrame([(i + 1, "v3", r) for i, r in enumerate(raws)], "doc_id long, prompt_version string, raw string")


def test_answers_are_cleaned(spark):
    rows = clean_answers(
        answers(
            spark,
            '```json\n{"vendor_name": " REWE ", "invoice_number": 4711, "invoice_date": "15.03.2024", "currency": "€", "extra": 1, "line_items": [{"description": "Milk", "total": "1,19"},]}\n```',
            '{"vendor_name": "null", "line_items": null}',
            '{"line_items": {"description": "one"}}',
            '{"line_items": "x"}',
            "no json",
            None,
        )
    ).orderBy("doc_id").collect()
    assert rows[0]["vendor_name"] == "REWE" and rows[0]["invoice_number"] == "4711" and str(rows[0]["invoice_date"]) == "2024-03-15" and rows[0]["currency"] == "EUR" and rows[0]["line_items"][0]["total"] == 1.19
    assert rows[1]["vendor_name"] is None and rows[1]["line_items"] == [] and rows[1]["error"] is None
    assert [i["description"] for i in rows[2]["line_items"]] == ["one"]
    assert all(r["error"] for r in rows[3:])


def test_total_by_label(spark):
    def total(*texts):
        found = fallback.find_total(lines_of(spark, *texts)).collect()
        return found[0]["total"] if found else None

    assert total("SUBTOTAL 5.00", "TOTAL 6.00") == 6.0
    assert total("TOTAL 6.00", "GRAND TOTAL", "RM 7.00") == 7.0
    assert total("total qty 3.00") is None and total("hello") is None


def test_documents_end_to_end(spark):
    raw = '{"vendor_name": "Acme Store", "invoice_date": null, "total_amount": "28.11", "currency": "RM", "line_items": [{"description": "Blue pen", "quantity": 2, "total": "12.00"}]}'
    lines = lines_of(spark, "ACME STORE", "Date: 25/12/2018", "Blue pen 2 pcs 12.00", "TOTAL RM 12.00")
    documents, fields = extract(answers(spark, raw, "broken"), lines)
    found = {(r["item_no"], r["field"]): r for r in fields.collect()}
    assert found[(None, "vendor_name")]["confidence"] == "high" and found[(None, "vendor_name")]["matched_text"] == "ACME STORE"
    assert found[(None, "total_amount")]["value_num"] == 12.0 and found[(None, "total_amount")]["source"] == "ocr_fallback"
    assert str(found[(None, "invoice_date")]["value_date"]) == "2018-12-25" and found[(None, "invoice_date")]["confidence"] == "medium"
    assert found[(0, "quantity")]["confidence"] == "high"
    docs = {r["doc_id"]: r for r in documents.collect()}
    assert docs[2]["error"] and docs[1]["error"] is None and "28.11 was not found" in docs[1]["warnings"][0]


def test_windows_stop_at_pages(spark):
    lines = lines_of(spark, *"abcdefgh")
    assert match.windows(lines).count() == 33
    assert match.windows(lines.withColumn("page", (F.col("line_no") > 3).cast("int"))).count() == 20


def test_workbook(tmp_path):
    path = str(tmp_path / "x.xlsx")
    export.write_xlsx(path, {"Invoices": [("File", "Total"), ("a & b", 1.5)], "Legend": export.LEGEND}, {("Invoices", 1, 1): "FFF2CC"})
    with zipfile.ZipFile(path) as z:
        assert "a &amp; b" in z.read("xl/worksheets/sheet1.xml").decode() and "FFF2CC" in z.read("xl/styles.xml").decode()


def test_resumed_run_leaves_saved_records_of_no_sample(spark, tmp_path, monkeypatch):
    from parchment import queries

    kept, resumed = {}, queries.evaluate.resumed
    monkeypatch.setattr(queries.evaluate, "resumed", lambda samples, done, fresh: kept.update(done=done, samples=samples) or resumed(samples, done, fresh))
    spark.range(1, 61).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.resume_run(spark, str(tmp_path)).collect()
    assert sorted((int(r["key"]), r["record"]) for r in got) == [(k, "fresh" if k % 4 else "saved") for k in range(1, 61)]
    assert kept["done"].join(kept["samples"], "key", "left_anti").count() == 60


def test_json_numbers_and_item_shapes(spark):
    """JSON numbers aren't texts; faults name the items, the first three; fences within strings stay."""
    raws = [
        '{"total_amount": 1234.567, "subtotal": 12.345, "tax": 1e7, "line_items": [{"quantity": 1.125, "unit_price": 1.5e10, "total": true}]}',
        '{"vendor_name": "```json", "total_amount": "1.234", "tax": false, "subtotal": [5]}',
        '{"total_amount": 5, "line_items": [1]}',
        '{"line_items": [{"description": "a"}, null, "x", [], 7]}',
        '```JSON\n{"total_amount": -0.5, "line_items": []}\n```',
    ]
    rows = clean_answers(answers(spark, *raws)).orderBy("doc_id").collect()
    assert (rows[0]["total_amount"], rows[0]["subtotal"], rows[0]["tax"]) == (1234.567, 12.345, 1e7)
    assert tuple(rows[0]["line_items"][0]) == (None, 1.125, 1.5e10, None)
    assert rows[1]["vendor_name"] == "```json" and (rows[1]["total_amount"], rows[1]["tax"], rows[1]["subtotal"]) == (1234.0, None, None)
    assert rows[2]["error"] == "JSON does not match the schema: line_items.0: must be an object" and rows[2]["total_amount"] is None and rows[2]["line_items"] is None
    assert rows[3]["error"].endswith("line_items.1: must be an object; line_items.2: must be an object; line_items.3: must be an object")
    assert rows[4]["total_amount"] == -0.5 and rows[4]["error"] is None


def test_amounts_on_the_labels_row(spark):
    """The right-most amount right of a label wins; left ones and other rows don't count."""

    def line(no, text, x0, y0):
        return (1, 0, no, text, (float(x0), float(y0), x0 + 50.0, y0 + 16.0, 0), 0.9)

    rows = [line(0, "GRAND TOTAL", 100, 100), line(1, "3.00 left", 20, 100), line(2, "RM 5.00 b", 200, 102), line(3, "RM 7.00 c", 300, 98), line(4, "RM 9.00", 100, 160)]
    lines = spark.createDataFrame(rows, f"doc_id long, page int, line_no int, text string, box {BOX}, confidence double")
    found = fallback.find_total(lines).first()
    assert found["total"] == 7.0 and found["text"] == "GRAND TOTAL RM 7.00 c" and (found["box"]["x0"], found["box"]["x1"]) == (100.0, 350.0)
    assert fallback.find_total(lines.where("line_no NOT IN (1, 2, 3)")).first()["total"] == 9.0
    assert fallback.find_total(lines.where("line_no NOT IN (2, 3, 4)")).count() == 0


def plain_number_hits(fields, lines):
    out = set()
    for doc, field, value in fields:
        for d, no, text in lines:
            if d == doc and any(abs(abs(float(t.replace(",", ""))) - abs(value)) < 0.005 for t in re.findall(r"-?\d[\d.,]*", text)):
                out.add((doc, field, no))
    return out


def test_numbers_meet_their_lines(spark):
    values = [(1, "a", 12.344), (1, "b", 12.349), (1, "c", -7.0), (2, "d", 0.004), (2, "e", 1234.5)]
    texts = [(1, 0, "12.35 and 12.34"), (1, 1, "7.00"), (1, 2, "none"), (2, 0, "0.00"), (2, 1, "1,234.50 x 1,234.50"), (2, 2, "-1234.5")]
    fields = spark.createDataFrame([(d, None, f, "number", str(v), v, None) for d, f, v in values], "doc_id long, item_no int, field string, kind string, value string, value_num double, value_date date")
    lines = spark.createDataFrame([(d, 0, no, t, (0.0, 20.0 * no, 9.0, 20.0 * no + 9, 0), 0.9) for d, no, t in texts], f"doc_id long, page int, line_no int, text string, box {BOX}, confidence double")
    got = {(r["doc_id"], r["field"], r["start"]) for r in match.score_numbers(fields, lines).collect()}
    assert got == plain_number_hits(values, texts)


def test_sample_ranges(spark):
    samples = spark.range(10, 60).withColumnRenamed("id", "key")
    keys = lambda *a: sorted(r["key"] for r in evaluate.sample_range(samples, "key", *a).collect())
    assert keys() == list(range(10, 60)) and keys(5) == list(range(15, 60)) and keys(5, 10) == list(range(15, 25)) and keys(0, 3) == [10, 11, 12] and keys(100) == []


def plain_match(fields, lines):
    """Texts and item numbers of small documents, by trying every window: {(doc, item, field): (confidence, score, text, box)}."""
    from parchment.functions.fuzzy import partial_ratio, ratio

    loose = lambda x: " ".join(x.split()).lower()
    centre = lambda box: (box[1] + box[3]) / 2

    def runs(doc):
        for page in sorted({x[1] for x in lines if x[0] == doc}):
            held = sorted((x for x in lines if x[0] == doc and x[1] == page), key=lambda x: x[2])
            for i in range(len(held)):
                for n in range(1, min(6, len(held) - i) + 1):
                    part = held[i : i + n]
                    boxes = [x[4] for x in part]
                    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes), page)
                    yield n, part[0][2], " ".join(x[3] for x in part), box

    def score(needle, text):
        if len(needle) < 4:
            return 100.0 if re.search(rf"(?<![0-9a-z]){re.escape(needle)}(?![0-9a-z])", text) else 0.0
        return 100.0 if needle in text else partial_ratio(needle, text) if len(text) >= len(needle) else ratio(needle, text)

    def result(found):
        s, text, box = max(found)[-1] if found else (0.0, None, None)
        level = "high" if s >= 90 else "medium" if s >= 70 else "low"
        return level, round(s, 1), text, None if level == "low" else box

    out = {}
    for doc, item, field, kind, value in fields:
        if kind == "text":
            found = [((round(s, 1), -n, -(1e6 * box[4] + centre(box)), -start), (round(s, 1), text, box)) for n, start, text, box in runs(doc) if (s := score(loose(value), loose(text))) > 0]
            out[doc, item, field] = result(found)
    for doc, item, field, kind, value in fields:
        if kind == "number":
            anchor, found = out[doc, item, "description"][3], []
            for n, start, text, box in runs(doc):
                if n > 1 or not any(abs(abs(float(t)) - abs(value)) < 0.005 for t in re.findall(r"\d+(?:\.\d+)?", text)):
                    continue
                near = anchor and anchor[4] == box[4] and abs(centre(anchor) - centre(box)) <= 3 * max(box[3] - box[1], anchor[3] - anchor[1], 1.0)
                if field == "quantity" and not near:
                    continue
                away = -abs(centre(box) - centre(anchor)) - 1e6 * abs(box[4] - anchor[4]) if anchor else -(1e6 * box[4] + centre(box))
                found.append(((100.0, -1, away, -start), (100.0, text, box)))
            out[doc, item, field] = result(found)
    return out


def test_matching_is_brute_force(spark):
    rng = random.Random(21)
    words = ["blue", "pen", "acme", "store", "paper", "mill", "road", "no", "ltd", "box"]
    lines, fields = [], []
    for doc in range(14):
        for no in range(rng.randrange(1, 12)):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + rng.choice(["", f" {rng.randrange(1, 6)} pcs {rng.randrange(1, 9)}.50"])
            y = 20.0 * no
            lines.append((doc, no // 5, no, text.upper() if no % 3 == 0 else text, (10.0 * (no % 2), y, 100.0 + len(text), y + 16, no // 5), 0.9))
        damaged = lambda x: "".join(rng.choice("xyz") if rng.random() < 0.15 else c for c in x)
        for item in (None, 0, 1):
            name = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
            fields.append((doc, item, "description" if item is not None else "vendor_name", "text", damaged(name) if rng.random() < 0.6 else name))
            if item is not None:
                fields += [(doc, item, "quantity", "number", float(rng.randrange(1, 6))), (doc, item, "total", "number", rng.randrange(1, 9) + 0.5)]
        fields.append((doc, None, "invoice_number", "text", rng.choice(["no", "ltd", "box 4"])))
    rows = [(d, i, f, k, str(v), v if k == "number" else None, None) for d, i, f, k, v in fields]
    frame = spark.createDataFrame(rows, "doc_id long, item_no int, field string, kind string, value string, value_num double, value_date date")
    shown = spark.createDataFrame(lines, f"doc_id long, page int, line_no int, text string, box {BOX}, confidence double")
    got = {(r["doc_id"], r["item_no"], r["field"]): (r["confidence"], r["match_score"], r["matched_text"], r["box"] and tuple(r["box"])) for r in match.match_fields(frame, shown).collect()}
    want = plain_match(fields, lines)
    assert {x[0] for x in want.values()} == {"high", "medium", "low"} and got == want


@pytest.mark.parametrize("parts", [1, 6])
def test_places_in_a_total_order(spark, parts):
    from parchment.operators.order import numbered

    rows = [(i % 7 if i % 11 else None, None if i % 5 == 0 else i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(parts)
    nulls_first = lambda x: (x is not None, x or 0)
    whole = numbered(df, "v", "id").collect()
    assert [r.place for r in sorted(whole, key=lambda r: (nulls_first(r.v), r.id))] == list(range(200))
    within = numbered(df, "v", "id", by=("g",)).collect()
    for g in {r.g for r in within}:
        assert [r.place for r in sorted((r for r in within if r.g == g), key=lambda r: (nulls_first(r.v), r.id))] == list(range(sum(r.g == g for r in within)))
    tied = numbered(df, "v").collect()
    assert sorted(r.place for r in tied) == list(range(200)) and [r.v for r in sorted(tied, key=lambda r: r.place)] == sorted((r.v for r in tied), key=nulls_first)
    assert numbered(df.limit(0), "v").count() == 0


def test_exact_medians_by_ranges(spark):
    import statistics

    from parchment.operators.order import medians

    rng = random.Random(2)
    groups = {"one": [3.5], "even": [1.0, 2.0], "equal": [7.0] * 40, "wide": [rng.choice([-1e300, 1e300, 0.0, 5e-324, 1.5]) for _ in range(101)], None: [rng.lognormvariate(0, 8) for _ in range(200)], "hot": [round(rng.gauss(5, 1), 2) for _ in range(1500)]}
    rows = [(g, v) for g, held in groups.items() for v in held] + [("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r["median"] for r in medians(df, "v", ("g",), buckets=4).collect()}
    assert got == {g: statistics.median(held) for g, held in groups.items()}
    every = [v for held in groups.values() for v in held]
    assert medians(df, "v").collect()[0]["median"] == statistics.median(every)
    assert medians(df.limit(0), "v").count() == 0


def test_stats_of_runs_with_exact_medians(spark):
    rows = [("a", 1.0, None), ("a", 2.0, None), ("a", 9.0, "broken"), ("b", 4.0, "broken"), (None, 3.0, None)]
    records = spark.createDataFrame(rows, "run string, seconds double, error string")
    got = {r.run: (r.documents, r.failed, r.avg_seconds, r.median_seconds) for r in evaluate.run_stats(records, "run").collect()}
    assert got == {"a": (3, 1, 1.5, 1.5), "b": (1, 1, None, None), None: (1, 0, 3.0, 3.0)}
    assert tuple(evaluate.run_stats(records).first()) == (5, 2, 2.0, 2.0)
    assert tuple(evaluate.run_stats(records.limit(0)).first()) == (0, 0, None, None)


def test_sample_ranges_with_ties_and_far_offsets(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS key").repartition(7)
    parts = [evaluate.sample_range(df, "key", o, n) for o, n in ((0, 500), (500, 300), (800, None))]
    ids = [[r.id for r in x.collect()] for x in parts]
    assert [len(x) for x in ids] == [500, 300, 200]
    assert all("TakeOrdered" not in x._jdf.queryExecution().toString() for x in parts)
    assert sorted(r.key for x in parts for r in x.collect()) == sorted(i % 3 for i in range(1000))
    exact = evaluate.sample_range(df, "id", 500, 300)
    assert sorted(r.id for r in exact.collect()) == list(range(500, 800)) and exact.columns == ["id", "key"]


def test_answers_that_only_a_lenient_reader_takes(spark):
    raws = [
        '{"total_amount": 1, "total_amount": "2,50", "x": {"a": 1, "a": 2}}',
        '{"tax": NaN, "subtotal": -Infinity, "line_items": [{"total": NaN, "description": "a", "description": "b"}]}',
        '{"line_items": {"total": "1.234", "total": 7.125}, "vendor_name": "a", "vendor_name": "b",}',
        '{"tax": 1, "tax": 2, "line_items": [3]}',
        '{"tax": 1, "tax": 2} {"tax": 3}',
        "{'tax': 1, 'tax': 2}",
        '{"tax": 1, "tax": 2',
        '{"tax": 1, "tax": None, "line_items": null}',
    ]
    rows = spark.createDataFrame([(i, "v3", x) for i, x in enumerate(raws)], "doc_id long, prompt_version string, raw string")
    got = {r.doc_id: r for r in clean_answers(rows).collect()}
    assert (got[0].total_amount, got[0].error, got[0].line_items) == (2.5, None, [])
    assert got[1].tax != got[1].tax and got[1].subtotal == float("-inf") and got[1].line_items[0].description == "b" and got[1].line_items[0].total != got[1].line_items[0].total
    assert (got[2].vendor_name, [x.total for x in got[2].line_items]) == ("b", [7.125])
    assert [got[i].error for i in (3, 4, 5, 6)] == ["no JSON object in the answer"] * 4
    assert (got[7].tax, got[7].line_items, got[7].error) == (None, [], None)


def test_outcomes_keep_the_order_of_uploads(spark):
    from parchment.operators import export

    fault = "named_struct('code', 415, 'error', 'unsupported file type')"
    uploads = spark.range(30).selectExpr("id AS doc_id", "concat('f', id, '.pdf') AS file_name", f"IF(id % 7 = 3, {fault}, NULL) AS fault", "id % 2 AS day").repartition(4)
    documents = spark.range(28).selectExpr("id AS doc_id", "IF(id % 5 = 0, 'broken', NULL) AS error", "id * 2 AS n_pages")
    got = sorted(export.outcomes(uploads, documents, "day", "doc_id").collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(30)) and [r.doc_id for r in got] == [*range(0, 30, 2), *range(1, 30, 2)]
    by = {r.doc_id: (r.status, r.code, r.error, r.n_pages) for r in got}
    assert by[10] == ("error", 415, "unsupported file type", None) and by[5] == ("error", 422, "broken", None)
    assert by[29] == ("error", 500, "the file was not processed", None) and by[4] == ("ok", None, None, 8)


def test_seconds_of_a_batch(spark):
    rows = [("a", None, 1.25), ("a", None, 2.0), ("a", "failed", None), ("b", None, 4.04), ("b", "failed", 1.0), ("c", "failed", None), (None, None, 0.0)]
    got = export.batch_seconds(spark.createDataFrame(rows, "batch string, error string, seconds double"), "batch").collect()
    assert {r["batch"]: (r["files"], r["seconds"], r["seconds_a_file"], r["spent"]) for r in got} == {
        "a": (3, 3.3, 1.1, "3.3 s, about 1.1 s a file"),
        "b": (2, 5.0, None, "5.0 s"),
        "c": (1, 0.0, None, "0.0 s"),
        None: (1, 0.0, None, "0.0 s"),
    }
    assert export.batch_seconds(spark.createDataFrame([], "batch string, error string, seconds double"), "batch").count() == 0
