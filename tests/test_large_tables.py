"""Queries on keys and numbers of rows beyond those of the small tables."""

import os
import time

import duckdb
import pytest

from pyspark.sql import functions as F

from parchment.operators import match
from parchment import queries as q
from parchment.functions.dates import FORMATS, date_tokens, may_hold_date, parse_date
from parchment.operators import evaluate, export, fallback, match
from parchment.sources.tables import WRITING, settings_of, written

TABLES = ("pages", "orders", "customer", "lineitem", "part")


def oracle(folder, name):
    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{folder}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return sorted(con.execute(q.ORACLE_SQL[name]).fetchall(), key=repr)


def rows(spark, folder, name):
    return sorted((tuple(x) for x in q.QUERIES[name](spark, str(folder)).collect()), key=repr)


@pytest.mark.parametrize("first", [1180, 6400, 31900, 100000])
def test_facts_of_files_with_large_keys(spark, tmp_path, first):
    spark.range(first, first + 60).selectExpr("id AS page_id", "'http://a/b' AS url", "'<p>x</p>' AS html").write.parquet(f"{tmp_path}/parts")
    duckdb.sql(f"COPY (FROM '{tmp_path}/parts/*.parquet') TO '{tmp_path}/pages.parquet'")
    assert rows(spark, tmp_path, "file_facts") == oracle(tmp_path, "file_facts")


def test_dates_meet_lines_by_document_and_day(spark):
    fields = spark.sql("SELECT 1L AS doc_id, CAST(NULL AS INT) AS item_no, 'invoice_date' AS field, 'date' AS kind, '' AS value, CAST(NULL AS DOUBLE) AS value_num, DATE'2024-03-05' AS value_date")
    lines = spark.sql("SELECT 1L AS doc_id, 0 AS page, id AS line_no, text, named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 1D, 'page', 0) AS box FROM VALUES (0, '05/03/2024 or 5 March 2024'), (1, '05/03/2023'), (2, 'none') AS t(id, text)")
    pairs = match.score_dates(fields, lines)
    assert [(x.start, x.score) for x in pairs.collect()] == [(0, 100.0)]
    assert "exists(" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_that_reads_is_read_once(spark):
    """The formats stand in the plan once a reading, and only the one with the right kind of month is tried."""
    plan = spark.range(1).select(parse_date(F.concat(F.lit("x"), F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and plan.count("rlike") <= 3 * (len(FORMATS) + 1)


def test_written_tables_are_not_broadcast(spark):
    """Tables that grow with the documents aren't sent through the driver, however small their files look."""
    fields = written(spark.sql("SELECT id AS doc_id, CAST(NULL AS INT) AS item_no, 'vendor_name' AS field, 'text' AS kind, 'abcdef' AS value, CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS DATE) AS value_date FROM range(50)"), "fields")
    lines = written(spark.sql("SELECT id AS doc_id, 0 AS page, 0 AS line_no, 'abcdef' AS text, named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 1D, 'page', 0) AS box FROM range(50)"), "lines")
    found = match.match_fields(fields, lines)
    assert found.where("confidence = 'high'").count() == 50
    plan = fallback.apply_fallback(found, lines)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and "Broadcast" not in plan


def test_printed_numbers_are_parsed_once(spark):
    """A token's parsing stands in the plan once, whatever filters the join adds."""
    fields = spark.sql("SELECT 1L AS doc_id, CAST(NULL AS INT) AS item_no, 'total_amount' AS field, 'number' AS kind, '' AS value, -1234.5D AS value_num, CAST(NULL AS DATE) AS value_date")
    lines = written(spark.sql("SELECT 1L AS doc_id, 0 AS page, id AS line_no, text, named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 1D, 'page', 0) AS box FROM VALUES (0, '1,234.50 or 7'), (1, '1.234,50'), (2, 'none'), (3, '..')  AS t(id, text)"), "lines")
    pairs = match.score_numbers(fields, lines)
    assert sorted(x.start for x in pairs.collect()) == [0, 1]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("[0-9][0-9,]*") == 1


def test_lines_without_dates_are_left_out_before_tokens(spark):
    texts = ["Date: 05/03/2024", "5 March 24", "MAY 5, 2024 8:13 PM", "12 pcs 45,123.00", "1.234.567", "x 2024-1-5x", "20240305", "3.4", "Sept 5 2024", "7 fEb. 2020", "no"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no int, text string")
    held = lines.select("line_no", may_hold_date(F.col("text")).alias("may"), F.exists(F.transform(date_tokens(F.col("text")), parse_date), lambda day: day.isNotNull()).alias("has")).collect()
    assert all(x.may or not x.has for x in held)
    assert [x.line_no for x in held if x.has and x.may] == [x.line_no for x in held if x.has]
    assert not held[3].may and not held[7].may and not held[10].may


def test_only_the_needed_fields_are_typed(spark):
    """Repaired totals and dates don't type line items or texts; labels of one kind keep the readings of that kind only."""
    schema = []
    original = q.written
    q.written = lambda df, name: schema.append((name, df.columns)) or original(df, name)
    try:
        q.repaired(spark, "/root/testdata/sf0.001")
    finally:
        q.written = original
    assert dict(schema)["invoices"] == ["doc_id", "invoice_date", "total_amount", "error", "n_attempts"]
    labels = evaluate.label_rows(spark.sql("SELECT 1L AS doc_id, 'a' AS company"), {"company": "company"})
    assert labels.collect()[0].asDict() == {"doc_id": 1, "label_field": "company", "field": "vendor_name", "label": "a"}


def test_review_rows_and_items_are_not_broadcast(spark):
    docs = written(spark.sql("SELECT id AS doc_id, '' AS file_name, CAST(NULL AS STRING) AS error, 1 AS n_pages, 1D AS seconds, array('x') AS warnings FROM range(50)"), "docs")
    fields = written(spark.sql("SELECT id AS doc_id, CAST(NULL AS INT) AS item_no, 'total_amount' AS field, 'low' AS confidence FROM range(50)"), "fields")
    items = written(spark.sql("SELECT id AS doc_id, array(named_struct('total', 1D)) AS line_items FROM range(50)"), "invoices")
    for found in (export.review_rows(docs, fields), export.item_rows(docs, items)):
        assert found.count() == 50 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_windows_build_no_lists(spark):
    """Runs of lines with missing texts and boxes are those of a plain loop, without a list of lines for each line."""
    rows = [(d, p, n, None if (d + n) % 5 == 0 else f"t{d}.{n}", None if (d + n) % 7 == 0 else (float(n), float(-n), float(n * d % 11), 2.0 * n, p)) for d in range(6) for p in range(2) for n in range(p * 20, p * 20 + d * 2)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, box struct<x0: double, y0: double, x1: double, y1: double, page: int>")
    for most in (1, 3, 6):
        expected = set()
        for i, (d, p, n, *_) in enumerate(rows):
            for size in range(1, most + 1):
                held = rows[i : i + size]
                if len(held) == size and all(x[:2] == (d, p) for x in held):
                    edges = [[x[4][k] for x in held if x[4]] for k in range(4)]
                    x0, y0, x1, y1 = (pick(e) if e else None for pick, e in zip((min, min, max, max), edges))
                    expected.add((d, p, n, size, " ".join(x[3] for x in held if x[3] is not None), x0, y0, x1, y1))
        got = match.windows(lines, most)
        assert {tuple(r) for r in got.select("doc_id", "page", "start", "size", "text", "box.x0", "box.y0", "box.x1", "box.y1").collect()} == expected
        assert "collect_list" not in got._jdf.queryExecution().toString()


def disk_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_shuffles_of_a_written_table_are_deleted(spark):
    """Once a table is written its shuffles leave the disk; the session keeps its own settings, also after a failure."""
    before, held = {x: spark.conf.get(x, None) for x in WRITING}, disk_files(spark)
    table = written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10  # they are deleted beside the job's end
    while disk_files(spark) > held and time.time() < until:
        time.sleep(0.1)
    assert disk_files(spark) <= held and table.count() == 7
    with pytest.raises(Exception):
        written(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "failed").count()
    assert {x: spark.conf.get(x, None) for x in WRITING} == before


def test_matched_fields_are_stored_by_kind(spark):
    """Fields and lines are moved once by document for each kind; nothing is moved to put the kinds together."""
    invoices = spark.sql("SELECT id AS doc_id, 'abcdef' AS vendor_name, CAST(NULL AS STRING) AS vendor_address, 'INV1' AS invoice_number, DATE'2024-03-05' AS invoice_date, 'MYR' AS currency, 12.5D AS subtotal, CAST(NULL AS DOUBLE) AS tax, 13D AS total_amount, array(named_struct('description', 'bolt', 'quantity', 2D, 'unit_price', CAST(NULL AS DOUBLE), 'total', 12.5D)) AS line_items FROM range(20)")
    box = "named_struct('x0', 0D, 'y0', 20D * n, 'x1', 1D, 'y1', 20D * n + 16, 'page', 0)"
    lines = written(spark.sql(f"SELECT id AS doc_id, 0 AS page, n AS line_no, text, {box} AS box FROM range(20), VALUES (0, 'abcdef'), (1, 'Date: 05/03/2024'), (2, 'bolt 2 pcs 12.50'), (3, 'TOTAL RM 13.00') AS t(n, text)"), "lines")
    seen = []
    original = match.written
    match.written = lambda df, name: seen.append((name, df)) or original(df, name)
    try:
        found = match.match_fields(match.long_fields(match.by_document(invoices)), lines)
    finally:
        match.written = original
    got = {(x.item_no, x.field): (x.confidence, x.matched_text) for x in found.where("doc_id = 7").collect()}
    assert len(got) == 12 and found.count() == 240
    assert got[(0, "total")] == ("high", "bolt 2 pcs 12.50") and got[(0, "quantity")] == ("high", "bolt 2 pcs 12.50") and got[(None, "total_amount")] == ("high", "TOTAL RM 13.00")
    assert got[(None, "subtotal")] == ("high", "bolt 2 pcs 12.50") and got[(None, "vendor_name")] == ("high", "abcdef") and got[(None, "currency")][0] == "high" and got[(None, "tax")] == (None, None)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    with settings_of(spark, WRITING):
        numbers = seen[2][1].select("*")._jdf.queryExecution().executedPlan().toString()
    assert "cents" in numbers and "REPARTITION_BY_COL" in numbers and "ENSURE_REQUIREMENTS" not in numbers


def test_only_repairable_fields_are_moved_by_the_fallback(spark):
    """Totals and dates are stored and joined; all other fields pass by."""
    fields = spark.sql("SELECT id AS doc_id, CAST(NULL AS INT) AS item_no, field, 'text' AS kind, CAST(NULL AS STRING) AS value, CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS DATE) AS value_date, 'low' AS confidence, CAST(NULL AS STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, page: INT>) AS box, 0D AS match_score, CAST(NULL AS STRING) AS matched_text, 'model' AS source FROM range(5), VALUES ('vendor_name'), ('total_amount'), ('subtotal') AS t(field)")
    lines = spark.sql("SELECT id AS doc_id, 0 AS page, 0 AS line_no, 'TOTAL 13.00' AS text, named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 16D, 'page', 0) AS box FROM range(5)")
    stored = {}
    original = fallback.written
    fallback.written = lambda df, name: stored.setdefault(name, original(df, name))
    try:
        done = fallback.apply_fallback(fields, lines)
    finally:
        fallback.written = original
    assert {x.field for x in stored["asked"].select("field").distinct().collect()} == {"total_amount"}
    got = {(x.doc_id, x.field): (x.value_num, x.source) for x in done.collect()}
    assert len(got) == 15 and got[(3, "total_amount")] == (13.0, "ocr_fallback") and got[(3, "subtotal")] == (None, "model")
