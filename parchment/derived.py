"""For queries and tests: document tables derived from the star schema, as one SQL text that Spark and DuckDB both run.

Each order becomes an invoice: OCR lines with boxes and pages, a model's JSON answer with
seeded damage, and the undamaged labels. Amounts are written from whole cents, so both
engines print the same digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES_PER_PAGE = 8
# What the two dialects spell differently.
SPARK = {"each": "explode(array({}))", "line": "named_struct('line_no', CAST({} AS INT), 'text', {})", "commas": "format_number({}, 0)", "dmy": "date_format({}, 'dd/MM/yyyy')", "iso": "date_format({}, 'yyyy-MM-dd')", "joined": "listagg({}, ', ') WITHIN GROUP (ORDER BY {})", "box": "named_struct('x0', {}, 'y0', {}, 'x1', {}, 'y1', {}, 'page', {})"}
DUCK = {"each": "unnest([{}])", "line": "{{'line_no': CAST({} AS INT), 'text': {}}}", "commas": "format('{{:,}}', {})", "dmy": "strftime({}, '%d/%m/%Y')", "iso": "strftime({}, '%Y-%m-%d')", "joined": "string_agg({}, ', ' ORDER BY {})", "box": "{{'x0': {}, 'y0': {}, 'x1': {}, 'y1': {}, 'page': {}}}"}


def money(value: str, dialect: dict[str, str] | None = None) -> str:
    """SQL of a non-negative amount with two decimals; with a dialect, thousands get commas."""
    cents = f"CAST(round({value} * 100) AS BIGINT)"
    whole = f"CAST(floor({cents} / 100) AS BIGINT)"
    shown = dialect["commas"].format(whole) if dialect else f"CAST({whole} AS VARCHAR(20))"
    return f"({shown} || '.' || lpad(CAST({cents} % 100 AS VARCHAR(20)), 2, '0'))"


def ctes(dialect: dict[str, str]) -> str:
    """Common table expressions items, heads, raw_lines, ocr_lines, model_answers and labels_of; to follow WITH."""
    d = dialect
    total, total_plain = money("o_totalprice", d), money("o_totalprice")
    damaged = money("(o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 0.37 ELSE 0 END)", d)
    # Amounts that say so stand right of their label, on its row.
    beside = "(doc_id % 6 = 0 AND text LIKE 'RM % net')"
    left, row = f"(CASE WHEN {beside} THEN 300 ELSE 20 END)", f"(line_no - CASE WHEN {beside} THEN 1 ELSE 0 END)"
    box = d["box"].format(f"CAST({left} AS DOUBLE)", f"CAST(20 * {row} AS DOUBLE)", f"CAST({left} + 8 * length(text) AS DOUBLE)", f"CAST(20 * {row} + 16 AS DOUBLE)", "page")
    address = "(c_mktsegment || ' street ' || CAST(o_orderkey % 97 AS VARCHAR(20)))"
    vendor = "CASE WHEN o_orderkey % 19 = 0 THEN 'acme holdings ltd' WHEN o_orderkey % 13 = 0 THEN 'qqqqqq' || substr(c_name, 7) ELSE c_name END"
    # JSON numbers with three decimals, with an exponent, and none.
    unit_json = "CASE l_orderkey % 3 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || '.125' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || 'e3' ELSE 'null' END"
    item_json = f"'{{\"description\": \"' || p_name || '\", \"quantity\": ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || ', \"unit_price\": ' || {unit_json} || ', \"total\": \"' || price || '\"}}'"
    head_lines = ", ".join(
        d["line"].format(number, text)
        for number, text in (
            ("0", "c_name"),
            ("1", "'Invoice No: INV' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0')"),
            ("2", "'Date: ' || " + d["dmy"].format("o_orderdate")),
            ("3 + n_items", f"'SUBTOTAL ' || {total_plain}"),
            ("4 + n_items", f"CASE WHEN o_orderkey % 3 = 0 THEN 'GRAND TOTAL' ELSE 'TOTAL RM ' || {total} END"),
            ("5 + n_items", f"CASE WHEN o_orderkey % 3 = 0 THEN 'RM ' || {total} || CASE WHEN o_orderkey % 6 = 0 THEN ' net' ELSE '' END END"),
        )
    )
    return f"""
    items AS (
        SELECT l_orderkey, l_quantity, l_extendedprice, p_name, {money("l_extendedprice", d)} AS price,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS item_no
        FROM lineitem JOIN part ON p_partkey = l_partkey),
    counts AS (SELECT l_orderkey, CAST(count(*) AS INT) AS n_items FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
    sums AS (SELECT l_orderkey, {d["joined"].format(item_json, "item_no")} AS item_json FROM items GROUP BY l_orderkey),
    heads AS (
        SELECT o_orderkey, o_orderdate, o_totalprice, c_name, c_mktsegment, coalesce(n_items, 0) AS n_items
        FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN counts ON l_orderkey = o_orderkey),
    head_lines AS (SELECT o_orderkey AS doc_id, {d["each"].format(head_lines)} AS entry FROM heads),
    raw_lines AS (
        SELECT doc_id, entry.line_no AS line_no, entry.text AS text FROM head_lines WHERE entry.text IS NOT NULL
        UNION ALL SELECT l_orderkey, 2 + item_no, p_name || ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || ' pcs ' || price FROM items),
    paged AS (SELECT doc_id, CAST(floor(line_no / {LINES_PER_PAGE}) AS INT) AS page, CAST(line_no AS INT) AS line_no, text FROM raw_lines),
    ocr_lines AS (SELECT doc_id, page, line_no, text, {box} AS box, CAST(0.9 AS DOUBLE) AS confidence FROM paged),
    model_answers AS (
        SELECT o_orderkey AS doc_id, 'v3' AS prompt_version,
               CASE WHEN o_orderkey % 5 = 0 THEN '```json' || chr(10) ELSE '' END
               || '{{"vendor_name": "' || {vendor} || '", "vendor_address": ' || CASE o_orderkey % 10 WHEN 3 THEN '"' || {address} || '"' WHEN 7 THEN '"PO box, ' || {address} || '"' ELSE 'null' END || ', "invoice_number": "INV' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') || '", "invoice_date": '
               || CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE '"' || {d["dmy"].format("o_orderdate")} || '"' END
               || ', "currency": "RM", "subtotal": ' || CASE WHEN o_orderkey % 4 = 1 THEN {total_plain} ELSE '"' || {total_plain} || '"' END || ', "total_amount": "' || {damaged} || '", "line_items": [' || coalesce(item_json, '') || ']'
               || CASE WHEN o_orderkey % 17 = 0 THEN ',' ELSE '' END || '}}'
               || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '```' ELSE '' END AS raw
        FROM heads LEFT JOIN sums ON l_orderkey = o_orderkey),
    labels_of AS (
        SELECT o_orderkey AS doc_id, c_name AS company, {d["iso"].format("o_orderdate")} AS date_text, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE {total_plain} END AS total,
               CASE WHEN o_orderkey % 10 = 1 THEN ' ' ELSE upper({address}) END AS address FROM heads)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables as a DataFrame; nothing is registered in the session."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem", "part")}
    text = f"WITH {ctes(SPARK)} SELECT * FROM {name}"
    # spark.sql takes DataFrames by name in braces; the text's own braces are doubled.
    text = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n")
    return spark.sql(text, **tables)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ocr_lines")


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "model_answers")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "labels_of")
