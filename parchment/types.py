"""Schemas of the canonical tables, as Spark DDL."""

# The names and types of records, as they are exchanged.
BOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
LINE_ITEM = "struct<description:string,quantity:double,unit_price:double,total:double>"
INVOICE = (
    "struct<vendor_name:string,vendor_address:string,invoice_number:string,invoice_date:date,currency:string,"
    f"line_items:array<{LINE_ITEM}>,subtotal:double,tax:double,total_amount:double>"
)
OCR_LINE = f"doc_id bigint, page int, line_no int, text string, box {BOX}, confidence double"
FIELD = f"doc_id bigint, item_no int, field string, value string, value_num double, value_date date, confidence string, box {BOX}, match_score double, matched_text string, source string"
PREDICTION = "key string, labels map<string,string>, predicted map<string,string>, confidence map<string,string>, source map<string,string>, error string, seconds double, seq bigint"

# Field order and the labels shown to people.
FIELD_LABELS = {
    "vendor_name": "Vendor",
    "vendor_address": "Vendor address",
    "invoice_number": "Invoice number",
    "invoice_date": "Invoice date",
    "currency": "Currency",
    "subtotal": "Subtotal",
    "tax": "Tax",
    "total_amount": "Total",
}
ITEM_LABELS = {"description": "Description", "quantity": "Quantity", "unit_price": "Unit price", "total": "Line total"}
NUMBER_FIELDS = ("subtotal", "tax", "total_amount")
BOTTOM_FIELDS = ("subtotal", "tax", "total_amount")
# Evaluation label -> field.
LABEL_FIELDS = {"company": "vendor_name", "date": "invoice_date", "address": "vendor_address", "total": "total_amount"}
