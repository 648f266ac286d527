"""Boxes: struct<x0, y0, x1, y1, page>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_box(x0, y0, x1, y1, page) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), page.alias("page"))


def of_polygon(xs: Column, ys: Column, page: Column) -> Column:
    return make_box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), page)


def union(a: Column, b: Column) -> Column:
    return make_box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), a.page)


def union_all(boxes: Column) -> Column:
    """Of an array of boxes of one page."""
    return make_box(
        F.array_min(F.transform(boxes, lambda b: b.x0)),
        F.array_min(F.transform(boxes, lambda b: b.y0)),
        F.array_max(F.transform(boxes, lambda b: b.x1)),
        F.array_max(F.transform(boxes, lambda b: b.y1)),
        boxes[0].page,
    )


def height(box: Column) -> Column:
    return box.y1 - box.y0


def center_y(box: Column) -> Column:
    return (box.y0 + box.y1) / 2


def within_rows(a: Column, b: Column, rows: float) -> Column:
    """On one page, with centres at most `rows` heights apart."""
    return (a.page == b.page) & (F.abs(center_y(a) - center_y(b)) <= rows * F.greatest(height(a), height(b), F.lit(1.0)))


def scaled_size(width: Column, height_: Column, longest: int) -> Column:
    """Size that fits `longest` on the longer side; never larger than given."""
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height_))
    return F.struct(F.greatest(F.lit(1), F.round(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height_ * scale).cast("int")).alias("height"))
