"""Box arithmetic as columns. A box is x, y, width, height from the top left, y downwards.

Boxes are struct columns or the four columns of a frame (``box()`` makes the struct). Everything is
a built-in expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 2) -> Column:
    """Round halves towards plus infinity, at any sign."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x", "y", "width", "height")])


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def x_overlap(a: Column, b: Column) -> Column:
    """Signed: negative is the gap between them."""
    return F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])


def y_overlap(a: Column, b: Column) -> Column:
    return F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])


def overlap_area(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), x_overlap(a, b)) * F.greatest(F.lit(0.0), y_overlap(a, b))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return _share(overlap_area(a, b), F.least(area(a), area(b)))


def area_similarity(a: Column, b: Column) -> Column:
    return _share(F.least(area(a), area(b)), F.greatest(area(a), area(b)))


def horizontal_overlap_ratio(a: Column, b: Column) -> Column:
    return _share(F.greatest(F.lit(0.0), x_overlap(a, b)), F.least(a["width"], b["width"]))


def vertical_overlap_ratio(a: Column, b: Column) -> Column:
    return _share(F.greatest(F.lit(0.0), y_overlap(a, b)), F.least(a["height"], b["height"]))


def touches(a: Column, b: Column, gap: float) -> Column:
    return (x_overlap(a, b) >= -gap) & (y_overlap(a, b) >= -gap)


def visible(b: Column, page_width: Column, page_height: Column) -> Column:
    """Clipped to the page."""
    left, top = F.greatest(F.lit(0.0), b["x"]), F.greatest(F.lit(0.0), b["y"])
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(0.0), F.least(page_width, right(b)) - left).alias("width"), F.greatest(F.lit(0.0), F.least(page_height, bottom(b)) - top).alias("height"))


def pad_and_clamp(b: Column, page_width: Column, page_height: Column, pad: float, pad_y: float | None = None) -> Column:
    """Grown on all sides, kept on the page, rounded to two digits."""
    pad_y = pad if pad_y is None else pad_y
    left, top = F.greatest(F.lit(0.0), b["x"] - pad), F.greatest(F.lit(0.0), b["y"] - pad_y)
    r, d = F.least(page_width, right(b) + pad), F.least(page_height, bottom(b) + pad_y)
    return F.struct(half_up(left).alias("x"), half_up(top).alias("y"), half_up(F.greatest(F.lit(0.0), r - left)).alias("width"), half_up(F.greatest(F.lit(0.0), d - top)).alias("height"))


def union_aggs(x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> list[Column]:
    """Aggregates x, y, width, height of the envelope of a group's boxes."""
    left, top = F.min(x), F.min(y)
    return [half_up(left).alias("x"), half_up(top).alias("y"), half_up(F.max(F.col(x) + F.col(width)) - left).alias("width"), half_up(F.max(F.col(y) + F.col(height)) - top).alias("height")]


def rect_to_box(rect: Column, page_height: Column, view_x: float = 0.0, view_y: float = 0.0) -> Column:
    """A bottom-left array [x1, y1, x2, y2] (corners in any order) as a box."""
    x1, x2 = F.least(rect[0], rect[2]), F.greatest(rect[0], rect[2])
    y1, y2 = F.least(rect[1], rect[3]), F.greatest(rect[1], rect[3])
    return F.struct(half_up(x1 - view_x).alias("x"), half_up(page_height - (y2 - view_y)).alias("y"), half_up(x2 - x1).alias("width"), half_up(y2 - y1).alias("height"))


def quad_boxes(points: Column, page_height: Column) -> Column:
    """Eight numbers a quadrilateral, as the array of their envelopes."""

    def one(i: Column) -> Column:
        xs = [F.get(points, i * 8 + k) for k in (0, 2, 4, 6)]
        ys = [F.get(points, i * 8 + k) for k in (1, 3, 5, 7)]
        return F.struct(half_up(F.least(*xs)).alias("x"), half_up(page_height - F.greatest(*ys)).alias("y"), half_up(F.greatest(*xs) - F.least(*xs)).alias("width"), half_up(F.greatest(*ys) - F.least(*ys)).alias("height"))

    n = F.floor(F.size(points) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<x:double,y:double,width:double,height:double>>"))


def matrix_font_size(m: Column, fallback: float = 0.0) -> Column:
    """Larger scale of a text matrix [a, b, c, d, ...]."""
    size = F.greatest(F.hypot(m[0], m[1]), F.hypot(m[2], m[3]))
    return F.when(size > 1e-6, size).otherwise(F.lit(fallback))
