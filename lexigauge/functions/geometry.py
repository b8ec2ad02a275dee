"""Box expressions. A box is a struct (x1, y1, x2, y2) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column


def box(x1, y1, x2, y2) -> Column:
    names = ("x1", "y1", "x2", "y2")
    return F.struct(*[column(c).cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), names, strict=True)])


def box_of_array(corners: Column | str, x=None, y=None, width=None, height=None) -> Column:
    """From four corners, else from a corner and a size; what is missing is 0."""
    c = column(corners)
    zero = lambda v: F.coalesce(column(v).cast("double"), F.lit(0.0)) if v is not None else F.lit(0.0)
    left, top = zero(x), zero(y)
    return F.when(F.size(c) == 4, box(c[0], c[1], c[2], c[3])).otherwise(
        box(left, top, left + zero(width), top + zero(height))
    )


def width(b: Column | str) -> Column:
    return F.greatest(F.lit(1.0), column(b)["x2"] - column(b)["x1"])


def height(b: Column | str) -> Column:
    return F.greatest(F.lit(1.0), column(b)["y2"] - column(b)["y1"])


def center_x(b: Column | str) -> Column:
    return (column(b)["x1"] + column(b)["x2"]) / 2


def center_y(b: Column | str) -> Column:
    return (column(b)["y1"] + column(b)["y2"]) / 2


def _shared(a: Column, b: Column, lo: str, hi: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))


def overlap_ratio(inner: Column | str, outer: Column | str) -> Column:
    """Intersection over the inner box's area (1 at least)."""
    a, b = column(inner), column(outer)
    area = F.greatest(F.lit(1.0), (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]))
    return _shared(a, b, "x1", "x2") * _shared(a, b, "y1", "y2") / area


def x_overlap(a: Column | str, b: Column | str) -> Column:
    return _shared(column(a), column(b), "x1", "x2") / F.least(width(a), width(b))


def y_overlap(a: Column | str, b: Column | str) -> Column:
    return _shared(column(a), column(b), "y1", "y2") / F.least(height(a), height(b))


def meets(a: Column | str, b: Column | str) -> Column:
    """Whether the interiors meet: cheap comparisons to put before an overlap ratio."""
    a, b = column(a), column(b)
    return (a["y2"] > b["y1"]) & (a["y1"] < b["y2"]) & (a["x2"] > b["x1"]) & (a["x1"] < b["x2"])


def geometric_key(b: Column | str, tolerance: float = 12.0) -> Column:
    """(line, y1, x1): boxes in rough lines; halves round to even."""
    c = column(b)
    line = F.rint(c["y1"] / F.greatest(F.lit(tolerance), 0.5 * height(b)))
    return F.struct(line.alias("line"), c["y1"].alias("y1"), c["x1"].alias("x1"))


def simple_key(b: Column | str, ratio: float = 0.6) -> Column:
    line = F.rint(center_y(b) / (height(b) * ratio))
    return F.struct(line.alias("line"), center_y(b).alias("cy"), center_x(b).alias("cx"))


def zone_order_key(order: Column | str, reading_order: Column | str, b: Column | str, index: Column | str) -> Column:
    """Given order, else given reading order, else the center, else the row's own number."""
    given = F.coalesce(column(order), column(reading_order)).cast("double")
    return F.struct(
        F.when(given.isNotNull(), 0).when(column(b).isNotNull(), 1).otherwise(2).alias("kind"),
        F.coalesce(given, center_y(b)).alias("first"),
        F.when(given.isNull(), center_x(b)).alias("second"),
        column(index).alias("index"),
    )


def crop(b: Column | str, page_width: Column | str, page_height: Column | str, padding: int = 2) -> Column:
    """The box padded, cut to whole pixels and to the page; null if nothing is left."""
    c = column(b)
    low = lambda v: F.greatest(F.lit(0), F.floor(v).cast("int") - padding)
    high = lambda v, most: F.least(column(most).cast("int"), F.ceil(v).cast("int") + padding)
    out = F.struct(
        low(c["x1"]).alias("x1"),
        low(c["y1"]).alias("y1"),
        high(c["x2"], page_width).alias("x2"),
        high(c["y2"], page_height).alias("y2"),
    )
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)
