"""Boxes and rectangles as column expressions.

A box is struct<x, y, x2, y2> in points, origin at the bottom left. A rect is
struct<left, top, width, height> as shares of the page, origin at the top left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def box(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2"))


def rect(box: Column, width: Column, height: Column) -> Column:
    """The box on a page of this size, clamped to the page; an error if nothing is left of it."""
    left, right = _clamp(box["x"] / width), _clamp(box["x2"] / width)
    top, bottom = _clamp(1 - box["y2"] / height), _clamp(1 - box["y"] / height)
    found = F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))
    return F.when((right > left) & (bottom > top), found).otherwise(F.raise_error(F.lit("empty rectangle")).cast("struct<left:double,top:double,width:double,height:double>"))


def valid_rect(rect: Column) -> Column:
    slack = 1.001
    return (rect["left"] >= 0) & (rect["top"] >= 0) & (rect["width"] > 0) & (rect["height"] > 0) & (rect["left"] + rect["width"] <= slack) & (rect["top"] + rect["height"] <= slack)


def page_box(rect: Column, page: Column) -> Column:
    """The rect in points within the page's crop box; an error unless it is valid."""
    width, height = page["x2"] - page["x"], page["y2"] - page["y"]
    left, high = page["x"] + rect["left"] * width, page["y2"] - rect["top"] * height
    found = box(left, high - rect["height"] * height, left + rect["width"] * width, high)
    return F.when(valid_rect(rect), found).otherwise(F.raise_error(F.lit("rectangle out of bounds")).cast("struct<x:double,y:double,x2:double,y2:double>"))


def inside(point: Column, box: Column, tolerance: float = 2.0) -> Column:
    """Whether the point's own origin (x, y) is in the box, give or take the tolerance."""
    return point["x"].between(box["x"] - tolerance, box["x2"] + tolerance) & point["y"].between(box["y"] - tolerance, box["y2"] + tolerance)


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x"], F.lit(0.0)) * F.greatest(box["y2"] - box["y"], F.lit(0.0))


def common_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def contains(outer: Column, inner: Column, share: float = 0.8) -> Column:
    """Whether at least ``share`` of the inner box is in the outer; never for an empty inner box."""
    own = area(inner)
    return (own > 0) & (common_area(outer, inner) >= share * own)


def overlap(a: Column, a2: Column, b: Column, b2: Column) -> Column:
    """The common part of two intervals over the shorter one; 0 if either is empty."""
    short = F.least(a2 - a, b2 - b)
    return F.when(short > 0, F.greatest(F.least(a2, b2) - F.greatest(a, b), F.lit(0.0)) / short).otherwise(F.lit(0.0))


def glyph_box(glyph: Column) -> Column:
    return F.coalesce(glyph["visual_box"], glyph["box"])


def rotated(rect: Column, degrees: Column) -> Column:
    """The rect on its page turned clockwise by 0, 90, 180 or 270 degrees."""
    left, top, width, height = (rect[c] for c in ("left", "top", "width", "height"))

    def made(a, b, c, d):
        return F.struct(a.alias("left"), b.alias("top"), c.alias("width"), d.alias("height"))

    turn = F.pmod(degrees, F.lit(360))
    return (
        F.when(turn == 90, made(1 - top - height, left, height, width))
        .when(turn == 180, made(1 - left - width, 1 - top - height, width, height))
        .when(turn == 270, made(top, 1 - left - width, height, width))
        .otherwise(made(left, top, width, height))
    )


def union_box(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Aggregate: the smallest box around all."""
    return F.struct(F.min(x).alias("x"), F.min(y).alias("y"), F.max(x2).alias("x2"), F.max(y2).alias("y2"))


def quadrant(angle: Column, tolerance: float = 5.0) -> Column:
    """The multiple of 90 degrees within the tolerance of the angle, from 0 to 270, or null."""
    near = F.bround(angle / 90) * 90
    return F.when(F.abs(angle - near) <= tolerance, F.pmod(near, F.lit(360)).cast("int"))
