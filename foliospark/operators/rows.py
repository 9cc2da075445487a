"""From glyphs to logical rows, and the rows' reading order.

Glyphs: doc_id, page_index, para_id, ch, x, y, x2, y2, font_id, font_size, pos (a page's
own order); kind and vertical of their paragraph, if these are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import running

PAGE = ["doc_id", "page_index"]


def _anchored(share: float = 0.35) -> Callable[[float, float], int]:
    """Line numbers for glyphs in the order y down, x up.

    A glyph joins the latest line if that line's first glyph is within ``share`` of
    this glyph's size; else it opens a line. Anchors, not gaps, decide: a slow drift
    breaks a line.
    """
    line, anchor = -1, 0.0

    def step(y: float, size: float) -> int:
        nonlocal line, anchor
        if line < 0 or abs(anchor - y) > share * max(1.0, size):
            line, anchor = line + 1, y
        return line

    return step


def baseline_lines(y: list[float], size: list[float], share: float = 0.35) -> list[int]:
    return list(map(_anchored(share), y, size))


def lines(glyphs: DataFrame) -> DataFrame:
    """The glyphs with ``line``, from 0 in each paragraph."""
    return running(glyphs, [*PAGE, "para_id"], [F.desc("y"), "x", "pos"], ["y", "font_size"], _anchored, "line", "int")


def segments(glyphs: DataFrame) -> DataFrame:
    """``segment`` within each line, broken where the gap is over 24 points and three sizes; ``space`` where one is missing."""
    across = Window.partitionBy(*PAGE, "para_id", "line").orderBy("x", "pos")
    gap = F.col("x") - F.lag("x2").over(across)
    found = glyphs.withColumn("gap", gap).withColumn("blank_before", F.lag(F.endswith("ch", F.lit(" "))).over(across))
    found = found.withColumn("broken", F.coalesce(F.col("gap") > F.greatest(F.lit(24.0), 3 * F.col("font_size")), F.lit(False)).cast("int"))
    found = found.withColumn("segment", F.sum("broken").over(across))
    missing = (F.col("broken") == 0) & (F.col("gap") > F.greatest(F.lit(0.6), 0.16 * F.col("font_size"))) & ~F.coalesce("blank_before", F.lit(False))
    return found.withColumn("space", F.coalesce(missing, F.lit(False))).drop("gap", "blank_before", "broken")


def ordered_text(text: Column, *order: str) -> Column:
    """Aggregate: the texts in order, joined without anything between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda x: x["_t"]), "")


def dominant(frame: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """(keys, value): the most frequent value of each group, of equals the one that comes first (by pos if no order is given)."""
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*(order or ("pos",)))).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_first")).alias(value))


def admissible(glyphs: DataFrame) -> DataFrame:
    """Glyphs with a box, a style and a character, of paragraphs that aren't vertical or of a protected kind."""
    good = F.col("ch") != ""
    for needed in ("x", "y", "x2", "y2", "font_size"):
        good = good & F.col(needed).isNotNull()
    if "vertical" in glyphs.columns:
        good = good & ~F.coalesce("vertical", F.lit(False))
    if "kind" in glyphs.columns:
        good = good & ~T.of_kind(F.col("kind"), T.PROTECTED_KINDS)
    return glyphs.where(good)


def rows_from_glyphs(glyphs: DataFrame, pages: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, page_index, para_id, line, segment, text, kind, font_id, font_size, left, top, width, height, tail_left, and with ``fonts`` font_bold and font_italic).

    ``pages``: doc_id, page_index, width, height of the crop box, and its corner crop_x
    and crop_y unless that is 0. ``fonts``: doc_id, page_index, font_id, bold, italic.
    Rows that leave the crop box by over 2 points and blank ones are left out;
    font_size is the median, font_id the most frequent, of equals the first.
    tail_left: where the last glyph begins.
    """
    corner = [F.col(c).cast("double").alias(c) if c in pages.columns else F.lit(0.0).alias(c) for c in ("crop_x", "crop_y")]
    frame = pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height"), *corner)
    own = admissible(glyphs)
    own = own if "kind" in own.columns else own.withColumn("kind", F.lit(""))
    parts = segments(lines(own))
    key = [*PAGE, "para_id", "line", "segment"]
    text = F.concat(F.when(F.col("space"), " ").otherwise(""), "ch")
    found = parts.groupBy(*key).agg(
        F.trim(ordered_text(text, "x", "pos")).alias("text"), F.first("kind").alias("kind"), F.median("font_size").alias("font_size"),
        F.min("x").alias("_x"), F.min("y").alias("_y"), F.max("x2").alias("_x2"), F.max("y2").alias("_y2"), F.max("x").alias("_tail"),
    )
    found = found.where("text <> ''").join(frame, PAGE).where("page_width > 0 and page_height > 0")
    found = found.where("_x >= crop_x - 2 and _y >= crop_y - 2 and _x2 <= crop_x + page_width + 2 and _y2 <= crop_y + page_height + 2")
    across, down = F.col("page_width"), F.col("page_height")
    found = found.withColumn("left", F.greatest((F.col("_x") - F.col("crop_x")) / across, F.lit(0.0))).withColumn("top", F.greatest((F.col("crop_y") + down - F.col("_y2")) / down, F.lit(0.0)))
    found = found.withColumn("width", (F.col("_x2") - F.col("_x")) / across).withColumn("height", (F.col("_y2") - F.col("_y")) / down).withColumn("tail_left", (F.col("_tail") - F.col("crop_x")) / across)
    found = found.drop("_x", "_y", "_x2", "_y2", "_tail", "page_width", "page_height", "crop_x", "crop_y").join(dominant(parts, key, "font_id", "x", "pos"), key)
    if fonts is None:
        return found
    traits = fonts.select(*PAGE, "font_id", F.col("bold").alias("font_bold"), F.col("italic").alias("font_italic"))
    return found.join(traits, [*PAGE, "font_id"], "left").withColumn("font_bold", F.coalesce("font_bold", F.lit(False))).withColumn("font_italic", F.coalesce("font_italic", F.lit(False)))


def reading_order(rows: DataFrame, wide: float = 0.6) -> DataFrame:
    """``reading_pos`` from 1 within each page.

    The right column begins at 45 % of the width; the left one's rows begin before and
    end before 58 %. With at least three rows of each the page has two columns: rows
    of ``wide`` or more of the width part it into bands, and within a band the left
    column comes first. Else from the top, then from the left.
    """
    page = Window.partitionBy(*PAGE)
    left, right = (F.col("left") < 0.45) & (F.col("left") + F.col("width") < 0.58), F.col("left") >= 0.45
    rows = rows.withColumn("_span", F.col("width") >= wide).withColumn("_right", right)
    rows = rows.withColumn("_two", (F.sum(left.cast("int")).over(page) >= 3) & (F.sum(right.cast("int")).over(page) >= 3))
    down = page.orderBy("top").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_band", F.when(F.col("_two"), F.sum(F.col("_span").cast("int")).over(down)).otherwise(0))
    last = ["pos"] if "pos" in rows.columns else []
    order = page.orderBy("_band", F.when(F.col("_two"), ~F.col("_span")).otherwise(False), F.when(F.col("_two") & ~F.col("_span"), F.col("_right")).otherwise(False), "top", "left", *last)
    return rows.withColumn("reading_pos", F.row_number().over(order)).drop("_span", "_right", "_two", "_band")
