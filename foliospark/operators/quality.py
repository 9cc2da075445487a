"""Text quality of pages and what is decided from it."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import quadrant
from .pages import by_group

PAGE = ["doc_id", "page_index"]


def hidden_shares(spans: DataFrame) -> DataFrame:
    """(doc_id, page_index, hidden_share): the share of a page's characters that are drawn invisibly. spans: mode, n_chars."""
    return spans.groupBy(*PAGE).agg(F.coalesce(F.sum(F.when(F.col("mode") == 3, F.col("n_chars")).otherwise(0)) / F.nullif(F.sum("n_chars"), F.lit(0)), F.lit(0.0)).alias("hidden_share"))


def page_quality(pages: DataFrame) -> DataFrame:
    """``quality`` of pages: bitmap-text, image-text, scanned or healthy, the first that holds.

    text: of the body band; image_share: of the body band that images cover, 0
    without any; page_share: of the whole page; hidden_share: of its characters;
    bitmap_fonts, unencoded: whether fonts of drawn glyphs are used, and whether their
    codes are unknown. Text in such fonts is bad if it has over 20 characters and
    unknown codes, over 20 bad characters or many loose letters; other text if it is
    sparse or broken below images that cover over 45 % of the band.
    """
    text = F.col("text")
    bitmap = F.col("bitmap_fonts") & (F.char_length(text) > 20) & (F.col("unencoded") | (T.bad_characters(text) > 20) | T.loose_letters(text))
    image = (F.col("image_share") > 0.45) & (T.text_health(text) != "healthy")
    scanned = (F.col("page_share") >= 0.45) & (F.col("hidden_share") > 0.8)
    return pages.withColumn("quality", F.when(bitmap, "bitmap-text").when(image, "image-text").when(scanned, "scanned").otherwise("healthy"))


def quality_rollup(pages: DataFrame) -> DataFrame:
    """One row a document: the pages of each class in order, without repeats, and their number."""
    classes = ("scanned", "image-text", "bitmap-text", "healthy")
    return pages.groupBy("doc_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("quality") == c, F.col("page_index")))).alias(c.replace("-", "_")) for c in classes), F.count_distinct("page_index").alias("n_pages"))


def merged_lists(parts: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The sorted distinct union of array columns over the parts of a group."""
    return parts.groupBy(*keys).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in columns))


def text_direction(lines: DataFrame, inset: float = 0.06) -> DataFrame:
    """(doc_id, page_index, direction): the quadrant with at least 70 % of at least 80 letters of interior lines; 0 if none has.

    lines: text, angle, vertical, left, top, width, height.
    """
    interior = (F.col("left") >= inset) & (F.col("top") >= inset) & (F.col("left") + F.col("width") <= 1 - inset) & (F.col("top") + F.col("height") <= 1 - inset)
    votes = lines.where(interior & ~F.col("vertical")).withColumn("n", T.letters(F.col("text"))).where("n >= 3").withColumn("q", quadrant(F.col("angle"))).where("q is not null")
    sums = votes.groupBy(*PAGE, "q").agg(F.sum("n").alias("n"))
    best = sums.groupBy(*PAGE).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("q", "n").alias("q"))
    best = best.select(*PAGE, F.when((F.col("total") >= 80) & (F.col("most") >= 0.7 * F.col("total")), F.col("q")).otherwise(0).alias("direction"))
    return lines.select(*PAGE).distinct().join(best, PAGE, "left").withColumn("direction", F.coalesce("direction", F.lit(0)))


def body_gate(requests: DataFrame) -> DataFrame:
    """(doc_id, error): document_no_body_text where no request is for body text."""
    return requests.groupBy("doc_id").agg(F.when(F.sum(F.col("is_body").cast("int")) > 0, F.lit(None).cast("string")).otherwise("document_no_body_text").alias("error"))


def body_request(graphics: Column, label: Column, text: Column) -> Column:
    """A request counts as body if its text is, or if it is a caption's, or with ``graphics`` a graphic's, and has two letters."""
    wanted = label.isin(T.CAPTION_LABELS) | (graphics & label.isin(T.GRAPHIC_LABELS))
    return T.is_body(text, label) | F.coalesce(wanted & (T.letters(F.regexp_replace(text, T.STYLE_MARKER, "")) >= 2), F.lit(False))


def translatable(vertical: Column, prepared: Column, shortest: int = 1) -> Column:
    return ~vertical & prepared.isNotNull() & (F.char_length(F.trim(prepared)) >= shortest)


def empty_outputs(source: DataFrame, output: DataFrame) -> DataFrame:
    """Pages whose output has no text while their source has at least twenty characters."""
    found = source.select(*PAGE, "text").join(output.select(*PAGE, F.col("text").alias("new_text")), PAGE, "left")
    return found.where((F.char_length(F.trim("text")) >= 20) & (F.char_length(F.trim(F.coalesce("new_text", F.lit("")))) == 0)).select(*PAGE)


def reference_threshold(rows: DataFrame) -> DataFrame:
    """(doc_id, threshold): the median size of confirmed reference rows and 15 %; infinite without any."""
    own = rows.groupBy("doc_id").agg((F.median(F.when(F.col("confirmed"), F.col("font_size"))) * 1.15).alias("threshold"))
    return own.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


def line_pitch(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, pitch): the median step between line bottoms, of steps from 4 to 50, over 1.2."""
    step = F.lag("y").over(Window.partitionBy(*PAGE).orderBy(F.desc("y"))) - F.col("y")
    return lines.withColumn("_step", step).where("_step > 4 and _step < 50").groupBy(*PAGE).agg((F.median("_step") / 1.2).alias("pitch"))


def image_shares(images: DataFrame, pages: DataFrame, band: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(doc_id, page_index, image_share): the images' areas within a band of the page's height over the band's, at most 1; pages without images have 0."""
    low, high = F.lit(band[0]) * F.col("height"), F.lit(band[1]) * F.col("height")
    wide = F.greatest(F.least("x2", "width") - F.greatest(F.col("x"), F.lit(0.0)), F.lit(0.0))
    tall = F.greatest(F.least(F.col("y2"), high) - F.greatest(F.col("y"), low), F.lit(0.0))
    sums = images.join(pages.select(*PAGE, "width", "height"), PAGE).groupBy(*PAGE).agg(F.sum(wide * tall).alias("_a"))
    share = F.least(F.coalesce("_a", F.lit(0.0)) / (F.col("width") * (high - low)), F.lit(1.0))
    return pages.join(sums, PAGE, "left").select(*PAGE, share.alias("image_share"))


#: What makes a formula of characters and fonts.
FORMULA_SIGNS, FORMULA_FONTS = "[α-ωΑ-Ω∑∏∫√∞∂∇=+<>]", "math|symbol|cmmi|cmsy|cmex"


def text_formulas(formulas: DataFrame) -> DataFrame:
    """Formulas that are really text: no curves or forms, no mathematical sign or Greek letter, no mathematical font.

    formulas: curves, forms (numbers), chars, fonts (arrays).
    """
    plain = F.forall("chars", lambda c: ~c.rlike(FORMULA_SIGNS)) & F.forall("fonts", lambda f: ~F.lower(f).rlike(FORMULA_FONTS))
    return formulas.where((F.col("curves") == 0) & (F.col("forms") == 0) & plain)


def capped(frame: DataFrame, most: int, what: str) -> DataFrame:
    """The rows; an error if a document has more than ``most``."""
    sizes = frame.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ok", F.assert_true(F.col("_n") <= most, F.lit(f"too many {what}")))
    return frame.join(sizes.where("_ok is null").select("doc_id"), "doc_id", "left_semi")


def checked_entries(entries: DataFrame, most: int = 10_000) -> DataFrame:
    """Entries of known kinds with texts of at most 40,000 and labels of at most 16 characters of a label's shape.

    An error if a document has more than ``most`` entries of any kind.
    """
    label = F.coalesce("label", F.lit(""))
    return capped(entries, most, "entries").where(F.coalesce("kind", F.lit("reference")).isin("reference", "list", "toc") & (F.char_length("text") <= 40_000) & (F.char_length(label) <= 16) & label.rlike(T.ENTRY_LABEL))


def checked_exclusions(exclusions: DataFrame, most: int = 20_000) -> DataFrame:
    """The exclusions; an error if a document has more than ``most``."""
    return capped(exclusions, most, "exclusions")


def label_glyphs(entries: DataFrame) -> DataFrame:
    """``n_label``: how many of an entry's glyphs (array ``chars``, in order) make up its label, blanks aside; null if they don't.

    One pass along the array: what is put together so far, and where it was the label.
    """
    want = F.regexp_replace("label", "[ \\t]", "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("at"))

    def step(a, c):
        text = F.concat(a["text"], F.regexp_replace(c, "[ \\t]", ""))
        seen = a["seen"] + 1
        return F.struct(F.when(a["at"].isNull(), text).otherwise(a["text"]).alias("text"), seen.alias("seen"), F.coalesce(a["at"], F.when(text == want, seen)).alias("at"))

    return entries.withColumn("n_label", F.when(want == "", F.lit(0)).otherwise(F.aggregate("chars", start, step, lambda a: a["at"])))


def tail_glyphs(entries: DataFrame) -> DataFrame:
    """``n_tail``, ``n_leaders``: how many of the last glyphs (array ``chars``, in order) make up ``page_label``, and how many leaders and blanks stand before them; null if they don't.

    Two passes from the right, each with what it has put together so far.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("at"))

    def step(a, c):
        text, seen = F.concat(F.trim(c), a["text"]), a["seen"] + 1
        return F.struct(F.when(a["at"].isNull(), text).otherwise(a["text"]).alias("text"), seen.alias("seen"), F.coalesce(a["at"], F.when(text == F.col("page_label"), seen)).alias("at"))

    def leader(a, c):
        goes = a["goes"] & c.rlike(rf"^[{T.LEADERS} ]*$")
        return F.struct((a["n"] + goes.cast("int")).alias("n"), goes.alias("goes"))

    found = entries.withColumn("n_tail", F.aggregate(F.reverse("chars"), start, step, lambda a: a["at"]))
    before = F.slice(F.reverse("chars"), F.coalesce(F.col("n_tail"), F.lit(0)) + 1, F.greatest(F.size("chars"), F.lit(1)))
    leaders = F.aggregate(before, F.struct(F.lit(0).alias("n"), F.lit(True).alias("goes")), leader, lambda a: a["n"])
    return found.withColumn("n_leaders", F.when(F.col("n_tail").isNotNull(), leaders))


def title_regions(glyphs: DataFrame, pages: DataFrame, words: DataFrame, least: int = 8, most: int = 2, share: float = 0.7) -> DataFrame:
    """(doc_id, page_index, region, x, y, x2, y2): where large drawn glyphs at the top of a page have not been recognised.

    glyphs: x, y (their origins, y down) and w; pages: width, height; words: boxes of
    what was recognised. Glyphs of over 1.35 times the median width in the top fifth
    make rows of origins within 8 points; rows of ``least`` glyphs, less than
    ``share`` of them in words, make regions, which are joined if they are less than
    12 points apart and share some width. Of the first ``most``, those stay that have
    at least 35 % of the page's width and less than ``share`` of their glyphs in words.
    """
    centre = F.col("x") + 0.5 * F.col("w")
    numbered = glyphs.withColumn("n", F.monotonically_increasing_id())
    boxes = words.select(*PAGE, *(F.col(c).alias(f"_{c}") for c in ("x", "y", "x2", "y2")))
    hit = numbered.join(boxes, PAGE).where(centre.between(F.col("_x") - 2, F.col("_x2") + 2) & F.col("y").between(F.col("_y") - 3, F.col("_y2") + 4)).select("n").distinct()
    marked = numbered.join(hit.withColumn("known", F.lit(True)), "n", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def run(page: list):
        typical = statistics.median(g.w for g in page)
        rows: list[list] = []
        for g in page:
            if g.y < 0.2 * g.height and g.w > 1.35 * typical:
                row = next((r for r in rows if abs(r[0].y - g.y) < 8), None)
                if row is None:
                    rows.append([g])
                else:
                    row.append(g)
        found: list[list[float]] = []
        for row in rows:
            if len(row) < least or sum(g.known for g in row) >= share * len(row):
                continue
            box = [min(g.x for g in row) - 3, min(g.y for g in row) - 3, max(g.x + g.w for g in row) + 3, max(g.y for g in row) + 1.9 * statistics.median(g.w for g in row)]
            if found and box[1] - found[-1][3] < 12 and min(box[2], found[-1][2]) > max(box[0], found[-1][0]):
                last = found[-1]
                found[-1] = [min(last[0], box[0]), min(last[1], box[1]), max(last[2], box[2]), max(last[3], box[3])]
            else:
                found.append(box)
        width, height = page[0].width, page[0].height
        for i, (x, y, x2, y2) in enumerate(found[:most]):
            x, y, x2, y2 = max(x, 0.0), max(y, 0.0), min(x2, width), min(y2, height)
            own = [g for g in page if x <= g.x <= x2 and y <= g.y <= y2]
            if x2 - x >= 0.35 * width and own and sum(g.known for g in own) < share * len(own):
                yield page[0].doc_id, page[0].page_index, i, x, y, x2, y2

    full = marked.join(pages.select(*PAGE, "width", "height"), PAGE).where("w > 0")
    return by_group(full.select(*PAGE, "x", "y", "w", "known", "width", "height"), PAGE, ["y", "x"], run, "doc_id long, page_index int, region int, x double, y double, x2 double, y2 double")
