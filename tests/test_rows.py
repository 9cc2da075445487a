import random

from pyspark.sql import functions as F

from foliospark.operators import rows


def greedy(y, size):
    """Anchor-based twin: every line so far is tried, the latest first."""
    anchors, out = [], []
    for own, tall in zip(y, size, strict=True):
        for i in reversed(range(len(anchors))):
            if abs(anchors[i] - own) <= 0.35 * tall:
                out.append(i)
                break
        else:
            anchors.append(own)
            out.append(len(anchors) - 1)
    return out


def test_lines_are_anchored():
    random.seed(1)
    for _ in range(200):
        y = sorted((random.uniform(0, 60) for _ in range(30)), reverse=True)
        size = [10.0] * 30
        assert rows.baseline_lines(y, size) == greedy(y, size)
    assert rows.baseline_lines([10, 8, 6, 4], [10] * 4) == [0, 0, 1, 1]  # a drift breaks


def glyph(ch, x, y, pos, font="A", size=10.0, page=0, width=5.0, para=0):
    return (1, page, para, ch, float(x), float(y), float(x + width), float(y + size), font, size, pos)


GLYPH = "doc_id long, page_index int, para_id int, ch string, x double, y double, x2 double, y2 double, font_id string, font_size double, pos long"


def test_rows_from_glyphs(spark):
    g = [glyph("a", 10, 80, 0, "B"), glyph("b", 15, 81, 1, "A"), glyph("c", 23, 80, 2, "A"), glyph("d", 80, 80, 3, "B"), glyph("e", 10, 60, 4), glyph(" ", 30, 40, 5), glyph("z", 150, 60, 6)]
    pages = spark.createDataFrame([(1, 0, 100.0, 100.0)], "doc_id long, page_index int, width double, height double")
    got = {(r.line, r.segment): r for r in rows.rows_from_glyphs(spark.createDataFrame(g, GLYPH), pages).collect()}
    assert {k: r.text for k, r in got.items()} == {(0, 0): "ab c", (0, 1): "d", (1, 0): "e"}
    assert got[0, 0].font_id == "A" and abs(got[0, 0].left - 0.1) < 1e-9 and got[0, 0].font_size == 10 and abs(got[0, 0].tail_left - 0.23) < 1e-9


def test_rows_keep_to_their_paragraph(spark):
    """Two paragraphs on one baseline are two rows; vertical, protected and style-less glyphs make none; the crop box moves the origin."""
    g = [glyph("a", 110, 80, 0), glyph("b", 115, 80, 1, para=1), glyph("v", 120, 60, 2, para=2), glyph("t", 120, 40, 3, para=3), glyph("n", 120, 20, 4, para=4)]
    df = spark.createDataFrame(g, GLYPH).withColumn("vertical", F.col("ch") == "v").withColumn("kind", F.when(F.col("ch") == "t", "Table").otherwise("text")).withColumn("font_size", F.when(F.col("ch") != "n", F.col("font_size")))
    pages = spark.createDataFrame([(1, 0, 100.0, 100.0, 100.0, 0.0)], "doc_id long, page_index int, width double, height double, crop_x double, crop_y double")
    fonts = spark.createDataFrame([(1, 0, "A", True, False)], "doc_id long, page_index int, font_id string, bold boolean, italic boolean")
    got = rows.rows_from_glyphs(df, pages, fonts).collect()
    assert sorted((r.para_id, r.text, round(r.left, 6), r.font_bold, r.font_italic) for r in got) == [(0, "a", 0.1, True, False), (1, "b", 0.15, True, False)]


def test_wide_lines_do_not_make_a_right_column(spark):
    """A row from 40 to 70 % of the width belongs to the left column, and doesn't count as one of its compact rows."""
    r = [(1, 0, f"l{i}", 0.05, 0.1 + i / 10, 0.4) for i in range(3)] + [(1, 0, f"r{i}", 0.55, 0.1 + i / 10, 0.4) for i in range(3)] + [(1, 0, "middle", 0.40, 0.25, 0.3)]
    df = spark.createDataFrame(r, "doc_id long, page_index int, text string, left double, top double, width double")
    assert [x.text for x in rows.reading_order(df).orderBy("reading_pos").collect()] == ["l0", "l1", "middle", "l2", "r0", "r1", "r2"]
    few = rows.reading_order(df.where("text <> 'l0'")).orderBy("reading_pos").collect()
    assert [x.text for x in few][:2] == ["r0", "l1"]


def test_dominant_prefers_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, pos int")
    assert rows.dominant(df, ["k"], "v").collect()[0].v == "b"


def test_reading_order(spark):
    r = [(1, 0, "head", 0.1, 0.0, 0.8)] + [(1, 0, f"l{i}", 0.05, 0.1 + i / 10, 0.4) for i in range(3)] + [(1, 0, f"r{i}", 0.55, 0.1 + i / 10, 0.4) for i in range(3)] + [(1, 0, "foot", 0.1, 0.9, 0.8)]
    df = spark.createDataFrame(r, "doc_id long, page_index int, text string, left double, top double, width double")
    assert [x.text for x in rows.reading_order(df).orderBy("reading_pos").collect()] == ["head", "l0", "l1", "l2", "r0", "r1", "r2", "foot"]
    single = rows.reading_order(df.where(F.col("text") != "r2"))
    assert [x.text for x in single.orderBy("reading_pos").collect()][:4] == ["head", "l0", "r0", "l1"]
