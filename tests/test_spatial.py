import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators import export, quality, relational, spatial


def box_frame(spark, rows, extra):
    return spark.createDataFrame(rows, f"doc_id long, page_index int, {extra}, x double, y double, x2 double, y2 double")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_geometry(spark):
    box = G.box(*(F.lit(float(v)) for v in (10, 20, 50, 40)))
    r = one(spark, G.rect(box, F.lit(100.0), F.lit(100.0)))
    assert [round(v, 6) for v in r] == [0.1, 0.6, 0.4, 0.2]
    rect = F.struct(F.lit(0.65).alias("left"), F.lit(0.2).alias("top"), F.lit(0.3).alias("width"), F.lit(0.05).alias("height"))
    assert [round(v, 6) for v in one(spark, G.rotated(rect, F.lit(270)))] == [0.2, 0.05, 0.05, 0.3]
    with pytest.raises(Exception, match="empty rectangle"):
        one(spark, G.rect(G.box(*(F.lit(float(v)) for v in (10, 20, 10, 40))), F.lit(100.0), F.lit(100.0)))
    assert one(spark, G.quadrant(F.lit(88.0))) == 90 and one(spark, G.quadrant(F.lit(-2.0))) == 0 and one(spark, G.quadrant(F.lit(45.0))) is None


def test_closure_follows_chains(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 20), (4, 30)], "entry_id long, parent_id long")
    got = spatial.closure(links, spark.createDataFrame([(1,)], "entry_id long"))
    assert sorted(r.entry_id for r in got.collect()) == [1, 2, 3]


def test_label_groups(spark):
    g = [(1, 0, "A", 10.0, 10.0, 0.0, 14.0, 10.0), (1, 0, "B", 10.0, 10.0, 15.0, 20.0, 10.0), (1, 0, "C", 10.0, 10.0, 60.0, 65.0, 10.0), (1, 0, "D", 10.0, -20.0, 0.0, 5.0, 10.0)]
    df = spark.createDataFrame([(d, p, ch, s, y, x, x2, y + s) for d, p, ch, s, y, x, x2, _ in g], "doc_id long, page_index int, ch string, font_size double, y double, x double, x2 double, y2 double")
    assert sorted(r.text for r in spatial.label_groups(df).collect()) == ["AB", "C", "D"]


def test_covered_paragraph_needs_exactly_one_entry(spark):
    glyphs = box_frame(spark, [(1, 0, 1, 1, "a", 1.0, 1.0, 2.0, 2.0), (1, 0, 1, 2, "b", 50.0, 1.0, 51.0, 2.0), (1, 0, 2, 3, "c", 1.0, 1.0, 2.0, 2.0)], "para_id int, glyph_id long, ch string")
    entries = box_frame(spark, [(1, 0, 7, 0.0, 0.0, 10.0, 10.0)], "entry_id int")
    assert {r.para_id: r.covered for r in spatial.covered_parents(glyphs, entries).collect()} == {1: False, 2: True}


def test_ocr_lines(spark):
    line = lambda t, x, y, size=10.0, region=0: (1, 0, region, t, x, y, x + 200, y + size, size)
    rows = [line("first", 50.0, 700.0), line("goes on", 50.0, 688.0), line("indented", 65.0, 676.0), line("apart", 50.0, 600.0), line("HEAD", 50.0, 580.0, 16.0), line("column", 300.0, 700.0), line("other", 50.0, 564.0, 10.0, 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, page_index int, region_id int, text string, x double, y double, x2 double, y2 double, font_size double, pos int")
    got = spatial.merged_ocr_lines(df).collect()
    assert sorted(r.text for r in got) == ["HEAD", "apart", "column", "first goes on", "indented", "other"]
    assert next((r.x, r.y, r.x2, r.y2) for r in got if r.n_lines == 2) == (50.0, 688.0, 250.0, 710.0)


def test_ocr_thresholds(spark):
    """What is level isn't indented, but may be too far right; a small change of size doesn't part, and a caption's lines stay out."""
    line = lambda t, x, y, size=10.0, wide=40.0, label="Text": (1, 0, 0, t, x, y, x + wide, y + size, size, label)
    rows = [line("a", 50.0, 700.0, wide=200.0), line("b", 58.0, 688.0, size=10.9), line("c", 53.0, 677.0, size=11.9), line("caption", 50.0, 650.0, label="figure_caption")]
    schema = "doc_id long, page_index int, region_id int, text string, x double, y double, x2 double, y2 double, font_size double, label string, pos int"
    merged = lambda rows: sorted(r.text for r in spatial.merged_ocr_lines(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)).collect())
    assert merged(rows) == ["a", "b c"]
    wide = [line("a", 50.0, 700.0, wide=200.0), line("b", 52.0, 688.0, wide=60.0), line("c", 120.0, 688.0, wide=60.0)]
    assert merged(wide) == ["a b c"]


def greedy_rows(glyphs):
    """Rows as the rule tells them: the latest of the last three whose middle is near."""
    out = []
    for g in sorted(glyphs, key=lambda g: (-g[3], g[0])):
        middle, tall = (g[1] + g[3]) / 2, g[3] - g[1]
        for row in list(reversed(out))[:3]:
            if abs(row["m"] - middle) <= 0.35 * min(row["h"], tall):
                row["g"].append(g)
                break
        else:
            out.append({"m": middle, "h": tall, "g": [g]})
    return sorted("".join(g[4] for g in sorted(row["g"])) for row in out)


def test_label_rows_of_mixed_heights(spark):
    random.seed(6)
    pages = [[(3.0 * k, y := random.uniform(0, 60), 3.0 * k + 3, y + random.uniform(4, 20), chr(97 + k)) for k in range(20)] for _ in range(30)]
    df = spark.createDataFrame([(1, p, *g, 400.0) for p, own in enumerate(pages) for g in own], "doc_id long, page_index int, x double, y double, x2 double, y2 double, ch string, font_size double")
    got = {}
    for r in spatial.label_groups(df).collect():
        got.setdefault(r.page_index, []).append(r.text)
    assert {p: sorted(v) for p, v in got.items()} == {p: greedy_rows(own) for p, own in enumerate(pages)}


def test_a_glyph_takes_the_box_of_its_word(spark):
    words = box_frame(spark, [(1, 0, 7, 100.0, 100.0, 110.0, 112.0)], "word_id int")
    glyphs = box_frame(spark, [(1, 0, 1, 95.0, 101.0, 103.0, 111.0), (1, 0, 2, 108.0, 101.0, 115.0, 111.0), (1, 0, 3, 111.0, 101.0, 112.5, 111.0)], "glyph_id long")
    got = {r.glyph_id: (round(r.x, 3), r.y, round(r.x2, 3), r.y2) for r in spatial.nearest_words(glyphs, words).collect()}
    assert got == {1: (100.0, 100.0, 103.0, 112.0), 2: (108.0, 100.0, 110.0, 112.0), 3: (109.9, 100.0, 110.0, 112.0)}


def test_captions_and_formulas_are_not_graphic(spark):
    glyphs = box_frame(spark, [(1, 0, i, x, 10.0, x + 5, 15.0) for i, x in ((1, 10.0), (2, 30.0), (3, 50.0), (4, 90.0))], "glyph_id long")
    boxes = [(0, "figure", 0.9, 0.0, 0.0, 80.0, 80.0), (1, "figure_caption", 0.2, 28.0, 8.0, 40.0, 20.0), (2, "isolate_formula", 0.9, 48.0, 8.0, 60.0, 20.0), (3, "table", 0.4, 85.0, 0.0, 99.0, 80.0)]
    regions = spark.createDataFrame([(1, 0, *b) for b in boxes], "doc_id long, page_index int, region_id int, class_name string, conf double, x double, y double, x2 double, y2 double")
    assert [(r.glyph_id, r.region_id) for r in spatial.graphic_glyphs(glyphs, regions).collect()] == [(1, 0)]


def test_ready_entries_go_with_their_parents(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 20), (4, 30), (5, 30)], "entry_id long, parent_id long")
    ready = spark.createDataFrame([(2,), (3,), (4,), (5,)], "entry_id long")
    assert sorted(r.entry_id for r in spatial.ready_entries(links, ready).collect()) == [4, 5]


def test_draw_order_goes_on_through_entries(spark):
    rows = [(1, 0, e, part, pos, order) for e in (0, 1) for part in (0, 1) for pos, order in ((0, 7), (1, None))]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, entry int, part int, pos int, render_order long")
    got = [r.sub_order for r in spatial.draw_order(df).orderBy("render_order", "sub_order").collect()]
    assert got == [10**16 + k for k in range(1, 5)] + [1, 2, 3, 4]


def test_two_biographies_make_a_page_of_prose(spark):
    born = "Ann Example was born in a small town and she has worked there since"
    rows = [(1, 0, 1, "[1] A. Writer. A title. 1999.", 8.0, 90.0), (1, 1, 2, born, 8.0, 90.0), (1, 1, 3, "He received his Ph.D. degree from a university of some renown", 8.0, 60.0), (1, 1, 4, "Words of a body of more than twenty-four letters", 8.0, 99.0), (1, 0, 5, "Much larger text. " * 8, 9.5, 50.0), (1, 0, 6, "As small as a reference. " * 8, 9.0, 30.0)]
    df = spark.createDataFrame([(d, p, i, t, "text", s, 10.0, y, 60.0, y + 10) for d, p, i, t, s, y in rows], "doc_id long, page_index int, para_id int, text string, label string, font_size double, x double, y double, x2 double, y2 double")
    assert sorted(r.para_id for r in spatial.protected_prose(df).collect()) == [2, 3, 4, 5]


def test_parts_are_halved_down_to_the_page_that_fails(spark):
    def work(rows):
        if any(r.page_index == 5 for r in rows):
            raise ValueError("bad page")
        return [len(rows)] * len(rows)

    pages = spark.createDataFrame([(1, p, p // 8) for p in range(16)], "doc_id long, page_index int, part int")
    got = {r.page_index: (r.result, r.error) for r in export.worked(pages, work, "long").collect()}
    assert got[5] == (None, "ValueError: bad page") and got[4] == (1, None) and got[6] == (2, None) and got[0] == (4, None) and got[8] == (8, None)

    def broken(rows):
        raise PermissionError("no access")

    with pytest.raises(Exception, match="no access"):
        export.worked(pages, broken, "long").collect()
    assert export.admitted_parts(0, 15, 4, 9) == [(9, 12), (0, 3), (4, 7), (8, 8), (13, 15)] and export.admitted_parts(3, 5, 4) == [(3, 5)]


def test_recovered_pages_are_checked(spark):
    src = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, page_index int, text string")
    new = lambda *rows: export.assembled_pages(src, spark.createDataFrame(list(rows), "doc_id long, page_index int, text string"), ["text"])
    assert sorted((r.page_index, r.text, r.replaced) for r in new((1, 1, "B")).collect()) == [(0, "a", False), (1, "B", True)]
    for bad in ([(1, 1, "B"), (1, 1, "C")], [(1, 2, "x")], [(9, 0, "x")]):
        with pytest.raises(Exception, match="invalid recovery page"):
            new(*bad).collect()
    parts = spark.createDataFrame([(1, 0, 1, "nope")], "doc_id long, first int, last int, sha256 string")
    contents = spark.createDataFrame([(1, 0, bytearray(b"x"), 2)], "doc_id long, first int, content binary, page_count int")
    with pytest.raises(Exception, match="invalid part"):
        export.verified_parts(parts, contents, contents).collect()


def test_page_classes(spark):
    loose, bad = "a b c d e f g h the and of", "�" * 30 + " " + "letters " * 10
    rows = [(1, "x" * 70, 0.9, 0.9, 0.0, False, False), (2, "few", 0.5, 0.5, 0.0, False, False), (3, bad, 0.5, 0.5, 0.0, False, False), (4, bad, 0.4, 0.4, 0.0, False, False), (5, loose, 0.0, 0.0, 0.0, True, False), (6, "x" * 70, 0.0, 0.0, 0.0, True, True), (7, "x" * 70, 0.5, 0.5, 0.9, False, False), (8, "short a b c", 0.0, 0.0, 0.0, True, True)]
    df = spark.createDataFrame(rows, "doc_id int, text string, image_share double, page_share double, hidden_share double, bitmap_fonts boolean, unencoded boolean")
    assert {r.doc_id: r.quality for r in quality.page_quality(df).collect()} == {1: "healthy", 2: "image-text", 3: "image-text", 4: "healthy", 5: "bitmap-text", 6: "bitmap-text", 7: "scanned", 8: "healthy"}


def test_selected_pages(spark):
    pick = lambda s, n: one(spark, export.selected_pages(F.lit(s), F.lit(n)))
    assert pick("18-22, 30,19", 305) == [17, 18, 19, 20, 21, 29] and pick("", 3) == [0, 1, 2]
    for bad in ("5-2", "0", "400", "a", "1,,2"):
        with pytest.raises(Exception):  # noqa: B017
            pick(bad, 305)


def test_manifest_is_all_or_nothing(spark):
    sel = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in range(4)], "doc_id long, page_index int")
    parts = spark.createDataFrame([(1, 0, 1, "a"), (1, 2, 3, "b"), (2, 0, 2, "c"), (3, 0, 3, "d"), (3, 3, 4, "e")], "doc_id long, first int, last int, sha256 string")
    assert [r.doc_id for r in export.manifest(sel, parts).collect()] == [1]


def test_isolated_pages(spark):
    got = export.isolated(spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, n int"), lambda r: 10 // r["n"], "long").orderBy("doc_id").collect()
    assert got[0].result == 5 and got[0].error is None and got[1].result is None and got[1].error.startswith("ZeroDivisionError")


def test_predicates(spark):
    assert not one(spark, T.is_body(F.lit("Copyright 2001 by a publishing group of some length")))
    assert not one(spark, T.is_body(F.lit("(cid:12)(cid:13)(cid:14)(cid:15)(cid:16)(cid:17)(cid:18)(cid:19)")))
    assert one(spark, T.is_body(F.lit("An ordinary sentence with enough letters in it.")))
    assert not one(spark, T.same_placeholders(F.lit("<style id='1'>a</style>{v2}"), F.lit("a{v2}")))
    assert one(spark, T.failure_code(F.array(F.lit("PageError"), F.lit("MemoryError")))) == "resource"
    assert one(spark, T.clamped_option(F.lit(500), 70, 160, 100)) == 160 and one(spark, T.clamped_option(F.lit(None).cast("int"), 70, 160, 100)) == 100


def test_body_gate_and_rollup(spark):
    gate = quality.body_gate(spark.createDataFrame([(1, True), (1, False), (2, False)], "doc_id long, is_body boolean"))
    assert {r.doc_id: r.error for r in gate.collect()} == {1: None, 2: "document_no_body_text"}
    parts = spark.createDataFrame([(1, [3, 1]), (1, [1, 2])], "doc_id long, pages array<int>")
    assert quality.merged_lists(parts, ["doc_id"], "pages").first().pages == [1, 2, 3]


def test_il_regions_in_both_spellings(spark):
    a = '{"page":[{"pageNumber":0,"pdfParagraph":[{"box":{"x":1,"y":2,"x2":3,"y2":4},"unicode":"t","pdfParagraphComposition":[{"pdfFormula":{"box":{"x":1,"y":2,"x2":3,"y2":4},"latex":"x="}}]}]}]}'
    b = '{"page":[{"page_number":5,"pdf_paragraph":[{"box":{"x":1,"y":2,"x2":3,"y2":4},"unicode":"u"}]}]}'
    got = export.il_regions(spark.createDataFrame([(1, a), (2, b)], "doc_id long, json string")).collect()
    assert sorted((r.doc_id, r.page_index, r.kind, r.text) for r in got) == [(1, 0, "body", "t"), (1, 0, "inline", "x="), (2, 5, "body", "u")]


def test_as_of_without_an_earlier_row(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b")], "k int, t int, v string")
    got = relational.as_of(left, right, "k", "t", "t", ["v"])
    assert sorted((r.k, r.t, r.asof_v or "") for r in got.collect()) == [(1, 1, ""), (1, 5, "b"), (2, 9, "")]


def test_tall_words_keep_the_glyphs_of_their_whole_box(spark):
    words = box_frame(spark, [(1, 0, 7, 0.0, 100.0, 50.0, 180.0), (1, 0, 8, 0.0, 300.0, 50.0, 306.0)], "word_id int")
    at = {1: 104.0, 2: 140.0, 3: 176.0, 4: 92.0, 5: 80.0, 6: 187.0, 7: 310.0, 8: 312.0}
    glyphs = box_frame(spark, [(1, 0, i, 10.0, y - 2, 14.0, y + 2) for i, y in at.items()], "glyph_id long")
    got = {r.glyph_id: r.word_id for r in spatial.nearest_words(glyphs, words).collect()}
    assert got == {1: 7, 2: 7, 3: 7, 4: 7, 6: 7, 7: 8}


def test_words_of_any_height_against_a_plain_version(spark):
    """The tallest reaches more buckets than an array can hold."""
    random.seed(11)
    words = [(1, p, i, x := random.uniform(0, 80), y := random.uniform(-200, 200), x + random.uniform(5, 60), y + random.choice([-30, 0, 6, 8, 15, 40, 120, 300])) for p in range(6) for i in range(15)]
    words.append((1, 0, 99, 0.0, -50.0, 90.0, 1e12))
    glyphs = [(1, p, i, x := random.uniform(0, 120), y := random.uniform(-250, 550), x + 6, y + 10) for p in range(6) for i in range(80)]
    want = {}
    for _, p, i, x, y, x2, y2 in glyphs:
        middle, centre = (y + y2) / 2, (x + x2) / 2
        near = [(abs((w[4] + w[6]) / 2 - middle), w[2], w) for w in words if w[1] == p and w[3] - 2 <= centre <= w[5] + 2 and w[4] // 8 - 1 <= middle // 8 <= w[6] // 8 + 1]
        if near and min(near)[0] <= max(8, min(near)[2][6] - min(near)[2][4]):
            want[p, i] = min(near)[1]
    got = spatial.nearest_words(box_frame(spark, glyphs, "glyph_id long"), box_frame(spark, words, "word_id int"))
    assert {(r.page_index, r.glyph_id): r.word_id for r in got.collect()} == want and {99} < set(want.values())


def test_exploded_words_are_not_broadcast(spark, tmp_path):
    box_frame(spark, [(1, 0, 7, 0.0, 0.0, 9.0, 80.0)], "word_id int").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    plan = spatial.nearest_words(words.withColumnRenamed("word_id", "glyph_id"), words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
