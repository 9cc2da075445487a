"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
import unicodedata

import duckdb
import pandas as pd
import pytest

from foliospark.plans import catalog

#: Another size can be named, as the larger ones have rows that the smallest lacks.
DATA = os.environ.get("CATALOG_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "" if math.isnan(f) else f"{f:.9g}"


#: These have tests of their own below, or in the tests of their operators.
WITHOUT_SQL = {"approximate", "compatibility_forms", "merged_ocr_lines", "title_regions"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    if name not in catalog.ORACLES:
        assert name in WITHOUT_SQL
        return
    got, want = got.toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(tuple(map(plain, r)) for r in got[columns].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in want[columns].itertuples(index=False))


def test_compared_pages_takes_all_documents(spark, tmp_path):
    spark.createDataFrame([(5, "a", "en"), (100, "b", "de"), (4000, "c", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalog.QUERIES["compared_pages"](spark, str(tmp_path)).collect())) == [(5, "a", "EN"), (100, "b", "DE"), (4000, "c", "FR")]


def test_full_outer_takes_whole_tables(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 7), (50, 7), (2, 9), (3, 9), (4, None)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in catalog.QUERIES["full_outer"](spark, str(tmp_path)).collect()}
    assert got == {(7, 3, 2), (8, 1, 0), (9, 0, 2), (None, 1, 1)}


def test_label_glyphs_reads_labels_of_any_length(spark, tmp_path):
    rows = [(1, 0, "x" * 45 + " goes on"), (2, 0, "Short one"), (3, 0, "y" * 40 + " z")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.doc_id: r.n_label for r in catalog.QUERIES["label_glyphs"](spark, str(tmp_path)).collect()} == {1: 45, 2: 5, 3: 40}


def test_approximations_are_near(spark, duck):
    exact = {r[0]: r[1:] for r in duck.sql("select l_returnflag, count(distinct l_partkey), median(l_quantity) from lineitem group by 1").fetchall()}
    got = {r.l_returnflag: r for r in catalog.QUERIES["approximate"](spark, DATA).collect()}
    assert set(got) == set(exact) and all(abs(got[k].parts - n) <= 0.15 * n and abs(got[k].median_qty - m) <= 1 for k, (n, m) in exact.items())


def test_compatibility_forms(spark, duck):
    want = {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in duck.sql("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: r.text for r in catalog.QUERIES["compatibility_forms"](spark, DATA).collect()} == want


def test_merged_lines_against_a_plain_version(spark, duck):
    """One line at a time against the paragraphs so far of its column."""
    glyphs = duck.sql(f"with {catalog.GLYPHS} select doc_id, para_id, ch, x, y, x2, y2, font_size from glyphs order by doc_id, para_id, glyph_id").fetchall()
    pages, want = {}, []
    for doc, region, *g in glyphs:
        pages.setdefault((doc, region), []).append(g)
    for key, own in pages.items():
        columns = []
        for g in own:
            near = [c for c in columns if min(c[0][3], g[3]) - max(c[0][1], g[1]) > 0.3 * min(c[0][3] - c[0][1], g[3] - g[1])]
            near[0].append(g) if near else columns.append([g])
        for c in columns:
            paragraphs = []
            for ch, x, y, x2, y2, size in sorted(c, key=lambda g: (-g[4], g[1])):
                if paragraphs:
                    p = paragraphs[-1]
                    level = min(p["y2"], y2) - max(p["y"], y) > 0.5 * min(p["y2"] - p["y"], y2 - y)
                    fits = p["y"] - y2 <= max(5, 0.65 * size) and (level or x <= p["x"] + max(4, 0.4 * size)) and x <= p["x2"] + 2 * size and abs(p["size"] - size) <= max(1, 0.2 * size)
                    if fits:
                        p |= {"text": f"{p['text']} {ch}", "x": min(p["x"], x), "y": min(p["y"], y), "x2": max(p["x2"], x2), "y2": max(p["y2"], y2)}
                        continue
                paragraphs.append({"text": ch, "x": x, "y": y, "x2": x2, "y2": y2, "size": size})
            want += [(*key, p["text"], p["x"], p["y"], p["x2"], p["y2"]) for p in paragraphs]
    got = catalog.QUERIES["merged_ocr_lines"](spark, DATA).collect()
    assert sorted((r.doc_id, r.region_id, r.text, r.x, r.y, r.x2, r.y2) for r in got) == sorted(want) and any(r.n_lines > 1 for r in got)
