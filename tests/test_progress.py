import pytest

from foliospark.operators import progress, quality


def test_throttle_keeps_the_first_and_complete_frames(spark):
    rows = [(1, 0, 1, 0.0, False), (1, 0, 2, 0.1, False), (1, 0, 3, 0.2, True), (1, 0, 4, 0.5, False), (1, 0, 5, 0.56, False), (1, 1, 1, 0.3, False)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, revision long, at double, complete boolean")
    assert sorted((r.page_index, r.revision) for r in progress.throttled(df).collect()) == [(0, 1), (0, 3), (0, 5), (1, 1)]


def test_artifacts_expire(spark):
    df = spark.createDataFrame([("s", "a", 100), ("s", "b", 4000), ("s", "c", 4100), ("s", "d", 4200), ("t", "e", 10)], "store string, artifact_id string, used_at long")
    assert sorted(r.artifact_id for r in progress.kept_artifacts(df, 4300).collect()) == ["c", "d"]


def test_label_prefix(spark):
    df = spark.createDataFrame([("[1]", list("[ 1] Author")), ("2.", list("3. x")), ("", list("abc"))], "label string, chars array<string>")
    assert [r.n_label for r in quality.label_glyphs(df).collect()] == [4, None, 0]


def test_too_many_entries(spark):
    df = spark.createDataFrame([(1, "list", "1.", "x")] * 3, "doc_id long, kind string, label string, text string")
    assert quality.checked_entries(df, 3).count() == 3
    with pytest.raises(Exception, match="too many entries"):
        quality.checked_entries(df, 2).collect()


def test_title_regions(spark):
    """Large glyphs at the top that were not recognised: two rows that make one region, a row that was recognised, and a short one."""
    row = lambda x, y, n, w: [(1, 0, x + 20.0 * k, float(y), w) for k in range(n)]
    glyphs = row(50.0, 40, 12, 18.0) + row(50.0, 80, 12, 18.0) + row(50.0, 130, 9, 18.0) + row(50.0, 150, 5, 18.0) + row(50.0, 500, 60, 6.0)
    df = spark.createDataFrame(glyphs, "doc_id long, page_index int, x double, y double, w double")
    pages = spark.createDataFrame([(1, 0, 400.0, 800.0)], "doc_id long, page_index int, width double, height double")
    words = spark.createDataFrame([(1, 0, 45.0, 128.0, 260.0, 132.0)], "doc_id long, page_index int, x double, y double, x2 double, y2 double")
    got = quality.title_regions(df, pages, words).collect()
    assert [(r.region, r.x, r.y, r.x2) for r in got] == [(0, 47.0, 37.0, 291.0)] and abs(got[0].y2 - (80 + 1.9 * 18)) < 1e-9
    none = words.limit(0)
    assert [r.region for r in quality.title_regions(df, pages, none).orderBy("region").collect()] == [0, 1]


def test_page_tails(spark):
    rows = [("Aims ... 12", "12", 2, 5), ("Aims 1 2", "12", 3, 1), ("Aims", "12", None, None), ("x.", "", None, None)]
    df = spark.createDataFrame([(list(t), p, n, k) for t, p, n, k in rows], "chars array<string>, page_label string, n int, k int")
    assert all((r.n_tail, r.n_leaders) == (r.n, r.k) for r in quality.tail_glyphs(df).collect())


def test_reports(spark):
    df = spark.createDataFrame([("j", 1, {"stage": "a", "secret": "b"}), ("j", 2, {"page_count": "3"})], "job_id string, seq int, event map<string,string>")
    assert [r.report for r in progress.reported(df).orderBy("seq").collect()] == [{"stage": "a"}, {"page_count": "3"}]
    assert progress.first_warnings(df, 1).first().seq == 1
