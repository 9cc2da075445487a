import base64
import hashlib
import io
import json
import time
import urllib.error

import pytest
from pyspark.sql import functions as F

from foliospark.functions import bridge
from foliospark.sources import files
from foliospark.streaming import jobs


def run(spark, tmp_path, frames, make, name):
    """A streaming query over Parquet files, one micro-batch a file."""
    source = str(tmp_path / "in")
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(source) if i else f.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_previews_give_the_first_frame_and_then_the_latest(spark, tmp_path):
    schema = "doc_id long, page_index int, para_id string, seq long, text string"
    frames = [spark.createDataFrame([(1, 0, "a", 1, "x"), (1, 0, "b", 2, "y"), (1, 0, "c", 3, "z")], schema), spark.createDataFrame([(1, 0, "a", 4, "x"), (1, 0, "b", 5, "yy")], schema)]
    got = run(spark, tmp_path, frames, jobs.previews, "previews")
    assert sorted((r.revision, r.paragraphs, r.changed) for r in got) == [(1, 1, 1), (2, 3, 2), (3, 3, 1)]


def test_replies_count_once(spark, tmp_path):
    schema = "scope string, id string, digest string, seq long"
    frames = [spark.createDataFrame([("s", "1", "x", 1), ("s", "1", "x", 2), ("s", "1", "y", 3)], schema), spark.createDataFrame([("s", "1", "x", 4), ("s", "2", "x", 5)], schema)]
    got = run(spark, tmp_path, frames, jobs.accepted_once, "replies")
    assert sorted((r.id, r.status) for r in got) == [("1", "accepted"), ("1", "conflict"), ("1", "repeat"), ("1", "repeat"), ("2", "accepted")]


def test_jobs_are_admitted_up_to_a_number(spark, tmp_path):
    schema = "service string, id string, digest string, action string, seq long"
    rows = [("s", "a", "1", "submit", 1), ("s", "b", "1", "submit", 2), ("s", "c", "1", "submit", 3), ("s", "a", "1", "end", 4), ("s", "c", "1", "submit", 5), ("s", "b", "2", "submit", 6)]
    got = run(spark, tmp_path, [spark.createDataFrame(rows, schema)], lambda s: jobs.admitted(s, active=2), "jobs")
    assert [(r.id, r.status) for r in got] == [("a", "admitted"), ("b", "admitted"), ("c", "busy"), ("c", "admitted"), ("b", "conflict")]


def test_delivered_jobs_go_first_and_old_ones_expire(spark, tmp_path):
    schema = "service string, id string, digest string, action string, seq long, at long"
    rows = [("s", "a", "1", "submit", 1, 0), ("s", "a", "1", "end", 2, 0), ("s", "b", "1", "submit", 3, 1), ("s", "b", "1", "deliver", 4, 1), ("s", "c", "1", "submit", 5, 2), ("s", "d", "1", "submit", 6, 3)]
    rows += [("s", "a", "2", "submit", 7, 4), ("s", "b", "2", "submit", 8, 5), ("s", "a", "2", "submit", 9, 4000)]
    got = run(spark, tmp_path, [spark.createDataFrame(rows, schema)], lambda s: jobs.admitted(s, active=9, kept=3), "old_jobs")
    # d pushes out b, which was delivered; a is still known, and then pushed out by b; c and d have not ended and stay.
    assert [(r.id, r.status) for r in got] == [("a", "admitted"), ("b", "admitted"), ("c", "admitted"), ("d", "admitted"), ("a", "conflict"), ("b", "admitted"), ("a", "admitted")]
    many = [("t", str(i), "1", "submit", i, 0) for i in range(5)]
    (tmp_path / "more").mkdir()
    assert len(run(spark, tmp_path / "more", [spark.createDataFrame(many, schema)], lambda s: jobs.admitted(s, active=9, kept=2), "full_jobs")) == 5


def test_previews_are_written_and_reported(spark, tmp_path):
    schema = "doc_id long, page_index int, revision long, paragraphs long"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 3), (1, 1, 1, 1)], schema).coalesce(1).write.parquet(source)
    reports = jobs.Reports()
    spark.streams.addListener(reports)
    try:
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.write_previews(stream, str(tmp_path / "out")).queryName("written").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if reports.seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(reports)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.page_index, r.revision) for r in got.collect()) == [(0, 2), (1, 1)] and ("written", 0, 3) in reports.seen


def test_streamed_windows(spark, tmp_path):
    events = spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 'v' as event_type, 1.5D as value union all select timestamp '2024-01-01 00:20:00', 'v', 2D union all select timestamp '2024-01-01 05:00:00', 'v', 1D union all select timestamp '2024-01-01 09:00:00', 'v', 1D")
    got = run(spark, tmp_path, [events.where("hour(ts) = 0"), events.where("hour(ts) = 5"), events.where("hour(ts) = 9")], lambda s: jobs.windows(s, "1 hour"), "windows")
    assert sorted((r.n, r.total) for r in got) in ([(1, 1.0), (2, 3.5)], [(2, 3.5)], [(1, 1.0), (1, 1.0), (2, 3.5)])


def test_near_view(spark):
    frames = spark.createDataFrame([(1, p) for p in range(5)], "doc_id long, page_index int")
    view = spark.createDataFrame([(1, 2)], "doc_id long, current int")
    assert sorted(r.page_index for r in jobs.near_view(frames, view).collect()) == [1, 2, 3]


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk" * 10 + b"%PDF-1.7 ...")
    (tmp_path / "b.pdf").write_bytes(b"x" * 2000 + b"%PDF")
    assert [r.path.rsplit("/", 1)[1] for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["a.pdf"]
    good = spark.range(1).select(files.inline_pdf(F.lit(base64.b64encode(b"%PDF-x").decode())).alias("v")).first().v
    assert bytes(good) == b"%PDF-x"
    with pytest.raises(Exception, match="not a PDF"):
        spark.range(1).select(files.inline_pdf(F.lit(base64.b64encode(b" %PDF").decode()))).collect()


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    pages = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "doc_id long, page_index int, text string")
    files.save_snapshot(pages, path)
    assert [r.text for r in files.load_snapshot(spark, path, 2).collect()] == ["b"]
    with pytest.raises(Exception, match="exist"):
        files.save_snapshot(pages, path)
    with pytest.raises(ValueError, match="replace an input"):
        files.export(pages, path, [path])


def test_snapshots_are_copied_with_sound_resources(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    pages = spark.createDataFrame([(d, p, "x") for d in range(40) for p in range(3)], "doc_id long, page_index int, text string")
    files.save_snapshot(pages, source, folders=4)
    assert len([f for f in (tmp_path / "a").iterdir() if f.name.startswith("folder=")]) == 4 and files.load_snapshot(spark, source, 7, 3).count() == 3
    with pytest.raises(Exception, match="too many pages"):
        files.load_snapshot(spark, source, 7, 2).collect()
    good = spark.createDataFrame([(hashlib.sha256(b"r").hexdigest(), bytearray(b"r"))], "sha256 string, content binary")
    files.persist(spark, source, target, good)
    assert files.load_snapshot(spark, f"{target}/pages").count() == 120 and files.written(spark, f"{target}/resources").first().length > 0
    with pytest.raises(Exception, match="corrupt resource"):
        files.persist(spark, source, str(tmp_path / "c"), good.withColumn("content", F.lit(b"s")))


def test_typed_records(spark):
    rows = spark.createDataFrame([('{"type": "Box", "fields": {"x": 3}}',)], "j string")
    assert rows.select(files.typed_record(F.col("j"), {"Box": "x long"}).alias("r")).first().r.Box.x == 3
    with pytest.raises(Exception, match="unknown type"):
        rows.select(files.typed_record(F.col("j"), {"Style": "x long"})).collect()


class Reply(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_chat_translator():
    pauses, answers = [], []

    def send(request, timeout):
        found = answers.pop(0)
        if isinstance(found, Exception):
            raise found
        assert json.loads(request.data)["model"] == "m" and request.full_url == "http://host/v1/chat/completions" and request.headers["Authorization"] == "Bearer k"
        return Reply(found)

    said = lambda text: json.dumps({"choices": [{"message": {"content": text}}]}).encode()
    failed = lambda code: urllib.error.HTTPError("u", code, "no", {}, None)
    translate = bridge.chat_translator("http://host/v1/", "m", "k", send=send, sleep=pauses.append)()
    answers += [failed(503), TimeoutError(), said("<b1>ja</b1>")]
    assert translate("<b1>yes</b1>") == "<b1>ja</b1>" and pauses == [1.0, 2.0]
    for bad, match in (([failed(404)], "HTTP 404"), ([failed(429)] * 3, "HTTP 429"), ([said("no tags")], "placeholder"), ([said(" ")], "no text"), ([b"{}"], "completion"), ([b"x" * ((4 << 20) + 1)], "too large")):
        answers[:] = bad
        with pytest.raises(bridge.TranslationError, match=match):
            translate("<b1>yes</b1>")
    assert [bridge.pause(k) for k in range(5)] == [1, 2, 4, 8, 8]
    for address in ("ftp://host", "http://user@host", "http://host?x=1"):
        with pytest.raises(ValueError, match="plain"):
            bridge.chat_translator(address, "m")


def test_strict_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',)], "j string")
    assert files.json_records(rows, "j", "a int").first().j.a == 1
    with pytest.raises(Exception):  # noqa: B017
        files.json_records(spark.createDataFrame([("{",)], "j string"), "j", "a int").collect()


def test_bridge(spark):
    rows = spark.createDataFrame([("one two {v1}",), (None,), ("some longer text here",)], "text string")
    got = bridge.checked(rows, bridge.translation(bridge.reversed_words)("text")).collect()
    assert [r.reply for r in got] == ["{v1} two one", None, "here text longer some"] and [r.problem for r in got] == [None] * 3
    same = bridge.checked(rows, F.col("text")).collect()
    assert [r.problem for r in same] == [None, None, "refused"]
    assert spark.createDataFrame([("ﬁ①",)], "t string").select(bridge.nfkc("t").alias("v")).first().v == "fi1"
