"""Keyed streaming state: page previews, job admission, replies, revisions and artifacts.

Each operator takes a streaming DataFrame and groups it by its key, so state is dealt
out by key and bounded by the caps that the docstrings name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener


class _Preview(StatefulProcessor):
    """A page's paragraphs so far; the first frame of a page goes out as it is, later ones once a trigger, the latest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", T.StructType([T.StructField("para_id", T.StringType())]), T.StructType([T.StructField("text", T.StringType())]))
        self.revision = handle.getValueState("revision", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.revision.get()[0] if self.revision.exists() else 0
        revision, changed = before, set()
        for row in sorted(rows, key=lambda r: r.seq):
            if self.texts.containsKey((row.para_id,)) and self.texts.getValue((row.para_id,))[0] == row.text:
                continue
            self.texts.updateValue((row.para_id,), (row.text,))
            changed.add(row.para_id)
            if revision == 0:
                revision = 1
                yield Row(doc_id=key[0], page_index=key[1], revision=1, paragraphs=1, changed=1)
                changed = set()
        if changed:
            revision += 1
            yield Row(doc_id=key[0], page_index=key[1], revision=revision, paragraphs=sum(1 for _ in self.texts.keys()), changed=len(changed))
        if revision != before:
            self.revision.update((revision,))

    def close(self) -> None:
        pass


def previews(paragraphs: DataFrame) -> DataFrame:
    """Frames (doc_id, page_index, revision, paragraphs, changed) of completed paragraphs (…, para_id, seq, text)."""
    return paragraphs.groupBy("doc_id", "page_index").transformWithState(_Preview(), "doc_id long, page_index int, revision long, paragraphs long, changed long", "append", "none")


def near_view(frames: DataFrame, view: DataFrame, reach: int = 1) -> DataFrame:
    """Frames of pages within ``reach`` of the viewed one. view: one row (doc_id, current) a viewed document."""
    return frames.join(view, "doc_id").where(F.abs(F.col("page_index") - F.col("current")) <= reach).drop("current")


class _Once(StatefulProcessor):
    """The first payload of an id is accepted, an equal one again is a repeat, a different one a conflict."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("id", T.StringType())]), T.StructType([T.StructField("digest", T.StringType()), T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
        last = max((at for _, at in held.values()), default=0)
        for row in sorted(rows, key=lambda r: r.seq):
            if row.id in held:
                status = "repeat" if held[row.id][0] == row.digest else "conflict"
            else:
                status, last = "accepted", last + 1
                held[row.id] = (row.digest, last)
                self.seen.updateValue((row.id,), held[row.id])
                if len(held) > self.cap:
                    oldest = min(held, key=lambda k: held[k][1])
                    del held[oldest]
                    self.seen.removeKey((oldest,))
            yield Row(scope=key[0], id=row.id, status=status)

    def close(self) -> None:
        pass


def accepted_once(requests: DataFrame, cap: int = 4096) -> DataFrame:
    """(scope, id, status) of requests (scope, id, digest, seq): exactly-once by id within a scope, the last ``cap`` ids known."""
    return requests.groupBy("scope").transformWithState(_Once(cap), "scope string, id string, status string", "append", "none")


class _Jobs(StatefulProcessor):
    """Admission of jobs of a service: at most ``active`` at once, about ``kept`` known.

    Ended jobs are forgotten ``expiry`` seconds after they came. Where too many are
    known, those that were delivered go first, the oldest first; jobs that haven't
    ended stay.
    """

    def __init__(self, active: int, kept: int, expiry: int):
        self.active, self.kept, self.expiry = active, kept, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("digest", T.StringType()), T.StructField("ended", T.BooleanType()), T.StructField("delivered", T.BooleanType()), T.StructField("at", T.LongType())]
        self.jobs = handle.getMapState("jobs", T.StructType([T.StructField("id", T.StringType())]), T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: tuple(v) for k, v in self.jobs.iterator()}

        def put(name: str, value: tuple) -> None:
            held[name] = value
            self.jobs.updateValue((name,), value)

        def drop(name: str) -> None:
            del held[name]
            self.jobs.removeKey((name,))

        for row in sorted(rows, key=lambda r: r.seq):
            if row.action in ("end", "deliver"):
                if row.id in held:
                    digest, _, delivered, at = held[row.id]
                    put(row.id, (digest, True, delivered or row.action == "deliver", at))
                continue
            if row.id in held:
                yield Row(service=key[0], id=row.id, status="repeat" if held[row.id][0] == row.digest else "conflict")
                continue
            for name in [k for k, (_, ended, _, at) in held.items() if ended and row.at - at > self.expiry]:
                drop(name)
            if sum(not ended for _, ended, _, _ in held.values()) >= self.active:
                yield Row(service=key[0], id=row.id, status="busy")
                continue
            over = max(0, len(held) - self.kept + 1)
            for name in sorted((k for k, v in held.items() if v[1]), key=lambda k: (not held[k][2], held[k][3]))[:over]:
                drop(name)
            put(row.id, (row.digest, False, False, row.at))
            yield Row(service=key[0], id=row.id, status="admitted")

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, active: int = 16, kept: int = 64, expiry: int = 3600) -> DataFrame:
    """(service, id, status) of requests (service, id, digest, action submit, end or deliver, seq, and at, in seconds; seq if there is none)."""
    timed = requests if "at" in requests.columns else requests.withColumn("at", F.col("seq"))
    return timed.groupBy("service").transformWithState(_Jobs(active, kept, expiry), "service string, id string, status string", "append", "none")


class Reports(StreamingQueryListener):
    """What running queries have done so far: (query, batch, rows) of each trigger, the last ``most`` of them."""

    def __init__(self, most: int = 1000):
        self.most, self.seen = most, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen = [*self.seen, (event.progress.name, event.progress.batchId, event.progress.numInputRows)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def write_previews(frames: DataFrame, folder: str):
    """A writer of a stream's frames: the latest frame of each page of a trigger, in a folder of the trigger's own, which a repeated one replaces."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_id", "page_index").agg(F.max_by(F.struct(*batch.columns), "revision").alias("f")).select("f.*")
        latest.write.mode("overwrite").parquet(f"{folder}/trigger={number}")

    return frames.writeStream.foreachBatch(write)


def changes_after(events: DataFrame, cursor: int) -> DataFrame:
    """The events of a change log past a reader's cursor."""
    return events.where(F.col("revision") > cursor)


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of event types by tumbling or sliding windows; batch and stream alike, late rows within ``late``."""
    frame = F.window("ts", length, slide or length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(frame.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users, ended by a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drained(spark, frame: DataFrame, folder: str) -> DataFrame:
    """All that a streaming query gives for what is there now, as a table in ``folder``, which all machines share."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")
