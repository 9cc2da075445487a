"""Reports on jobs: stages' cost, progress, waiting requests, published frames and kept artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pages import running


def stage_costs(samples: DataFrame) -> DataFrame:
    """(job_id, stage, peak, elapsed): the largest memory and the time in sum of each stage. samples: bytes, seconds."""
    return samples.groupBy("job_id", "stage").agg(F.max("bytes").alias("peak"), F.sum(F.col("seconds").cast("decimal(28,4)")).cast("double").alias("elapsed"))


def progress(pages: DataFrame) -> DataFrame:
    """(job_id, done, selected, percent) of jobs' pages (done boolean)."""
    sums = pages.groupBy("job_id").agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("selected"))
    return sums.withColumn("percent", F.floor(100 * F.col("done") / F.col("selected")))


def waiting(requests: DataFrame, now: int) -> DataFrame:
    """(job_id, pending, oldest): unanswered requests and the age of the oldest. requests: asked_at, answered_at."""
    open_ = F.col("answered_at").isNull()
    return requests.groupBy("job_id").agg(F.count_if(open_).alias("pending"), F.max(F.when(open_, F.lit(now) - F.col("asked_at"))).alias("oldest"))


def throttled(frames: DataFrame, interval: float = 0.35) -> DataFrame:
    """The frames of a page that go out: the first, complete or sealed ones, and those at least ``interval`` after the last that did.

    frames: doc_id, page_index, revision, at (seconds), complete.
    """

    def start():
        last = None

        def step(complete: bool, at: float) -> bool:
            nonlocal last
            goes = last is None or bool(complete) or at - last >= interval
            if goes:
                last = at
            return goes

        return step

    return running(frames, ["doc_id", "page_index"], ["revision"], ["complete", "at"], start, "goes", "boolean").where("goes").drop("goes")


#: What a progress report keeps.
REPORTED = ["type", "stage", "overall_progress", "stage_current", "stage_total", "page_count", "completed_pages", "total_pages", "batch_first", "batch_last"]


def reported(events: DataFrame) -> DataFrame:
    """(job_id, seq, report): each progress event's map ``event`` with the allowed fields only."""
    return events.select("job_id", "seq", F.map_filter("event", lambda k, _: k.isin(REPORTED)).alias("report"))


def first_warnings(events: DataFrame, most: int = 64) -> DataFrame:
    """The first ``most`` warnings of each job (job_id, seq, message)."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))
    return events.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def revisions(frames: DataFrame, start: int = 0) -> DataFrame:
    """``revision``: frames of a page numbered on from ``start`` in order of their places."""
    return frames.withColumn("revision", start + F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("pos")))


def kept_artifacts(artifacts: DataFrame, now: int, count: int = 2, expiry: int = 3600) -> DataFrame:
    """A store's artifacts (store, artifact_id, used_at) that stay: the last used ``count`` within ``expiry`` seconds."""
    place = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("used_at"), "artifact_id"))
    return artifacts.withColumn("_n", place).where((F.col("_n") <= count) & (F.lit(now) - F.col("used_at") <= expiry)).drop("_n")


def next_frame(frames: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, page_index, revision): of the waiting frames of a document the one nearest the viewed page, then the earliest."""
    near = frames.join(current, "doc_id").withColumn("_d", F.abs(F.col("page_index") - F.col("current")))
    best = near.groupBy("doc_id").agg(F.min(F.struct("_d", "revision", "page_index")).alias("b"))
    return best.select("doc_id", F.col("b.page_index").alias("page_index"), F.col("b.revision").alias("revision"))
