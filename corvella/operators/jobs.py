"""The processing queue as tables: enqueueing, claiming and ending jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .security import upsert

ACTIVE = ("queued", "running")
JOB_TYPES = ("document", "ocr", "embedding")
MAX_ATTEMPTS = 2


def _now(now: dt.datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def latest_active(jobs: DataFrame) -> DataFrame:
    """Of every document and type the newest job that is queued or running."""
    order = Window.partitionBy("document_id", "job_type").orderBy(F.col("created_at").desc_nulls_first(), "job_id")
    return jobs.where(F.col("status").isin(*ACTIVE)).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """New jobs for requests (document_id, job_type, created_at) whose document has no active job of that type.

    Repeated requests give one job, the earliest.
    """
    fresh = requests.groupBy("document_id", "job_type").agg(F.min("created_at").alias("created_at"))
    free = fresh.join(jobs.where(F.col("status").isin(*ACTIVE)).select("document_id", "job_type"), ["document_id", "job_type"], "left_anti")
    return free.select(
        F.xxhash64("document_id", "job_type", "created_at").alias("job_id"), "document_id", "job_type", F.lit("queued").alias("status"), F.lit(0).alias("progress"), "created_at",
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("attempts"),
    )


def next_queued(jobs: DataFrame, job_type: str | None = None, slots: int = 1) -> DataFrame:
    """The jobs that have waited longest."""
    waiting = jobs.where("status = 'queued'")
    waiting = waiting.where(F.col("job_type") == job_type) if job_type else waiting
    return waiting.orderBy(F.col("created_at").asc_nulls_last(), "job_id").limit(slots)


def claim(jobs: DataFrame, claimed: DataFrame, now: dt.datetime) -> DataFrame:
    """jobs with the claimed ones running."""
    running = claimed.withColumn("status", F.lit("running")).withColumn("progress", F.greatest(F.coalesce("progress", F.lit(0)), F.lit(1))).withColumn("started_at", _now(now)).withColumn("error_message", F.lit(None).cast("string"))
    return upsert(jobs, running, ["job_id"])


def finish(jobs: DataFrame, outcomes: DataFrame, now: dt.datetime, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """jobs after outcomes (job_id, error): completed without an error; with one, queued again until attempts run out."""
    ended = jobs.join(outcomes.select("job_id", "error"), "job_id")
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    again = F.col("error").isNotNull() & (attempts < max_attempts)
    status = F.when(F.col("error").isNull(), "completed").when(again, "queued").otherwise("failed")
    changed = (
        ended.withColumn("status", status)
        .withColumn("progress", F.when(again, 0).otherwise(100))
        .withColumn("finished_at", F.when(again, F.lit(None).cast("timestamp_ntz")).otherwise(_now(now)))
        .withColumn("error_message", F.col("error"))
        .withColumn("attempts", attempts)
        .drop("error")
    )
    return upsert(jobs, changed.select(*jobs.columns), ["job_id"])


def timed_out(jobs: DataFrame, now: dt.datetime, seconds: int = 300) -> DataFrame:
    """Outcomes for jobs that have run too long."""
    late = F.col("started_at") < F.lit(now - dt.timedelta(seconds=seconds)).cast("timestamp_ntz")
    return jobs.where((F.col("status") == "running") & late).select("job_id", F.concat(F.lit("Job timed out after "), F.lit(seconds), F.lit(" seconds.")).alias("error"))
