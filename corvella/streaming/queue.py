"""The ingestion queue as Structured Streaming: files land, become jobs once each, and turn into chunks.

Progress lives in the stream's checkpoint; a micro-batch that fails is run again, so its sink writes by batch number.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.governance import STATUSES
from ..operators.jobs import MAX_ATTEMPTS, claim, finish, next_queued, timed_out
from ..plans.scratch import scratch_dir
from ..sources.files import is_supported

REQUEST = "document_id bigint, job_type string, created_at timestamp"


def landed_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Supported files as they land: path, modified, length, content."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.where(is_supported(F.col("path"))).withColumnRenamed("modificationTime", "modified")


def read_requests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def unique_requests(requests: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """The first of the requests for a document and type within the horizon, which bounds the state kept."""
    return requests.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["document_id", "job_type"])


def run_worker(requests: DataFrame, process: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, available_now: bool = True, poll: str = "2 seconds") -> StreamingQuery:
    """Give every micro-batch of requests to ``process`` and write what it returns under ``out``/batch=N.

    A batch that runs again after a failure overwrites its own folder: each request takes effect once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        process(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=poll)).start()


Processor = Callable[[DataFrame], DataFrame]


def run_jobs(jobs: DataFrame, processors: dict[str, Processor], now: dt.datetime, slots: int = 100, timeout: int = 300, max_attempts: int = MAX_ATTEMPTS, folder: str | None = None) -> DataFrame:
    """The jobs table after a worker has gone through its queue.

    Jobs that have run too long end as failed attempts. Then the longest waiting jobs are claimed, ``slots`` at a time, and
    given by type to their processor, which returns (job_id, error) with a null error for what it has completed; a claimed
    job that it doesn't name has failed, and so has all of a batch whose processor raises. Failed jobs queue again until
    their attempts run out. Types without a processor stay queued. Every turn is written as a table of its own.
    """
    spark = jobs.sparkSession
    root = folder or scratch_dir(spark, "jobs")
    turn = 0

    def kept(table: DataFrame, name: str) -> DataFrame:
        nonlocal turn
        turn += 1
        path = f"{root}/{turn}-{name}"
        table.write.mode("overwrite").parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    jobs = kept(finish(jobs, timed_out(jobs, now, timeout), now, max_attempts), "timed-out")
    while True:
        busy = False
        for kind, process in processors.items():
            claimed = kept(next_queued(jobs, kind, slots), "claimed")
            if claimed.isEmpty():
                continue
            busy = True
            jobs = kept(claim(jobs, claimed, now), "running")
            try:
                said = kept(process(claimed).select("job_id", "error"), "outcomes")
                outcomes = claimed.select("job_id").join(said.withColumn("_said", F.lit(True)), "job_id", "left").select("job_id", F.when(F.col("_said"), F.col("error")).otherwise("not processed").alias("error"))
            except Exception as e:  # whatever the processor raises ends this attempt of its jobs
                outcomes = claimed.select("job_id", F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
            jobs = kept(finish(jobs, outcomes, now, max_attempts), "finished")
        if not busy:
            return jobs


_ORDER = {name: i for i, name in enumerate(STATUSES)}


def next_status(now: str | None, event: str) -> str:
    """The status after an event. Work goes forward only; failed and archived end it until it is uploaded anew."""
    if event not in _ORDER or now == "archived":
        return now or "uploaded"
    if now is None or event in ("uploaded", "failed", "archived"):
        return event
    if now == "failed":
        return now
    return event if _ORDER[event] > _ORDER[now] else now


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, n = state.get if state.exists else (None, 0)
    events = pd.concat(list(parts)).sort_values(["at", "event"], kind="stable")
    for event in events["event"]:
        status, n = next_status(status, event), n + 1
    state.update((status, n))
    yield pd.DataFrame({"document_id": [key[0]], "status": [status], "progress": [STATUSES[status][0]], "events": [n]})


def document_statuses(events: DataFrame) -> DataFrame:
    """(document_id, status, progress, events) after each micro-batch, of events (document_id, event, at)."""
    return events.groupBy("document_id").applyInPandasWithState(
        _advance, "document_id long, status string, progress long, events long", "status string, n long", "update", GroupStateTimeout.NoTimeout
    )


def status_of(times: dict[str, int]) -> str | None:
    """The status by the latest time of every kind of event: archived for good; after the last upload failed, or the farthest stage."""
    if not times:
        return None
    if "archived" in times:
        return "archived"
    since = times.get("uploaded", min(times.values()) - 1)
    later = [e for e, at in times.items() if at > since]
    return "failed" if "failed" in later else max(later, key=_ORDER.__getitem__, default="uploaded")


#: A state holds the documents whose ids agree but for so many low bits, so Python is called once for up to 64 of them.
BLOCK_BITS = 6


def _changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known: dict[str, dict[str, int]] = json.loads(state.get[0]) if state.exists else {}
    before: dict[str, str | None] = {}
    for part in parts:
        at = part["at"].to_numpy("datetime64[ns]").astype("int64").tolist()
        for document, event, when, missing in zip(part["document_id"].tolist(), part["event"].tolist(), at, part["at"].isna().tolist(), strict=True):
            name = str(document)
            times = known.setdefault(name, {})
            if name not in before:
                before[name] = status_of(times)
            if event in _ORDER and not missing:
                times[event] = max(times.get(event, when), when)
    state.update((json.dumps(known),))
    moved = [(int(name), old, new) for name, old in before.items() if (new := status_of(known[name])) != old]
    if moved:
        yield pd.DataFrame(moved, columns=["document_id", "old", "new"])


def status_changes(events: DataFrame) -> DataFrame:
    """(document_id, old, new) whenever a micro-batch of events (document_id, event, at) changes a document's status.

    The state is the latest time of each kind of event, so late, repeated and reordered events lead to the same status
    however they are split into micro-batches. Unknown events and those without a time change nothing. States of
    documents with neighbouring ids lie together, 64 at most.
    """
    known = events.where("document_id is not null").select(F.col("document_id").cast("long").alias("document_id"), "event", "at")
    return known.withColumn("block", F.shiftright("document_id", BLOCK_BITS)).groupBy("block").applyInPandasWithState(
        _changed, "document_id long, old string, new string", "times string", "update", GroupStateTimeout.NoTimeout
    )


def counts_by_status(changes: DataFrame) -> DataFrame:
    """(status, n) from status changes: what documents left is taken back from what they came to."""
    moved = F.explode(F.array(F.struct(F.col("new").alias("status"), F.lit(1).alias("by")), F.struct(F.col("old").alias("status"), F.lit(-1).alias("by"))))
    return changes.select(moved.alias("m")).where("m.status is not null").groupBy("m.status").agg(F.sum("m.by").alias("n")).where("n != 0")


def jobs_per_window(requests: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests by type and time window; later ones than ``late`` are dropped."""
    counted = requests.withWatermark("created_at", late).groupBy(F.window("created_at", window), "job_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "job_type", "n")
