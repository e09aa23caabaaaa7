"""The job queue as keyed state: a job per document and type, moved by events and by timers.

A request makes a job unless one of the same document and type is active. An admitted job runs at once: its transition to
``running`` leaves the state machine with the number of the attempt, and whoever processes the micro-batch answers with a
``done`` or ``error`` event for that attempt. An attempt without an answer ends when its timer fires. Failed attempts run
again until they are used up; finished jobs leave the state after a while. A call of Python costs a hundred times what a job's
step does, so the jobs of neighbouring documents share a state, with the earliest of their timers. States travel to Python with the events, in
Arrow batches, and back; the JVM looks through all states for timers. Answers to an attempt that is over, repeated ones too, change nothing, so a micro-batch may run again.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import MAX_ATTEMPTS

EVENT = "document_id long, job_type string, event string, at timestamp, attempt int, error string"
TRANSITION = "document_id long, job_type string, requested_at timestamp, status string, attempt int, progress int, at timestamp, error string"
#: A list of jobs as JSON: document, type, what the job is (running, completed or failed; its attempt; the times of its request and of this
#: state, and when its timer is due, as epoch milliseconds), and from when on its timer may fire.
STATE = "jobs string"
#: A state holds the jobs of documents whose ids agree but for so many low bits, 256 documents at most.
BLOCK_BITS = 8
#: The state store that the queue uses: states lie on disk.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ORDER = {"done": 0, "error": 1, "request": 2}
_PROGRESS = {"running": 1, "completed": 100, "failed": 100}


_COLUMNS = [c.split()[0] for c in TRANSITION.split(", ")]


class _Jobs:
    """What events and timers make of a block's jobs; times are epoch milliseconds."""

    def __init__(self, timeout: int, max_attempts: int, keep: int):
        self.timeout, self.max_attempts, self.keep = timeout * 1000, max_attempts, keep * 1000

    def _next(self, status: str, attempt: int, requested: int, at: int, error: str | None) -> tuple[tuple, str | None]:
        due = at + (self.timeout if status == "running" else self.keep)
        return (status, attempt, requested, at, due), error

    def _ended(self, attempt: int, requested: int, at: int, error: str) -> tuple[tuple, str | None]:
        """A failed attempt: the next one, or the end."""
        again = attempt < self.max_attempts
        return self._next("running" if again else "failed", attempt + again, requested, at, error)

    def _event(self, job: tuple | None, event: str, at: int, attempt: int, error: str | None) -> tuple[tuple, str | None] | None:
        running = job is not None and job[0] == "running"
        if event == "request":
            return None if running else self._next("running", 1, at, at, None)
        if not running or attempt != job[1]:
            return None
        return self._next("completed", job[1], job[2], at, None) if event == "done" else self._ended(job[1], job[2], at, error or "failed")

    def turn(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        jobs = {(document, kind): (tuple(job), fires) for document, kind, job, fires in json.loads(state.get[0])} if state.exists else {}
        events: dict[tuple, list[tuple]] = {}
        for f in frames if not state.hasTimedOut else ():
            at = f["at"].to_numpy("datetime64[ms]").astype("int64").tolist()
            for document, kind, *event in zip(f["document_id"].tolist(), f["job_type"].tolist(), at, f["event"].tolist(), f["attempt"].tolist(), f["error"].tolist(), strict=True):
                events.setdefault((document, kind), []).append(event)
        made: list[tuple[tuple, tuple, str | None]] = []
        # A job's events come before its timer, which is set anew then.
        for own in [own for own, (_, fires) in jobs.items() if fires < now and own not in events]:
            job, _ = jobs.pop(own)
            if job[0] == "running":
                job, error = self._ended(job[1], job[2], job[4], f"Job timed out after {self.timeout // 1000} seconds.")
                made.append((own, job, error))
                jobs[own] = job, max(job[4], now + 1)
        for own, given in events.items():
            job = jobs[own][0] if own in jobs else None
            for at, event, attempt, error in sorted((e for e in given if e[1] in _ORDER), key=lambda e: (e[0], _ORDER[e[1]])):
                step = self._event(job, event, at, attempt, error)
                if step:
                    job = step[0]
                    made.append((own, *step))
            if job is not None:
                jobs[own] = job, max(job[4], now + 1)
        if jobs:
            state.update((json.dumps([(*own, job, fires) for own, (job, fires) in jobs.items()]),))
            # A timer that is due already fires as the time goes on.
            state.setTimeoutTimestamp(max(min(fires for _, fires in jobs.values()), now + 1))
        elif state.exists:
            state.remove()
        if made:
            rows = pd.DataFrame([(*own, r, status, attempt, _PROGRESS[status], at, error) for own, (status, attempt, r, at, _), error in made], columns=_COLUMNS)
            yield rows.assign(**{c: pd.to_datetime(rows[c], unit="ms") for c in ("requested_at", "at")})


def job_transitions(events: DataFrame, timeout: int = 300, max_attempts: int = MAX_ATTEMPTS, keep: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Transitions (TRANSITION) of a stream of events (EVENT); times are the events' own.

    Events older than the watermark, ``late`` behind the newest, are dropped (an answer so late counts as none, so it should
    be longer than ``timeout``); timers fire as it passes them. ``keep``:
    seconds until a finished job is forgotten. A state holds the jobs of up to 256 documents. Unknown events change nothing. The stream needs the state store STORE.
    """
    known = events.where("document_id is not null and job_type is not null").withWatermark("at", late)
    return known.withColumn("block", F.shiftright("document_id", BLOCK_BITS)).groupBy("block").applyInPandasWithState(_Jobs(timeout, max_attempts, keep).turn, TRANSITION, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest_states(transitions: DataFrame) -> DataFrame:
    """The last transition of every job: of a document, type and request."""
    rank = F.struct("attempt", F.when(F.col("status") == "running", 0).otherwise(1), "at")
    last = transitions.groupBy("document_id", "job_type", "requested_at").agg(F.max_by(F.struct("status", "attempt", "progress", "at", "error"), rank).alias("last"))
    return last.select("document_id", "job_type", "requested_at", "last.*")


class TimeLimitError(Exception):
    """Work that was stopped."""


def with_time_limit(spark: SparkSession, seconds: float, work: Callable[[], None]) -> None:
    """Do work that runs Spark jobs; if it takes longer, cancel its jobs and raise TimeLimitError."""
    group, raised = f"limited-{uuid.uuid4().hex}", []

    def run() -> None:
        try:
            spark.sparkContext.setJobGroup(group, "limited", interruptOnCancel=True)
            work()
        except BaseException as e:  # handed to the caller
            raised.append(e)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    while thread.is_alive():  # a job that begins between two calls is met by the next
        spark.sparkContext.cancelJobGroup(group)
        thread.join(0.2)
    if late:
        raise TimeLimitError(f"stopped after {seconds:g} seconds")
    if raised:
        raise raised[0]


#: From claimed jobs (TRANSITION) to answers (document_id, job_type, attempt, error, at); a job it leaves out waits for its timer.
Processor = Callable[[DataFrame], DataFrame]


def start_queue(spark: SparkSession, folder: str, out: str, checkpoint: str, processors: dict[str, Processor], timeout: int = 300, max_attempts: int = MAX_ATTEMPTS, time_limit: float | None = None, poll: str | None = None, **options) -> StreamingQuery:
    """Run the queue on event files under ``folder``; transitions go to ``out``/batch=N, answers to ``folder``/answers/batch=N.

    A type's jobs of a micro-batch go to its processor together; if that raises, or is stopped after ``time_limit``
    seconds, they all get the error as their answer. Without ``poll`` the stream ends when it has read what was there.
    """
    events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(folder)

    def answered(claimed: DataFrame, process: Processor, path: str) -> None:
        said = process(claimed).select("document_id", "job_type", F.when(F.col("error").isNull(), "done").otherwise("error").alias("event"), "at", "attempt", "error")
        said.write.mode("overwrite").parquet(path)

    def handle(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        written = batch.sparkSession.read.schema(TRANSITION).parquet(path)
        for kind, process in processors.items():
            claimed = written.where((F.col("status") == "running") & (F.col("job_type") == kind))
            if claimed.isEmpty():
                continue
            to = f"{folder}/answers/batch={number}-{kind}"
            try:
                with_time_limit(batch.sparkSession, time_limit or threading.TIMEOUT_MAX, lambda claimed=claimed, process=process, to=to: answered(claimed, process, to))
            except Exception as e:  # whatever a processor raises ends this attempt of its jobs
                failed = claimed.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500]))
                answered(failed, lambda jobs: jobs, to)

    stream = job_transitions(events, timeout, max_attempts, **options).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("update")
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # a stream keeps the settings it was started with
    try:
        return (stream.trigger(processingTime=poll) if poll else stream.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def drain_queue(spark: SparkSession, folder: str, out: str, checkpoint: str, processors: dict[str, Processor], **options) -> DataFrame:
    """Run the queue until no answer leads to another attempt; the transitions of all runs."""
    while True:
        before = _batches(spark, out)
        start_queue(spark, folder, out, checkpoint, processors, **options).awaitTermination()
        fresh = _batches(spark, out) - before
        written = spark.read.schema(TRANSITION).parquet(*(f"{out}/{b}" for b in sorted(fresh))) if fresh else None
        if written is None or written.where(F.col("status").isin("running") & F.col("job_type").isin(*processors)).isEmpty():
            return spark.read.schema(TRANSITION).option("recursiveFileLookup", "true").parquet(out)


def _batches(spark: SparkSession, out: str) -> set[str]:
    """Names of the folders under ``out``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
