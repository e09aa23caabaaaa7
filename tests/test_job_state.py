"""The queue as keyed state: deduplication, retries, timers, repeated answers, time limits, restarts."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvella.streaming import job_state
from corvella.streaming.job_state import EVENT

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def queue(spark, tmp_path):
    """(put events, run): event files and runs of one queue."""
    def put(*rows):
        full = [(d, kind, event, T0 + dt.timedelta(seconds=s), attempt, error) for d, kind, event, s, attempt, error in rows]
        spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(processors=None, **options):
        moved = job_state.drain_queue(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), processors or {}, late="1 second", **options)
        return [(r.document_id, r.job_type, r.status, r.attempt, int((r.at - T0).total_seconds()), r.error) for r in moved.orderBy("document_id", "job_type", "at", "attempt", "status").collect()]

    return put, run


def _processor(jobs):
    """Answers a second after an attempt began: documents 3, 13, ... fail at first, 5, 15, ... always; 7 is never named."""
    d = F.col("document_id")
    error = F.when(d % 10 == 5, "bad file").when((d % 10 == 3) & (F.col("attempt") == 1), "try again")
    return jobs.where(d != 7).select("document_id", "job_type", "attempt", (F.col("at") + F.expr("interval 1 second")).alias("at"), error.alias("error"))


def test_jobs_complete_retry_and_fail(queue):
    put, run = queue
    put((1, "ocr", "request", 0, None, None), (3, "ocr", "request", 0, None, None), (5, "ocr", "request", 0, None, None), (1, "ocr", "request", 0, None, None), (None, "ocr", "request", 0, None, None), (9, "other", "request", 0, None, None), (8, "ocr", "odd", 0, None, None))
    assert run({"ocr": _processor}) == [
        (1, "ocr", "running", 1, 0, None), (1, "ocr", "completed", 1, 1, None),
        (3, "ocr", "running", 1, 0, None), (3, "ocr", "running", 2, 1, "try again"), (3, "ocr", "completed", 2, 2, None),
        (5, "ocr", "running", 1, 0, None), (5, "ocr", "running", 2, 1, "bad file"), (5, "ocr", "failed", 2, 2, "bad file"),
        (9, "other", "running", 1, 0, None),
    ]


def test_answers_count_once_and_only_for_their_attempt(queue):
    put, run = queue
    put((1, "ocr", "request", 0, None, None))
    run()
    put((1, "ocr", "error", 2, 1, "x"), (1, "ocr", "error", 2, 1, "x"), (1, "ocr", "done", 3, 1, None), (1, "ocr", "done", 4, 7, None))
    assert run()[1:] == [(1, "ocr", "running", 2, 2, "x")]
    put((1, "ocr", "done", 5, 2, None), (1, "ocr", "done", 5, 2, None), (1, "ocr", "request", 4, None, None), (1, "ocr", "request", 6, None, None))
    assert run()[2:] == [(1, "ocr", "completed", 2, 5, None), (1, "ocr", "running", 1, 6, None)]


def test_timers_end_attempts_and_forget_finished_jobs(queue):
    put, run = queue
    options = {"timeout": 300, "keep": 1_000}
    put((7, "ocr", "request", 0, None, None), (1, "ocr", "request", 0, None, None))
    run({"ocr": _processor}, **options)
    put((2, "x", "request", 302, None, None))  # time passes
    run({"ocr": _processor}, **options)
    put((2, "x", "request", 700, None, None))
    late = "Job timed out after 300 seconds."
    assert [r for r in run({"ocr": _processor}, **options) if r[0] == 7] == [(7, "ocr", "running", 1, 0, None), (7, "ocr", "running", 2, 300, late), (7, "ocr", "failed", 2, 600, late)]
    put((2, "x", "request", 5_000, None, None))
    run(**options)
    put((7, "ocr", "done", 5_001, 2, None), (7, "ocr", "request", 5_002, None, None))
    assert [r for r in run(**options) if r[0] == 7][3:] == [(7, "ocr", "running", 1, 5_002, None)]


def test_a_processor_that_raises_or_takes_too_long(spark, queue):
    put, run = queue

    def raises(jobs):
        raise RuntimeError("no disk")

    def sleeps(jobs):
        wait = F.udf(lambda d: time.sleep(600), "string")
        return jobs.withColumn("error", wait("document_id"))

    put((1, "raises", "request", 0, None, None), (2, "sleeps", "request", 0, None, None))
    began = time.time()
    rows = run({"raises": raises, "sleeps": sleeps}, time_limit=3, max_attempts=1)
    assert time.time() - began < 120
    assert sorted((r[0], r[2], r[5] or "") for r in rows) == [(1, "failed", "RuntimeError: no disk"), (1, "running", ""), (2, "failed", "TimeLimitError: stopped after 3 seconds"), (2, "running", "")]
    assert spark.range(3).count() == 3  # the session goes on


def test_latest_states(spark, queue, tmp_path):
    put, run = queue
    put(*((d, "ocr", "request", 0, None, None) for d in range(20)))
    run({"ocr": _processor})
    last = job_state.latest_states(spark.read.schema(job_state.TRANSITION).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")))
    want = {d: ("failed", 2) if d % 10 == 5 else ("completed", 2) if d % 10 == 3 else ("running", 1) if d == 7 else ("completed", 1) for d in range(20)}
    assert {r.document_id: (r.status, r.attempt) for r in last.collect()} == want


def test_states_travel_in_batches(spark, tmp_path):
    """Calls to the state store one by one, several a job, made the queue wait; states must come with the events."""
    spark.createDataFrame([], EVENT).write.parquet(str(tmp_path / "in"))
    moved = job_state.job_transitions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
    plan = moved._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def test_neighbouring_documents_share_a_call():
    """A call of Python a job took most of the time; events, timers and answers of a block's jobs keep apart."""
    class State:
        exists, hasTimedOut, value, due, now = False, False, None, None, 0  # noqa: N815

        get = property(lambda self: self.value)

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists, self.value = False, None

        def setTimeoutTimestamp(self, at):  # noqa: N802
            assert at > self.now
            self.due = at

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.now

    def frame(*rows):
        return pd.DataFrame([(d, k, e, pd.Timestamp(s, unit="s"), a, None) for d, k, e, s, a in rows], columns=["document_id", "job_type", "event", "at", "attempt", "error"])

    jobs, state = job_state._Jobs(300, 2, 1_000), State()
    rows = lambda found: [(r.document_id, r.job_type, r.status, r.attempt, int(r.at.timestamp())) for f in found for r in f.itertuples()]
    assert rows(jobs.turn((0,), iter([frame(*((d, "ocr", "request", d, None) for d in range(200))), frame((3, "x", "request", 9, None))]), state)) == [*((d, "ocr", "running", 1, d) for d in range(200)), (3, "x", "running", 1, 9)]
    assert state.due == 300_000
    state.now = 302_000  # documents 0 and 1 are late, but 1 has an answer now
    assert rows(jobs.turn((0,), iter([frame((1, "ocr", "done", 5, 1), (5, "ocr", "error", 6, 1))]), state)) == [(0, "ocr", "running", 2, 300), (1, "ocr", "completed", 1, 5), (5, "ocr", "running", 2, 6)]
    assert state.due == 302_001
    state.now, state.hasTimedOut = 10**10, True
    assert len(rows(jobs.turn((0,), iter([]), state))) == 200  # all but the finished one, which is forgotten
    for _ in range(4):
        state.now *= 2
        last = rows(jobs.turn((0,), iter([]), state))
    assert last == [] and not state.exists


def test_a_block_is_one_group(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(str(tmp_path / "in"))
    moved = job_state.job_transitions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
    assert "shiftright(document_id" in moved._jdf.queryExecution().analyzed().toString()
