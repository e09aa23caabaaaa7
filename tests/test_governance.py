"""Queue, retention and streaming behaviour on inline tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corvella.functions.principal import Principal
from corvella.operators import governance as gov
from corvella.operators import jobs
from corvella.operators.governance import STATUSES
from corvella.streaming import queue

NOW = dt.datetime(2024, 6, 1)
JOB = "job_id long, document_id long, job_type string, status string, progress int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string, attempts int"


def _day(n):
    return NOW - dt.timedelta(days=n)


def _jobs(spark):
    rows = [(1, 1, "document", "queued", 0, _day(3), None, None, None, 0), (2, 2, "ocr", "queued", 0, _day(5), None, None, "old", 0), (3, 3, "document", "running", 40, _day(9), _day(1), None, None, 1), (4, 4, "document", "completed", 100, _day(9), _day(8), _day(8), None, 1)]
    return spark.createDataFrame(rows, JOB)


def test_claims_are_first_in_first_out(spark):
    assert [r.job_id for r in jobs.next_queued(_jobs(spark)).collect()] == [2]
    assert [r.job_id for r in jobs.next_queued(_jobs(spark), "document").collect()] == [1] and jobs.next_queued(_jobs(spark), "embedding").count() == 0
    after = {r.job_id: r for r in jobs.claim(_jobs(spark), jobs.next_queued(_jobs(spark)), NOW).collect()}
    assert (after[2].status, after[2].progress, after[2].started_at, after[2].error_message) == ("running", 1, NOW, None) and after[1].status == "queued" and len(after) == 4


def test_enqueueing_skips_active_jobs(spark):
    asked = spark.createDataFrame([(1, "document", NOW), (1, "ocr", NOW), (1, "ocr", _day(1)), (3, "document", NOW), (4, "document", NOW)], "document_id long, job_type string, created_at timestamp_ntz")
    rows = jobs.enqueue(_jobs(spark), asked).collect()
    assert sorted((r.document_id, r.job_type, r.status, r.created_at) for r in rows) == [(1, "ocr", "queued", _day(1)), (4, "document", "queued", NOW)]
    assert sorted(r.job_id for r in jobs.latest_active(_jobs(spark)).collect()) == [1, 2, 3]


def test_outcomes_retry_until_attempts_run_out(spark):
    outcomes = spark.createDataFrame([(1, None), (2, "first"), (3, "second")], "job_id long, error string")
    after = {r.job_id: (r.status, r.progress, r.error_message, r.attempts) for r in jobs.finish(_jobs(spark), outcomes, NOW).collect()}
    assert after[1] == ("completed", 100, None, 1) and after[2] == ("queued", 0, "first", 1) and after[3] == ("failed", 100, "second", 2) and after[4][0] == "completed"
    assert [(r.job_id, r.error) for r in jobs.timed_out(_jobs(spark), NOW).collect()] == [(3, "Job timed out after 300 seconds.")]


def _retention_tables(spark):
    log = "log_id long, message_id long, created_at timestamp_ntz"
    return {
        "documents": spark.createDataFrame([(1, "ready", _day(400), _day(400)), (2, "archived", _day(400), _day(400)), (3, "ready", _day(1), _day(1)), (4, "ready", None, None)], "document_id long, status string, created_at timestamp_ntz, updated_at timestamp_ntz"),
        "messages": spark.createDataFrame([(1, _day(400)), (2, _day(400)), (3, _day(400)), (4, _day(1))], "message_id long, created_at timestamp_ntz"),
        "retrieval_logs": spark.createDataFrame([(1, 1, _day(200)), (2, None, _day(1))], log),
        "masking_events": spark.createDataFrame([(1, 2, _day(1))], log),
        "llm_logs": spark.createDataFrame([], log),
        "audit_events": spark.createDataFrame([(1, 1, _day(800))], log),
    }


def test_retention_preview_changes_nothing(spark):
    counts, after = gov.retention(_retention_tables(spark), gov.RetentionPolicy(), NOW, apply=False)
    assert {r.name: r.n for r in counts.collect()} == {"documents": 1, "retrieval_logs": 1, "masking_events": 0, "llm_logs": 0, "audit_events": 1, "messages": 1}
    assert after["messages"].count() == 4 and after["documents"].where("status = 'archived'").count() == 1


def test_retention_frees_messages_of_deleted_logs(spark):
    counts, after = gov.retention(_retention_tables(spark), gov.RetentionPolicy(), NOW, apply=True)
    assert {r.name: r.n for r in counts.collect()}["messages"] == 2
    assert sorted(r.message_id for r in after["messages"].collect()) == [2, 4]
    docs = {r.document_id: (r.status, r.updated_at) for r in after["documents"].collect()}
    assert docs[1] == ("archived", NOW) and docs[2] == ("archived", _day(400)) and docs[3][0] == docs[4][0] == "ready"
    assert after["retrieval_logs"].count() == 1 and after["audit_events"].count() == 0


def test_audit_reads(spark):
    events = spark.createDataFrame([(1, 1, "login", _day(2)), (2, 2, "denied", _day(1)), (3, None, "denied", None)], "event_id long, user_id long, event_type string, created_at timestamp_ntz")
    users = spark.createDataFrame([(1, "ann"), (2, "bob")], "user_id long, external_user_id string")
    ids = lambda *a, **k: [r.event_id for r in gov.audit_events(events, users, *a, **k).collect()]
    assert ids() == [3, 2, 1] and ids("denied") == [3, 2] and ids("", "ann") == [1] and ids(None, "2") == [2] and ids(limit=1) == [3]
    messages = spark.createDataFrame([(1, 1, "user", "low", _day(3)), (2, None, "user", "high", _day(2)), (3, 1, "assistant", "low", _day(1))], "message_id long, user_id long, role string, risk_level string, created_at timestamp_ntz")
    logs = lambda *a, **k: [r.message_id for r in gov.chat_logs(messages, users, *a, **k).collect()]
    assert logs() == [2, 1] and logs("ann") == [1] and logs(start=_day(3), end=_day(3)) == [1] and logs(risk_level="high") == [2]
    for bad in (0, 501):
        try:
            gov.audit_events(events, users, limit=bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_statuses_and_totals(spark):
    docs = spark.createDataFrame([(1, "parsing", None), (2, "failed", "boom"), (3, "ready", "")], "document_id long, status string, error_message string")
    got = {r.document_id: (r.progress, r.message) for r in gov.status_view(docs).collect()}
    assert got == {1: (20, "Parser is running."), 2: (100, "boom"), 3: (100, "Document is searchable.")}
    states = lambda *s: gov.overall_status(spark.createDataFrame([(x,) for x in s], "status string")).first().status
    assert states("ok", "ok") == "ok" and states("ok", "down") == "degraded"
    calls = spark.createDataFrame([(3, None), (1, 2)], "prompt_tokens int, completion_tokens int")
    assert sorted(r.total_tokens for r in gov.llm_log_rows(calls).collect()) == [3, 3]
    sessions = spark.createDataFrame([(5, 1), (6, None)], "session_id long, user_id long")
    asked = spark.createDataFrame([(1, 5, 1, False, "q"), (2, 5, 2, False, "q"), (3, 5, 2, True, "q"), (4, None, 2, False, " "), (5, 99, 2, False, "q")], "request_id long, session_id long, user_id long, is_admin boolean, query string")
    assert {r.request_id: (r.outcome, r.title) for r in gov.ensure_sessions(sessions, asked).collect()} == {1: ("own", "q"), 2: ("denied", "q"), 3: ("own", "q"), 4: ("created", "Untitled chat"), 5: ("denied", "q")}


def _land(spark, folder, rows, n):
    spark.createDataFrame(rows, queue.REQUEST).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def test_requests_take_effect_once_over_restarts(spark, tmp_path):
    asked, out, mark = (str(tmp_path / x) for x in ("asked", "out", "checkpoint"))
    at = dt.datetime(2024, 1, 1, 12)
    spark.createDataFrame([(1, "ocr", at), (1, "ocr", at), (2, "ocr", at)], queue.REQUEST).coalesce(1).write.mode("append").parquet(asked)
    run = lambda: queue.run_worker(queue.unique_requests(queue.read_requests(spark, asked)), lambda b, n: b.withColumn("n", F.lit(n)), out, mark).awaitTermination()
    run()
    spark.createDataFrame([(1, "ocr", at + dt.timedelta(minutes=5)), (3, "ocr", at)], queue.REQUEST).coalesce(1).write.mode("append").parquet(asked)
    run()
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.document_id for r in rows) == [1, 2, 3]


def test_document_states_stream(spark, tmp_path):
    schema = "document_id long, event string, at timestamp"
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "uploaded", at), (1, "parsing", at + dt.timedelta(1)), (2, "uploaded", at)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = queue.document_statuses(spark.readStream.schema(schema).parquet(folder))

    def run():
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(1, "ready", at + dt.timedelta(2)), (1, "chunking", at + dt.timedelta(3)), (2, "failed", at + dt.timedelta(1)), (2, "ready", at + dt.timedelta(2))], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    rows = {(r.document_id, r.events): (r.status, r.progress) for r in spark.read.parquet(out).collect()}
    assert rows == {(1, 2): ("parsing", 20), (2, 1): ("uploaded", 5), (1, 4): ("ready", 100), (2, 3): ("failed", 100)}


def test_status_machine():
    assert queue.next_status(None, "uploaded") == "uploaded" and queue.next_status("ready", "parsing") == "ready" and queue.next_status("failed", "uploaded") == "uploaded"
    assert queue.next_status("archived", "ready") == "archived" and queue.next_status("parsing", "no such") == "parsing"


def test_windows_count_requests(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    spark.createDataFrame([(1, "ocr", at), (2, "ocr", at + dt.timedelta(minutes=3)), (3, "ocr", at + dt.timedelta(hours=9))], queue.REQUEST).coalesce(1).write.parquet(str(tmp_path / "asked"))
    q = queue.jobs_per_window(queue.read_requests(spark, str(tmp_path / "asked"))).writeStream.outputMode("complete").format("memory").queryName("per_window").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("per_window").collect()) == [1, 2]


def test_bases_and_events_are_appended(spark):
    bases = spark.createDataFrame([("b1", "legal", "public", dt.datetime(2024, 1, 1)), ("b2", "sales", "public", None)], "knowledge_base_id string, owner_department string, default_confidential_level string, created_at timestamp_ntz")
    new = spark.createDataFrame([("b0", "legal")], "knowledge_base_id string, owner_department string")
    now = dt.datetime(2024, 2, 1)
    docs = spark.createDataFrame([(1, "b1"), (2, "b1")], "document_id long, knowledge_base_id string")
    grants = spark.createDataFrame([("b2", "user", "bob", "read")], "knowledge_base_id string, subject_type string, subject_value string, permission string")
    every = gov.create_bases(bases, new, now)
    see = lambda p: [(r.knowledge_base_id, r.default_confidential_level, r.document_count) for r in gov.list_bases(every, docs, grants, p).collect()]
    assert see(Principal("bob")) == [("b2", "public", 0), ("b0", "internal", 0), ("b1", "public", 2)]
    assert see(Principal("ann")) == [("b0", "internal", 0), ("b1", "public", 2)]
    events = spark.createDataFrame([(1, "view", '{"a":1}', None)], "event_id long, event_type string, metadata string, created_at timestamp_ntz")
    got = gov.record_events(events, spark.createDataFrame([(2, "click", None), (3, "view", "[]")], "event_id long, event_type string, metadata string"), now).orderBy("event_id").collect()
    assert [(r.metadata, r.created_at) for r in got] == [('{"a":1}', None), ("{}", now), ("[]", now)]


def _sequential(events):
    """The status rules one event after another, in order of time."""
    now = None
    for _, event in sorted(events, key=lambda e: e[0]):
        now = queue.next_status(now, event)
    return now


def test_statuses_and_counts_do_not_depend_on_micro_batches(spark, tmp_path):
    """Shuffled and repeated events in several batches, against the rules applied to all of them in order."""
    rng = random.Random(5)
    kinds = list(STATUSES)
    events = {d: [(t, rng.choice(kinds[:7] * 3 + kinds)) for t in range(1, rng.randrange(2, 9))] for d in range(80)}
    events = {d: [(0, "uploaded"), *e] for d, e in events.items()}
    rows = [(d, event, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for d, e in events.items() for t, event in e]
    rows += rng.sample(rows, 60) + [(5, "odd", dt.datetime(2025, 1, 1)), (6, "failed", None), (None, "failed", dt.datetime(2025, 1, 1))]
    rng.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], "document_id long, event string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("document_id long, event string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    writer = queue.status_changes(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
    writer.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema("document_id long, old string, new string, batch int").parquet(f"{tmp_path}/out").cache()
    want = {d: _sequential(e) for d, e in events.items()}
    last = {}
    for r in changes.orderBy("batch").collect():
        assert last.get(r.document_id) == r.old
        last[r.document_id] = r.new
    assert last == want
    counts = {r.status: r.n for r in queue.counts_by_status(changes).collect()}
    assert counts == {s: list(want.values()).count(s) for s in set(want.values())}
