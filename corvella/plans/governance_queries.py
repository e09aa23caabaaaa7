"""Registered queries: audit reads, totals, retention, listings and the job queue, each with its DuckDB counterpart."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.principal import may_administer, token_columns
from ..operators import governance as gov
from ..operators import ingestion, jobs, layout, security
from ..streaming import ingest, job_state, queue
from . import views
from .scratch import scratch_dir
from .search_queries import open_sql, readable_sql
from .views import PRINCIPAL, with_views

NOW = dt.datetime(2024, 6, 1)
POLICY = gov.RetentionPolicy(documents=140, messages=30, retrieval_logs=140, masking_events=130, llm_logs=150, audit_events=145)
_DAY = "yyyy-MM-dd HH:mm:ss"


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = gov.count_by_status(views.documents(spark, sf)).withColumn("of", F.lit("documents"))
    return both.unionByName(gov.count_by_status(views.jobs(spark, sf)).withColumn("of", F.lit("jobs")))


def _logs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "retrieval_logs": views.retrieval_logs(spark, sf),
        "masking_events": views.masking_events(spark, sf),
        "llm_logs": views.llm_logs(spark, sf),
        "audit_events": views.audit_events(spark, sf),
    }


def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return gov.totals(**_logs(spark, sf))


def kb_document_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gov.base_document_counts(views.knowledge_bases(spark, sf), views.documents(spark, sf)).select("knowledge_base_id", "document_count")


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return gov.chunk_counts(views.chunks(spark, sf))


def document_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return gov.status_view(views.documents(spark, sf))


def doc_listing_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of ready documents, of which only readable ones are shown."""
    page = gov.list_page(views.documents(spark, sf), 3, 20, status="ready")
    shown = security.can_read_documents(page, views.document_permissions(spark, sf), views.base_permissions(spark, sf), PRINCIPAL)
    return shown.where("can_read").select("document_id")


def chat_logs(spark: SparkSession, sf: str) -> DataFrame:
    found = gov.chat_logs(views.messages(spark, sf), views.users(spark, sf), None, dt.datetime(2024, 1, 2), dt.datetime(2024, 12, 1), "medium", 100)
    return found.select("message_id", gov.shown_text().alias("content"), F.date_format("created_at", _DAY).alias("created"))


def user_chat_logs(spark: SparkSession, sf: str) -> DataFrame:
    found = gov.chat_logs(views.messages(spark, sf), views.users(spark, sf), "u13")
    return found.select("message_id", "user_id", "risk_level")


def llm_logs(spark: SparkSession, sf: str) -> DataFrame:
    return gov.llm_log_rows(gov.llm_logs(views.llm_logs(spark, sf), status="failed")).select("log_id", "message_id", "total_tokens")


def message_retrieval_logs(spark: SparkSession, sf: str) -> DataFrame:
    return gov.retrieval_logs(views.retrieval_logs(spark, sf), document_id=42).select("log_id", "message_id", "rank")


def permission_denied(spark: SparkSession, sf: str) -> DataFrame:
    return gov.audit_events(views.audit_events(spark, sf), views.users(spark, sf), "permission_denied").select("event_id", "user_id")


def user_audit_events(spark: SparkSession, sf: str) -> DataFrame:
    return gov.audit_events(views.audit_events(spark, sf), views.users(spark, sf), "", "u12").select("event_id", "event_type")


def session_messages(spark: SparkSession, sf: str) -> DataFrame:
    return gov.session_messages(views.messages(spark, sf), 2).select("message_id", "role", F.sha2("original_content", 256).alias("text_sha256"))


def _retained(spark: SparkSession, sf: str, apply: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    return gov.retention({"documents": views.documents(spark, sf), "messages": views.messages(spark, sf), **_logs(spark, sf)}, POLICY, NOW, apply)


def retention_preview(spark: SparkSession, sf: str) -> DataFrame:
    return _retained(spark, sf, False)[0]


def retention_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _retained(spark, sf, True)[0]


def retention_survivors(spark: SparkSession, sf: str) -> DataFrame:
    after = _retained(spark, sf, True)[1]
    return gov.totals(**after).unionByName(gov.count_by_status(after["documents"]).select(F.concat(F.lit("documents "), "status").alias("name"), "n"))


def job_claim(spark: SparkSession, sf: str) -> DataFrame:
    """The queue after the job that waited longest is claimed, as counts, and the job itself."""
    queued = views.jobs(spark, sf)
    after = jobs.claim(queued, jobs.next_queued(queued, "ocr"), NOW)
    return after.where((F.col("status") == "running") & F.col("started_at").isNotNull()).select("job_id", "progress", F.date_format("started_at", _DAY).alias("started"))


def job_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for every document and type; those without an active job become jobs."""
    requests = views.documents(spark, sf).select("document_id", F.explode(F.array(*map(F.lit, jobs.JOB_TYPES))).alias("job_type"), "created_at")
    return jobs.enqueue(views.jobs(spark, sf), requests.unionByName(requests)).select("document_id", "job_type", "status", "progress")


def latest_active_job(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest_active(views.jobs(spark, sf)).select("document_id", "job_type", "job_id", "status")


def job_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Running jobs end: even ones well, odd ones with an error and a second attempt."""
    queued = views.jobs(spark, sf)
    outcomes = queued.where("status = 'running'").select("job_id", F.when(F.col("job_id") % 2 == 1, F.lit("boom")).cast("string").alias("error"))
    return jobs.finish(queued, outcomes, NOW).groupBy("status", "attempts").agg(F.count("*").alias("n"), F.count("error_message").alias("n_errors"), F.sum("progress").alias("progress"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Who may go on with which session."""
    m = views.messages(spark, sf)
    known = m.groupBy("session_id").agg(F.max("user_id").alias("user_id"))
    asked = m.select(F.col("message_id").alias("request_id"), F.when(F.col("turn") % 2 == 0, F.col("session_id")).alias("session_id"), (F.col("session_id") % 50).alias("user_id"), (F.col("session_id") % 9 == 0).alias("is_admin"), F.col("original_content").alias("query"))
    return gov.ensure_sessions(known, asked).select("request_id", "outcome", F.sha2("title", 256).alias("title_sha256"))


def user_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Users known from events; those that chat come in with a department."""
    old = views.users(spark, sf).withColumn("department", F.lit("sales"))
    seen = views.messages(spark, sf).where("user_id is not null").select(F.concat(F.lit("u"), "user_id").alias("external_user_id"), F.lit("legal").alias("department")).distinct()
    return gov.ensure_users(old, seen).groupBy("department").agg(F.count("*").alias("n"), F.countDistinct("external_user_id").alias("n_users"))


def archived_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.documents(spark, sf).withColumn("updated_at", F.col("created_at"))
    after = gov.archive(docs, docs.where("status = 'failed'"), NOW)
    return after.groupBy("status").agg(F.count("*").alias("n"), F.sum((F.col("updated_at") > F.col("created_at")).cast("long")).alias("n_touched"))


def status_tool(spark: SparkSession, sf: str) -> DataFrame:
    """The status of document 1, as far as the principal may see it."""
    return gov.document_status_for(views.documents(spark, sf), views.document_permissions(spark, sf), views.base_permissions(spark, sf), 1, PRINCIPAL)


def grant_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled document's user grants become admin ones; then all grants to departments are withdrawn."""
    old = views.document_permissions(spark, sf)
    new = old.where("subject_type = 'user'").withColumn("permission", F.lit("admin"))
    left = security.delete_by_key(gov.set_grants(old, new, "document_id"), old.where("subject_type = 'department'"), ["document_id", "subject_type", "subject_value"])
    return left.groupBy("subject_type", "permission").agg(F.count("*").alias("n"))


def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one page and two images each, through the page pipeline to chunk rows."""
    docs = views.documents(spark, sf).withColumn("original_filename", F.concat(F.lit("f"), "document_id"))
    pages = docs.select("document_id", F.lit(1).alias("page_number"), "text")
    stored, linked = ingestion.ingest_pages(docs, pages, views.images(spark, sf))
    counts = stored.groupBy("document_id", "language", "confidential_level").agg(F.count("*").alias("n_chunks"), F.sum((F.col("metadata.source_type") == "pdf_image").cast("long")).alias("n_image_chunks"), F.max("chunk_index").alias("last"))
    has = linked.groupBy("document_id").agg(F.count("chunk_id").alias("n_linked"))
    return counts.join(has, "document_id")


def queue_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Requests from the events stream, each document and type once, worked off in micro-batches."""
    root = scratch_dir(spark, "queue")
    e = F.col("event_id")
    stream = spark.readStream.schema(views.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    asked = stream.select((e % 200).alias("document_id"), F.get(F.array(*map(F.lit, jobs.JOB_TYPES)), (e % 3).cast("int")).alias("job_type"), F.col("ts").cast("timestamp").alias("created_at"))
    worker = queue.run_worker(queue.unique_requests(asked, "400 days"), lambda batch, n: batch.select("document_id", "job_type"), f"{root}/out", f"{root}/checkpoint")
    worker.awaitTermination()
    return spark.read.schema("document_id bigint, job_type string, batch int").parquet(f"{root}/out").select("document_id", "job_type")


def worker_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A worker goes through the queue: what runs has timed out, documents end three ways, OCR raises, embeddings have no processor."""

    def documents(claimed: DataFrame) -> DataFrame:
        bad = F.col("job_id") % 3 == 0
        return claimed.where("job_id % 2 = 0").select("job_id", F.when(F.col("job_id") % 4 == 0, "broken file").alias("error")).where(~bad)

    def ocr(claimed: DataFrame) -> DataFrame:
        raise RuntimeError("no engine")

    late = NOW - dt.timedelta(seconds=400)
    waiting = views.jobs(spark, sf).withColumn("started_at", F.when(F.col("status") == "running", F.lit(late).cast("timestamp_ntz")))
    done = queue.run_jobs(waiting, {"document": documents, "ocr": ocr}, NOW, slots=1_000_000)
    return done.groupBy("job_type", "status", F.coalesce("error_message", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def status_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by status, counted from the changes that a stream of late, repeated and shuffled events makes in four micro-batches."""
    root = scratch_dir(spark, "status-stream")
    d = F.col("document_id")
    stages = list(gov.STATUSES)[1:7]
    made = [("uploaded", 0, F.lit(True)), *((s, k + 1, d % 7 > k) for k, s in enumerate(stages)), ("failed", 50, d % 5 == 0), ("uploaded", 60, d % 10 == 0), ("parsing", 61, d % 20 == 0), ("archived", 70, d % 11 == 0)]
    each = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(e).alias("event"), F.lit(at).alias("at"))) for e, at, when in made)))
    events = views.documents(spark, sf).select("document_id", F.explode(each).alias("e")).select("document_id", "e.event", F.timestamp_seconds("e.at").alias("at"))
    twice = events.unionByName(events.where(d % 3 == 0)).withColumn("file", F.pmod(F.xxhash64("document_id", "event", "at"), F.lit(4)))
    for k in range(4):  # what lands between two runs is a micro-batch, of as many files as tasks have written
        twice.where(F.col("file") == k).drop("file").write.parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema("document_id long, event string, at timestamp").option("recursiveFileLookup", "true").parquet(f"{root}/in")
        writer = queue.status_changes(stream).writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
        writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return queue.counts_by_status(spark.read.schema("document_id long, old string, new string, batch int").parquet(f"{root}/out"))


def image_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are images: chunks of their OCR text and of the images, links back, and those without text."""
    docs = views.documents(spark, sf).withColumn("original_filename", F.concat(F.lit("f"), "document_id", F.lit(".png")))
    stored, linked, failed = ingestion.ingest_images(docs, views.images(spark, sf))
    kinds = stored.groupBy("document_id", "language").agg(F.count("*").alias("n_chunks"), F.sum((F.col("metadata.source_type") == "image_ocr").cast("long")).alias("n_ocr"), F.max("chunk_index").alias("last"))
    links = linked.groupBy("document_id").agg(F.count("chunk_id").alias("n_linked"))
    done = ingestion.finish_documents(docs, stored, failed).select("document_id", "status", "error_message")
    return done.join(kinds, "document_id", "left").join(links, "document_id", "left")


def ingestion_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an upload, streamed in two micro-batches: every fifth broken, every third a scan, every seventh sent twice, first empty."""
    root = scratch_dir(spark, "ingestion")
    d = F.col("document_id")
    at = F.timestamp_seconds(d)
    pictures = views.images(spark, sf).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "page_number", "image_index", "image_path", "caption", "ocr_text"))).alias("images"))
    page = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text")))
    made = views.documents(spark, sf).join(pictures, "document_id").select(
        "document_id", "knowledge_base_id", "confidential_level", F.concat(F.lit("f"), d).alias("original_filename"), F.when(d % 3 == 0, "png").otherwise("pdf").alias("file_type"),
        F.when(d % 3 != 0, page).alias("pages"), "images", F.when(d % 5 == 0, "broken file").alias("error"), at.alias("at"),
    )
    early = made.where(d % 7 == 0).withColumn("pages", F.lit(None).cast(made.schema["pages"].dataType)).withColumn("images", F.lit(None).cast(made.schema["images"].dataType)).withColumn("error", F.lit("lost")).withColumn("at", at - F.expr("interval 1 hour"))
    landed = made.withColumn("file", F.pmod(F.xxhash64("document_id"), F.lit(4))).unionByName(early.withColumn("file", F.pmod(F.xxhash64("document_id") + 1, F.lit(4))))
    for half in range(2):  # what lands between two runs is a micro-batch, of as many files as tasks have written
        landed.where(F.col("file").isin(2 * half, 2 * half + 1)).drop("file").write.parquet(f"{root}/in/{half}")
        stream = spark.readStream.schema(made.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        ingest.run_ingestion(stream, f"{root}/out").awaitTermination()
    documents, chunks, images, events = (ingest.current(spark, f"{root}/out", sink) for sink in ingest.SINKS)
    cut = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_index").alias("last"), F.count_if(F.col("metadata.source_type") == "pdf_text").alias("n_text"))
    linked = images.groupBy("document_id").agg(F.count("chunk_id").alias("n_linked"))
    told = events.groupBy(F.col("target_id").cast("long").alias("document_id")).agg(F.count_if(F.col("event_type") == "document_uploaded").alias("n_uploads"))
    return documents.select("document_id", "status", "error_message", "chunk_count").join(cut, "document_id", "left").join(linked, "document_id", "left").join(told, "document_id")


def admin_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Bearer tokens made from documents: who may use the administration, and who is nobody."""
    d = F.col("document_id")
    token = F.when(d % 13 == 0, "admin").when(d % 17 == 0, "").otherwise(F.concat_ws("|", F.concat(F.lit("u"), d), F.lit("sales"), F.when(d % 7 == 0, "secret").otherwise("internal"), F.when(d % 3 == 0, "reader, admin").otherwise("administrator")))
    read = views.documents(spark, sf).select("document_id", token_columns(token).alias("t"))
    return read.select("document_id", may_administer(F.col("t")).alias("allowed"), F.col("t.error").alias("error"))


def box_centers(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of boxes made from vectors, some with an incomplete point, some without any."""
    v = F.col("vec_id")
    point = lambda i: F.array(F.get("embedding", F.lit(2 * i)).cast("double"), F.get("embedding", F.lit(2 * i + 1)).cast("double"))
    box = F.when(v % 7 == 0, F.array(point(0), F.array(F.lit(1.0)))).when(v % 11 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(*map(point, range(4))))
    center = layout.box_center(box)
    return views.table(spark, sf, "embeddings").select("vec_id", F.round(center["x"], 6).alias("x"), F.round(center["y"], 6).alias("y"))


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """A job of every document as keyed state: a tenth fails at first, a tenth always, a tenth is never answered and times out."""
    root = scratch_dir(spark, "job-states")
    d = F.col("document_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    request = lambda key, kind, when: (key.cast("long").alias("document_id"), kind.alias("job_type"), F.lit("request").alias("event"), when.alias("at"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("error"))
    docs = views.documents(spark, sf).select("document_id")
    kind = F.get(F.array(*map(F.lit, jobs.JOB_TYPES)), (d % 3).cast("int"))
    docs.unionByName(docs.where(d % 2 == 0)).select(*request(d, kind, at)).write.parquet(f"{root}/in/requests")

    def process(claimed: DataFrame) -> DataFrame:
        error = F.when(d % 10 == 5, "bad file").when((d % 10 == 3) & (F.col("attempt") == 1), "try again")
        return claimed.where(d % 10 != 7).select("document_id", "job_type", "attempt", (F.col("at") + F.expr("interval 1 second")).alias("at"), error.alias("error"))

    for hours in (0, 1, 2):  # events of another type let the time go on, past the timers
        clock = spark.range(1).select(*request(F.lit(-1), F.lit("clock"), at + F.make_dt_interval(hours=F.lit(hours))))
        clock.write.parquet(f"{root}/in/clock-{hours}")
        moved = job_state.drain_queue(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", dict.fromkeys(jobs.JOB_TYPES, process))
    return job_state.latest_states(moved).where("job_type != 'clock'").select("document_id", "job_type", "status", "attempt", "progress", "error")


def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = gov.llm_log_rows(views.llm_logs(spark, sf).withColumn("prompt_tokens", F.when(F.col("log_id") % 5 != 0, F.col("prompt_tokens"))))
    return rows.groupBy("message_id").agg(F.sum("total_tokens").alias("total_tokens"))


def dependency_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' states taken for dependencies: all of them, the good ones, and none."""
    rows = views.documents(spark, sf).select(F.when(F.col("status") == "failed", "down").otherwise("ok").alias("status"))
    return reduce(DataFrame.unionByName, (gov.overall_status(rows.where(test)).select(F.lit(of).alias("of"), "status") for of, test in (("all", "true"), ("good", "status = 'ok'"), ("none", "false"))))


def user_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Every even user edits, every third reads, every tenth administers; one assignment is doubled, one points nowhere."""
    people = views.users(spark, sf)
    u = F.col("user_id")
    held = F.array_compact(F.array(F.when(u % 2 == 0, 2), F.when(u % 2 == 0, 2), F.when(u % 3 == 0, 3), F.when(u % 10 == 0, 1), F.when(u % 7 == 0, 9)))
    roles = spark.createDataFrame([(1, "admin"), (2, "editor"), (3, "reader")], "role_id int, name string")
    named = security.with_roles(people, people.select("user_id", F.explode(held).alias("role_id")), roles)
    return named.select("user_id", F.array_join("roles", ",").alias("roles"), F.array_contains("roles", "admin").alias("is_admin"))


def recorded_events(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events and one for every document that failed, without metadata."""
    failed = views.documents(spark, sf).where("status = 'failed'")
    new = failed.select((-F.col("document_id")).alias("event_id"), F.lit("document_failed").alias("event_type"), F.lit("document").alias("target_type"), F.col("document_id").cast("string").alias("target_id"), F.col("error_message").alias("message"))
    rows = gov.record_events(views.audit_events(spark, sf), new, NOW)
    sums = {"n": F.count("*"), "n_targets": F.count("target_id"), "n_messages": F.count("message"), "n_empty": F.count_if(F.col("metadata") == "{}"), "n_now": F.count_if(F.col("created_at") == F.lit(NOW).cast("timestamp_ntz"))}
    return rows.groupBy("event_type").agg(*(c.alias(name) for name, c in sums.items()))


def base_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The bases the principal may use, with two that were just created."""
    bases = views.knowledge_bases(spark, sf).withColumn("default_confidential_level", F.lit("public")).withColumn("created_at", views.hours(F.length("knowledge_base_id")))
    new = spark.createDataFrame([("new_a", PRINCIPAL.department, None), ("new_b", "nobody's", "restricted")], "knowledge_base_id string, owner_department string, default_confidential_level string")
    seen = gov.list_bases(gov.create_bases(bases, new, NOW), views.documents(spark, sf), views.base_permissions(spark, sf), PRINCIPAL)
    return seen.select("knowledge_base_id", "default_confidential_level", F.date_format("created_at", _DAY).alias("created"), "document_count")


QUERIES = {
    f.__name__: f
    for f in (
        status_counts, audit_totals, kb_document_counts, chunk_stats, document_statuses, doc_listing_page, chat_logs, user_chat_logs, llm_logs, message_retrieval_logs, permission_denied,
        user_audit_events, session_messages, retention_preview, retention_counts, retention_survivors, job_claim, job_dedupe, latest_active_job, job_outcomes, sessions, user_upsert, archived_documents, status_tool, grant_changes, ingested, queue_stream, worker_runs, job_states, status_stream, image_documents, ingestion_stream, admin_gate, box_centers, token_totals, dependency_status, user_roles, recorded_events, base_listing,
    )
}

# ---- DuckDB ----------------------------------------------------------------------------------------------------


def _cut(days: int) -> str:
    return f"TIMESTAMP '{NOW:%Y-%m-%d} 00:00:00' - INTERVAL {days} DAY"


_AGES = {"retrieval_logs": POLICY.retrieval_logs, "masking_events": POLICY.masking_events, "llm_logs": POLICY.llm_logs, "audit_events": POLICY.audit_events}
_OLD_LOGS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM v_{t} WHERE created_at < {_cut(d)}" for t, d in _AGES.items())
_DUE = f"SELECT 'documents' AS name, count(*) AS n FROM v_documents WHERE created_at < {_cut(POLICY.documents)} AND status <> 'archived'"
_VIEWS = ("v_documents", "v_messages", "v_retrieval_logs", "v_masking_events", "v_llm_logs", "v_audit_events")


def _gone(applied: bool) -> str:
    left = lambda t: f"SELECT message_id FROM v_{t}" + (f" WHERE created_at >= {_cut(_AGES[t])}" if applied else "")
    tests = " AND ".join(f"message_id NOT IN ({left(t)})" for t in list(_AGES)[:3])
    return f"FROM v_messages WHERE created_at < {_cut(POLICY.messages)} AND {tests}"


_TITLE = f"array_to_string({views.sql_words('original_content')}, ' ')[1:80]"

ORACLES: dict[str, str] = {
    "status_counts": with_views(" SELECT 'documents' AS of, status, count(*) AS n FROM v_documents GROUP BY ALL UNION ALL SELECT 'jobs', status, count(*) FROM v_jobs GROUP BY ALL", "v_documents", "v_jobs"),
    "audit_totals": with_views(" " + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM v_{t}" for t in _AGES), *(f"v_{t}" for t in _AGES)),
    "kb_document_counts": with_views(" SELECT b.knowledge_base_id, count(d.document_id) AS document_count FROM v_bases b LEFT JOIN v_documents d USING (knowledge_base_id) GROUP BY ALL", "v_bases", "v_documents"),
    "chunk_stats": with_views(" SELECT document_id, count(*) AS chunk_count, CAST(sum(token_count) AS BIGINT) AS token_count FROM v_cut GROUP BY ALL", "v_cut"),
    "document_statuses": with_views(
        " SELECT document_id, status, CAST(CASE status "
        + " ".join(f"WHEN '{s}' THEN {p}" for s, (p, _) in gov.STATUSES.items())
        + " END AS INTEGER) AS progress, coalesce(error_message, CASE status "
        + " ".join(f"WHEN '{s}' THEN '{m}'" for s, (_, m) in gov.STATUSES.items())
        + " END) AS message FROM v_documents",
        "v_documents",
    ),
    "chat_logs": with_views(
        """ SELECT message_id, CASE WHEN final_content <> '' THEN final_content WHEN masked_content <> '' THEN masked_content ELSE original_content END AS content, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created
        FROM v_messages WHERE role = 'user' AND created_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-12-01 00:00:00' AND risk_level = 'medium' ORDER BY created_at DESC, message_id LIMIT 100""",
        "v_messages",
    ),
    "user_chat_logs": with_views(" SELECT message_id, m.user_id, risk_level FROM v_messages m JOIN v_users u ON u.user_id = m.user_id WHERE role = 'user' AND external_user_id = 'u13' ORDER BY created_at DESC, message_id LIMIT 100", "v_messages", "v_users"),
    "llm_logs": with_views(" SELECT log_id, message_id, CAST(prompt_tokens + coalesce(completion_tokens, 0) AS BIGINT) AS total_tokens FROM v_llm_logs WHERE status = 'failed' ORDER BY created_at DESC, log_id LIMIT 100", "v_llm_logs"),
    "message_retrieval_logs": with_views(" SELECT log_id, message_id, CAST(rank AS INTEGER) AS rank FROM v_retrieval_logs WHERE document_id = 42 ORDER BY created_at DESC, rank, log_id LIMIT 100", "v_retrieval_logs"),
    "permission_denied": with_views(" SELECT event_id, user_id FROM v_audit_events WHERE event_type = 'permission_denied' ORDER BY created_at DESC, event_id LIMIT 100", "v_audit_events"),
    "user_audit_events": with_views(" SELECT event_id, event_type FROM v_audit_events WHERE user_id = 12 ORDER BY created_at DESC, event_id LIMIT 100", "v_audit_events"),
    "session_messages": with_views(" SELECT message_id, role, sha256(original_content) AS text_sha256 FROM v_messages WHERE session_id = 2", "v_messages"),
    "retention_preview": with_views(f" {_DUE} UNION ALL {_OLD_LOGS} UNION ALL SELECT 'messages', count(*) {_gone(False)}", *_VIEWS),
    "retention_counts": with_views(f" {_DUE} UNION ALL {_OLD_LOGS} UNION ALL SELECT 'messages', count(*) {_gone(True)}", *_VIEWS),
    "retention_survivors": with_views(
        " SELECT 'documents' AS name, count(*) AS n FROM v_documents UNION ALL "
        + " UNION ALL ".join(f"SELECT '{t}', count(*) FROM v_{t} WHERE created_at >= {_cut(d)}" for t, d in _AGES.items())
        + f" UNION ALL SELECT 'messages', (SELECT count(*) FROM v_messages) - (SELECT count(*) {_gone(True)})"
        + f" UNION ALL SELECT 'documents ' || CASE WHEN created_at < {_cut(POLICY.documents)} THEN 'archived' ELSE status END, count(*) FROM v_documents GROUP BY ALL",
        *_VIEWS,
    ),
    "job_claim": with_views(f" SELECT job_id, CAST(greatest(progress, 1) AS INTEGER) AS progress, '{NOW:%Y-%m-%d %H:%M:%S}' AS started FROM v_jobs WHERE status = 'queued' AND job_type = 'ocr' ORDER BY created_at, job_id LIMIT 1", "v_jobs"),
    "job_dedupe": with_views(
        """ SELECT document_id, job_type, 'queued' AS status, CAST(0 AS INTEGER) AS progress FROM (SELECT document_id, unnest(['document', 'ocr', 'embedding']) AS job_type FROM v_documents) r
        WHERE NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.document_id = r.document_id AND j.job_type = r.job_type AND j.status IN ('queued', 'running'))""",
        "v_documents", "v_jobs",
    ),
    "latest_active_job": with_views(" SELECT document_id, job_type, job_id, status FROM v_jobs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY document_id, job_type ORDER BY created_at DESC, job_id) = 1", "v_jobs"),
    "job_outcomes": with_views(
        """ SELECT s AS status, CAST(a AS INTEGER) AS attempts, count(*) AS n, CAST(sum(e) AS BIGINT) AS n_errors, CAST(sum(p) AS BIGINT) AS progress FROM (
          SELECT CASE WHEN status <> 'running' THEN status WHEN job_id % 2 = 1 THEN 'queued' ELSE 'completed' END AS s, CASE WHEN status = 'running' THEN 1 ELSE 0 END AS a,
            CASE WHEN status = 'running' AND job_id % 2 = 1 THEN 1 ELSE 0 END AS e, CASE WHEN status <> 'running' THEN progress WHEN job_id % 2 = 1 THEN 0 ELSE 100 END AS p FROM v_jobs
        ) GROUP BY ALL""",
        "v_jobs",
    ),
    "sessions": with_views(
        f""", owners AS (SELECT session_id, max(user_id) AS owner FROM v_messages GROUP BY session_id)
        SELECT message_id AS request_id, CASE WHEN turn % 2 <> 0 THEN 'created' WHEN m.session_id % 9 = 0 OR owner = m.session_id % 50 THEN 'own' ELSE 'denied' END AS outcome,
          sha256(CASE WHEN {_TITLE} = '' THEN 'Untitled chat' ELSE {_TITLE} END) AS title_sha256
        FROM v_messages m JOIN owners o USING (session_id)""",
        "v_messages",
    ),
    "user_upsert": with_views(
        """, chat AS (SELECT DISTINCT 'u' || user_id AS e FROM v_messages WHERE user_id IS NOT NULL),
        merged AS (SELECT external_user_id AS e, 'sales' AS department FROM v_users WHERE external_user_id NOT IN (SELECT e FROM chat) UNION ALL SELECT e, 'legal' FROM chat)
        SELECT department, count(*) AS n, count(DISTINCT e) AS n_users FROM merged GROUP BY ALL""",
        "v_users", "v_messages",
    ),
    "archived_documents": with_views(f" SELECT replace(status, 'failed', 'archived') AS status, count(*) AS n, CAST(sum(CASE WHEN status = 'failed' AND created_at < TIMESTAMP '{NOW:%Y-%m-%d} 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS n_touched FROM v_documents GROUP BY ALL", "v_documents"),
    "grant_changes": with_views(" SELECT subject_type, CASE subject_type WHEN 'user' THEN 'admin' ELSE permission END AS permission, count(*) AS n FROM v_permissions WHERE subject_type <> 'department' GROUP BY ALL", "v_permissions"),
    "ingested": with_views(
        f""", sized AS (SELECT document_id, confidential_level, regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') AS zh, len({views.sql_words('text')}) AS n FROM v_documents),
        cut AS (SELECT *, (CASE WHEN n < 700 THEN 0 ELSE (n - 700) // 580 + 1 END) AS full_ones FROM sized),
        total AS (SELECT *, full_ones + CASE WHEN n - full_ones * 580 > 0 THEN 1 ELSE 0 END AS own FROM cut)
        SELECT document_id, CASE WHEN zh THEN 'zh' ELSE 'en' END AS language, confidential_level, own + 2 AS n_chunks, CAST(2 AS BIGINT) AS n_image_chunks, CAST(own + 1 AS INTEGER) AS last, CAST(2 AS BIGINT) AS n_linked FROM total""",
        "v_documents",
    ),
    "status_stream": """
        SELECT CASE WHEN doc_id % 11 = 0 THEN 'archived' WHEN doc_id % 20 = 0 THEN 'parsing' WHEN doc_id % 10 = 0 THEN 'uploaded' WHEN doc_id % 5 = 0 THEN 'failed'
          ELSE ['uploaded', 'parsing', 'ocr_processing', 'chunking', 'embedding', 'indexing', 'ready'][doc_id % 7 + 1] END AS status, count(*) AS n FROM documents GROUP BY 1""",
    "image_documents": with_views(
        """ SELECT document_id, CASE WHEN status = 'archived' THEN 'archived' WHEN document_id % 3 = 0 THEN 'ready' ELSE 'failed' END AS status,
          CASE WHEN document_id % 3 = 0 THEN error_message ELSE 'OCR produced no text.' END AS error_message,
          CASE WHEN document_id % 3 = 0 THEN 'en' END AS language, CASE WHEN document_id % 3 = 0 THEN CAST(4 AS BIGINT) END AS n_chunks, CASE WHEN document_id % 3 = 0 THEN CAST(2 AS BIGINT) END AS n_ocr,
          CASE WHEN document_id % 3 = 0 THEN 3 END AS last, CASE WHEN document_id % 3 = 0 THEN CAST(2 AS BIGINT) END AS n_linked FROM v_documents""",
        "v_documents",
    ),
    "ingestion_stream": with_views(
        f""", sized AS (SELECT document_id, len({views.sql_words('text')}) AS n, document_id % 3 = 0 AS scan, document_id % 5 = 0 AS broken FROM v_documents),
        cut AS (SELECT *, CASE WHEN n < 700 THEN 0 ELSE (n - 700) // 580 + 1 END AS full_ones FROM sized),
        total AS (SELECT *, CASE WHEN scan THEN 2 ELSE full_ones + CASE WHEN n - full_ones * 580 > 0 THEN 1 ELSE 0 END END AS own FROM cut)
        SELECT document_id, CASE WHEN broken THEN 'failed' ELSE 'ready' END AS status, CASE WHEN broken THEN 'broken file' END AS error_message, CAST(CASE WHEN broken THEN 0 ELSE own + 2 END AS INTEGER) AS chunk_count,
          CASE WHEN NOT broken THEN own + 2 END AS n_chunks, CAST(CASE WHEN NOT broken THEN own + 1 END AS INTEGER) AS last, CAST(CASE WHEN NOT broken THEN CASE WHEN scan THEN 0 ELSE own END END AS BIGINT) AS n_text,
          CAST(CASE WHEN NOT broken THEN 2 END AS BIGINT) AS n_linked, CAST(CASE WHEN document_id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_uploads FROM total""",
        "v_documents",
    ),
    "admin_gate": """
        SELECT doc_id AS document_id, error IS NULL AND (doc_id % 13 = 0 OR doc_id % 3 = 0) AS allowed, error
        FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'missing bearer token' WHEN doc_id % 7 = 0 THEN 'invalid clearance level' END AS error FROM documents)""",
    "box_centers": """
        SELECT vec_id, CASE WHEN whole THEN round((CAST(e[1] AS DOUBLE) + e[3] + e[5] + e[7]) / 4, 6) ELSE 0 END AS x, CASE WHEN whole THEN round((CAST(e[2] AS DOUBLE) + e[4] + e[6] + e[8]) / 4, 6) ELSE 0 END AS y
        FROM (SELECT vec_id, embedding AS e, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS whole FROM embeddings)""",
    "job_states": with_views(
        """ SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'ocr' ELSE 'embedding' END AS job_type,
          CASE WHEN document_id % 10 IN (5, 7) THEN 'failed' ELSE 'completed' END AS status, CAST(CASE WHEN document_id % 10 IN (3, 5, 7) THEN 2 ELSE 1 END AS INTEGER) AS attempt,
          100 AS progress, CASE document_id % 10 WHEN 5 THEN 'bad file' WHEN 7 THEN 'Job timed out after 300 seconds.' END AS error FROM v_documents""",
        "v_documents",
    ),
    "worker_runs": with_views(
        """, w AS (SELECT *, status IN ('queued', 'running') AS waits, CASE WHEN status = 'running' THEN 1 ELSE 0 END AS before FROM v_jobs),
        x AS (SELECT job_type, waits, before, status AS old, CASE WHEN job_type = 'embedding' THEN 'queued' WHEN job_type = 'document' AND job_id % 2 = 0 AND job_id % 3 <> 0 AND job_id % 4 <> 0 THEN 'completed' ELSE 'failed' END AS ends,
            CASE WHEN job_type = 'ocr' THEN 'RuntimeError: no engine' WHEN job_type = 'document' AND (job_id % 2 = 1 OR job_id % 3 = 0) THEN 'not processed' WHEN job_type = 'document' AND job_id % 4 = 0 THEN 'broken file'
              WHEN job_type = 'embedding' AND before = 1 THEN 'Job timed out after 300 seconds.' ELSE '' END AS said FROM w)
        SELECT job_type, CASE WHEN waits THEN ends ELSE old END AS status, CASE WHEN waits THEN said ELSE '' END AS error, count(*) AS n,
          CAST(sum(CASE WHEN NOT waits THEN 0 WHEN ends = 'failed' THEN 2 WHEN ends = 'completed' THEN before + 1 ELSE before END) AS BIGINT) AS attempts FROM x GROUP BY ALL""",
        "v_jobs",
    ),
    "token_totals": with_views(" SELECT message_id, CAST(sum(CASE WHEN log_id % 5 <> 0 THEN prompt_tokens ELSE 0 END + coalesce(completion_tokens, 0)) AS BIGINT) AS total_tokens FROM v_llm_logs GROUP BY ALL", "v_llm_logs"),
    "dependency_status": with_views(" SELECT 'all' AS of, CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'ok' ELSE 'degraded' END AS status FROM v_documents UNION ALL VALUES ('good', 'ok'), ('none', 'ok')", "v_documents"),
    "user_roles": with_views(
        """ SELECT user_id, concat_ws(',', CASE WHEN user_id % 10 = 0 THEN 'admin' END, CASE WHEN user_id % 2 = 0 THEN 'editor' END, CASE WHEN user_id % 3 = 0 THEN 'reader' END) AS roles,
          user_id % 10 = 0 AS is_admin FROM v_users""",
        "v_users",
    ),
    "recorded_events": with_views(
        f""" SELECT event_type, count(*) AS n, CAST(0 AS BIGINT) AS n_targets, CAST(0 AS BIGINT) AS n_messages, CAST(0 AS BIGINT) AS n_empty, count(*) FILTER (WHERE created_at = TIMESTAMP '{NOW:%Y-%m-%d} 00:00:00') AS n_now FROM v_audit_events GROUP BY ALL
        UNION ALL SELECT 'document_failed', count(*), count(*), count(error_message), count(*), count(*) FROM v_documents WHERE status = 'failed' HAVING count(*) > 0""",
        "v_audit_events", "v_documents",
    ),
    "base_listing": with_views(
        f""", known AS (SELECT b.*, (SELECT count(*) FROM v_documents d WHERE d.knowledge_base_id = b.knowledge_base_id) AS n FROM v_bases b WHERE owner_department = '{PRINCIPAL.department}' OR {open_sql('v_base_permissions', 'knowledge_base_id', 'b')})
        SELECT knowledge_base_id, 'public' AS default_confidential_level, strftime(TIMESTAMP '{views.EPOCH}' + length(knowledge_base_id) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS created, n AS document_count FROM known
        UNION ALL VALUES ('new_a', 'internal', '{NOW:%Y-%m-%d} 00:00:00', 0), ('new_b', 'restricted', '{NOW:%Y-%m-%d} 00:00:00', 0)""",
        "v_documents", "v_bases", "v_base_permissions",
    ),
    "queue_stream": "SELECT DISTINCT event_id % 200 AS document_id, CASE event_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'ocr' ELSE 'embedding' END AS job_type FROM events",
}

ORACLES["doc_listing_page"] = with_views(
    f", page AS (SELECT * FROM v_documents WHERE status = 'ready' ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 40) SELECT d.document_id FROM page d WHERE {readable_sql('d')}",
    "v_documents", "v_permissions", "v_base_permissions",
)
ORACLES["status_tool"] = with_views(
    " SELECT document_id, status, CAST(CASE status "
    + " ".join(f"WHEN '{s}' THEN {p}" for s, (p, _) in gov.STATUSES.items())
    + " END AS INTEGER) AS progress, coalesce(error_message, CASE status "
    + " ".join(f"WHEN '{s}' THEN '{m}'" for s, (_, m) in gov.STATUSES.items())
    + f" END) AS message FROM v_documents d WHERE document_id = 1 AND {readable_sql('d')}",
    "v_documents", "v_permissions", "v_base_permissions",
)
