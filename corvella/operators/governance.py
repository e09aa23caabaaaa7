"""Audit reads, totals, retention, appends and keyed changes. Tables are DataFrames; a change returns a new one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.principal import Principal
from ..functions.text import first_non_empty, session_title
from .security import can_access_bases, can_read_documents, delete_by_key, upsert

# Progress and message of every document status.
STATUSES: dict[str, tuple[int, str]] = {
    "uploaded": (5, "Document has been uploaded."),
    "parsing": (20, "Parser is running."),
    "ocr_processing": (30, "OCR is running."),
    "chunking": (45, "Chunking is running."),
    "embedding": (65, "Embedding is running."),
    "indexing": (85, "Indexing is running."),
    "ready": (100, "Document is searchable."),
    "failed": (100, "Document processing failed."),
    "archived": (100, "Document is archived."),
}
MAX_AUDIT_ROWS, MAX_PAGE_SIZE = 500, 100


def where_given(rows: DataFrame, **wanted: object) -> DataFrame:
    """Equality with every argument that is not None; an empty string is a value."""
    tests = [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def _checked(limit: int, most: int = MAX_AUDIT_ROWS) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def recent(rows: DataFrame, limit: int, *ties: Column | str) -> DataFrame:
    """The newest rows; unset times come first. ``ties`` make the order total."""
    return rows.orderBy(F.col("created_at").desc_nulls_first(), *ties).limit(_checked(limit))


def audit_events(events: DataFrame, users: DataFrame, event_type: str | None = None, user: str | None = None, limit: int = 100) -> DataFrame:
    """Newest audit events. An empty type or user is no filter; a user that is no id is looked up by its external name."""
    found = events.where(F.col("event_type") == event_type) if event_type else events
    if user and user.lstrip("-").isdigit():
        found = found.where(F.col("user_id") == int(user))
    elif user:
        found = found.join(users.where(F.col("external_user_id") == user).select("user_id"), "user_id", "left_semi")
    return recent(found, limit, "event_id")


def chat_logs(messages: DataFrame, users: DataFrame, user: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None, risk_level: str | None = None, limit: int = 100) -> DataFrame:
    """Newest messages of users; both times are included. Messages without a user never match a user filter."""
    found = messages.where("role = 'user'")
    if user:
        same = F.col("external_user_id") == user
        known = users.where(same | (F.col("user_id") == int(user)) if user.lstrip("-").isdigit() else same)
        found = found.join(known.select("user_id"), "user_id", "left_semi")
    if start is not None:
        found = found.where(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        found = found.where(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    if risk_level:
        found = found.where(F.col("risk_level") == risk_level)
    return recent(found, limit, "message_id")


def shown_text() -> Column:
    """What a chat history shows: the final text, else the masked, else the original one."""
    return first_non_empty(F.col("final_content"), F.col("masked_content"), F.col("original_content"))


def llm_logs(logs: DataFrame, message_id: object = None, status: str | None = None, limit: int = 100) -> DataFrame:
    return recent(where_given(logs, message_id=message_id, status=status), limit, "log_id")


def retrieval_logs(logs: DataFrame, message_id: object = None, document_id: object = None, limit: int = 100) -> DataFrame:
    return recent(where_given(logs, message_id=message_id, document_id=document_id), limit, F.col("rank").asc_nulls_last(), "log_id")


def session_messages(messages: DataFrame, session_id: object) -> DataFrame:
    return messages.where(F.col("session_id") == F.lit(session_id)).orderBy(F.col("created_at").asc_nulls_last(), "message_id")


def owned_sessions(sessions: DataFrame, user_id: object, is_admin: bool = False) -> DataFrame:
    """A user's sessions (an admin's: all), last used first."""
    own = sessions if is_admin else sessions.where(F.col("user_id") == F.lit(user_id))
    return own.orderBy(F.col("updated_at").desc_nulls_first(), "session_id")


def status_view(documents: DataFrame) -> DataFrame:
    """document_id, status, progress, message; an error message takes the place of the status's own."""
    pick = lambda i: reduce(lambda c, s: c.when(F.col("status") == s, F.lit(STATUSES[s][i])), list(STATUSES)[1:], F.when(F.col("status") == "uploaded", F.lit(STATUSES["uploaded"][i])))
    return documents.select("document_id", "status", pick(0).alias("progress"), first_non_empty(F.col("error_message"), pick(1)).alias("message"))


def list_page(documents: DataFrame, page: int, page_size: int, **wanted: object) -> DataFrame:
    """One page of documents, newest first. Access is tested afterwards, so a page may hold fewer rows."""
    found = where_given(documents, **wanted).orderBy(F.col("created_at").desc_nulls_first(), "document_id")
    return found.offset((page - 1) * page_size).limit(_checked(page_size, MAX_PAGE_SIZE))


def count_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def totals(**tables: DataFrame) -> DataFrame:
    """(name, n) for every table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def base_document_counts(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Every knowledge base with its number of documents, 0 for empty ones. Documents are counted before they are joined."""
    counts = documents.groupBy("knowledge_base_id").agg(F.count("document_id").alias("_n"))
    return bases.join(counts, "knowledge_base_id", "left").withColumn("document_count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def create_bases(bases: DataFrame, new: DataFrame, now: dt.datetime) -> DataFrame:
    """bases and the new ones, which take the time and, where they name none, the level ``internal``."""
    level = F.coalesce("default_confidential_level", F.lit("internal")) if "default_confidential_level" in new.columns else F.lit("internal")
    rows = new.withColumn("default_confidential_level", level).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    return bases.unionByName(rows, allowMissingColumns=True)


def list_bases(bases: DataFrame, documents: DataFrame, kb_permissions: DataFrame, principal: Principal) -> DataFrame:
    """Knowledge bases the principal may use, newest first, each with its number of documents."""
    seen = can_access_bases(bases, kb_permissions, principal).where("can_access").drop("can_access")
    return base_document_counts(seen, documents).orderBy(F.col("created_at").desc_nulls_first(), "knowledge_base_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("token_count"))


@dataclass(frozen=True)
class RetentionPolicy:
    """Ages in days; rows older than that are archived or deleted."""

    documents: int = 365
    messages: int = 365
    retrieval_logs: int = 180
    masking_events: int = 365
    llm_logs: int = 180
    audit_events: int = 730


_LOGS = ("retrieval_logs", "masking_events", "llm_logs", "audit_events")


def _old(days: int, now: dt.datetime) -> Column:
    """A plain comparison, so that it reaches the scan; unset times are not old."""
    return F.col("created_at") < F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz")


def _young(days: int, now: dt.datetime) -> Column:
    return F.col("created_at").isNull() | (F.col("created_at") >= F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz"))


def _unused_old_messages(messages: DataFrame, logs: Mapping[str, DataFrame], days: int, now: dt.datetime) -> DataFrame:
    """Old messages that no retrieval, masking or model log refers to."""
    old = messages.where(_old(days, now))
    for name in _LOGS[:3]:
        old = old.join(logs[name].select("message_id").where("message_id is not null"), "message_id", "left_anti")
    return old


def retention(tables: Mapping[str, DataFrame], policy: RetentionPolicy, now: dt.datetime, apply: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(counts by table, tables as they are afterwards).

    A preview counts and changes nothing, so messages that only deleted logs refer to are not among its counts;
    applying deletes logs first and counts such messages too.
    """
    after = dict(tables)
    due = tables["documents"].where(_old(policy.documents, now) & (F.col("status") != "archived"))
    counts = {"documents": due}
    for name in _LOGS:
        counts[name] = tables[name].where(_old(getattr(policy, name), now))
        if apply:
            after[name] = tables[name].where(_young(getattr(policy, name), now))
    gone = _unused_old_messages(after["messages"], after, policy.messages, now)
    counts["messages"] = gone
    if apply:
        after["messages"] = delete_by_key(after["messages"], gone, ["message_id"])
        late = _old(policy.documents, now) & (F.col("status") != "archived")
        stamp = F.when(late, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at")) if "updated_at" in tables["documents"].columns else None
        archived = tables["documents"].withColumn("updated_at", stamp) if stamp is not None else tables["documents"]
        after["documents"] = archived.withColumn("status", F.when(late, "archived").otherwise(F.col("status")))
    return totals(**counts), after


def archive(documents: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """Documents with those ids become archived."""
    hit = ids.select(F.col("document_id").alias("_id"), F.lit(True).alias("_hit")).distinct()
    marked = documents.join(hit, F.col("document_id") == F.col("_id"), "left")
    return marked.withColumn("status", F.when(F.col("_hit"), "archived").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))).drop("_id", "_hit")


def ensure_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users by external id: known ones take the new department and clearance, others are added."""
    ids = users.select("external_user_id", F.col("user_id").alias("_known"))
    changes = seen.join(ids, "external_user_id", "left").withColumn("user_id", F.coalesce("_known", F.xxhash64("external_user_id"))).drop("_known")
    return upsert(users, changes, ["external_user_id"])


def ensure_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, session_id, user_id, is_admin, query) with outcome: own, created or denied, and a title."""
    owners = sessions.select("session_id", F.col("user_id").alias("_owner"), F.lit(True).alias("_there"))
    asked = requests.join(owners, "session_id", "left")
    outcome = F.when(F.col("session_id").isNull(), "created").when(F.col("_there") & (F.col("is_admin") | F.col("_owner").eqNullSafe(F.col("user_id"))), "own").otherwise("denied")
    return asked.withColumn("outcome", outcome).withColumn("title", session_title(F.col("query"))).drop("_owner", "_there")


def record_events(events: DataFrame, new: DataFrame, now: dt.datetime) -> DataFrame:
    """Audit events with new ones appended: these take the time, and metadata ``{}`` where they have none."""
    given = F.coalesce("metadata", F.lit("{}")) if "metadata" in new.columns else F.lit("{}")
    rows = new.withColumn("metadata", given).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    return events.unionByName(rows, allowMissingColumns=True)


def llm_log_rows(calls: DataFrame) -> DataFrame:
    """Model calls with their total of tokens; unknown counts are 0."""
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return calls.withColumn("total_tokens", total.cast("long"))


def overall_status(dependencies: DataFrame) -> DataFrame:
    """ok if every dependency is, else degraded."""
    return dependencies.agg(F.when(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)), "ok").otherwise("degraded").alias("status"))


def document_status_for(documents: DataFrame, document_permissions: DataFrame, kb_permissions: DataFrame, document_id: object, principal: Principal) -> DataFrame:
    """The status tool: one row of the document's status if it is there and may be read, else none."""
    one = documents.where(F.col("document_id") == F.lit(document_id))
    return status_view(can_read_documents(one, document_permissions, kb_permissions, principal).where("can_read"))


def grants_of(permissions: DataFrame, key: str, value: object) -> DataFrame:
    """An object's grants, in order of subject."""
    return permissions.where(F.col(key) == F.lit(value)).orderBy("subject_type", "subject_value")


def set_grants(permissions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Grants after changes: one permission for each object and subject, the changed one where there are both."""
    return upsert(permissions, changes, [key, "subject_type", "subject_value"])
