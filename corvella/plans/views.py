"""Reference-shaped tables over the driver's Parquet tables, for Spark and, as SQL, for DuckDB.

Levels, departments, statuses and times follow from ids by arithmetic both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.principal import Principal
from ..operators.chunking import OVERLAP, SIZE, chunk_text

DEPARTMENTS = ("finance", "engineering", "legal", "sales", "research")
LEVEL_NAMES = ("public", "internal", "confidential", "restricted")
PRINCIPAL = Principal("u7", "engineering", frozenset(("reader", "auditor")), "confidential")
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def hours(c: Column) -> Column:
    """A time so many hours after EPOCH."""
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=c.cast("int"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("document_id"),
        F.col("source").alias("knowledge_base_id"),
        F.col("lang").alias("language"),
        "text",
        _pick(d % 4, LEVEL_NAMES).alias("confidential_level"),
        F.when(d % 3 != 0, _pick(d % 5, DEPARTMENTS)).alias("department"),
        F.when(d % 10 == 7, "archived").when(d % 10 == 8, "failed").when(d % 10 == 9, "parsing").otherwise("ready").alias("status"),
        F.when(d % 20 == 8, F.concat(F.lit("broken file "), d)).alias("error_message"),
        hours(d).alias("created_at"),
    )


def chunks(spark: SparkSession, sf: str, size: int = SIZE, overlap: int = OVERLAP, embedded: bool = True) -> DataFrame:
    """Chunks with the vector of their document's turn; every 50th document has none. Without vectors the texts join nothing."""
    d = F.col("document_id")
    cut = chunk_text(documents(spark, sf), "document_id", "text", size, overlap, ("knowledge_base_id", "confidential_level"))
    joined = cut
    if embedded:
        vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("_vector"))
        n = vectors.agg(F.count("*")).first()[0]
        joined = cut.join(vectors, F.pmod(d, F.lit(n)) == F.col("vec_id"), "left")
    return joined.select(
        (d * 100_000 + F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "knowledge_base_id",
        "chunk_index",
        "content",
        "token_count",
        *([F.when(d % 50 != 49, F.col("_vector")).alias("embedding")] if embedded else []),
        "confidential_level",
        F.struct(
            F.when(d % 2 == 0, F.concat(F.lit("Document "), d)).alias("title"),
            (F.col("chunk_index") + 1).alias("page_start"),
            (F.col("chunk_index") + 1 + F.pmod(d, F.lit(2))).cast("int").alias("page_end"),
            F.when(d % 7 == 3, "pdf_image").otherwise("pdf_text").alias("source_type"),
            F.when(d % 7 == 3, F.array((d * 10).cast("string"))).alias("image_ids"),
        ).alias("metadata"),
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Two images of every document, on its pages 1 and 2."""
    d = F.col("doc_id")
    both = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    return both.select(
        (d * 10 + F.col("i")).alias("image_id"),
        d.alias("document_id"),
        (F.col("i") + 1).alias("page_number"),
        F.lit(1).alias("image_index"),
        F.concat(F.lit("page-000"), F.col("i") + 1, F.lit("-image-001.png")).alias("image_path"),
        F.when(d % 2 == 0, F.concat(F.lit("Figure "), d)).alias("caption"),
        F.when(d % 3 == 0, F.concat(F.lit("text of "), d)).alias("ocr_text"),
    )


def document_permissions(spark: SparkSession, sf: str) -> DataFrame:
    """One grant for every labelled document."""
    d = F.col("doc_id")
    value = F.when(d % 3 == 0, F.concat(F.lit("u"), d % 10)).when(d % 3 == 1, _pick(d % 5, DEPARTMENTS)).otherwise(F.when(F.col("quality") == 1, "reader").otherwise("editor"))
    level = F.when(F.col("toxic") == 1, "write").when(d % 4 == 0, "admin").otherwise("read")
    return table(spark, sf, "labels").select(d.alias("document_id"), _pick(d % 3, ("user", "department", "role")).alias("subject_type"), value.alias("subject_value"), level.alias("permission"))


def knowledge_bases(spark: SparkSession, sf: str) -> DataFrame:
    """The sources, and two empty ones."""
    own = table(spark, sf, "documents").select(F.col("source").alias("knowledge_base_id")).distinct()
    empty = spark.createDataFrame([("empty_a",), ("empty_b",)], "knowledge_base_id string")
    return own.unionByName(empty).withColumn("owner_department", _pick(F.length("knowledge_base_id") % 5, DEPARTMENTS))


def base_permissions(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose name ends in 1 or 2 have a grant; those in 1 to the auditors."""
    last = F.substring("knowledge_base_id", -1, 1)
    named = knowledge_bases(spark, sf).where(last.isin("1", "2"))
    return named.select("knowledge_base_id", F.lit("role").alias("subject_type"), F.when(last == "1", "auditor").otherwise("editor").alias("subject_value"), F.lit("read").alias("permission"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id").distinct().withColumn("external_user_id", F.concat(F.lit("u"), "user_id"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("conv_id") * 1_000 + F.col("turn")
    return table(spark, sf, "conversations").select(
        key.alias("message_id"),
        F.col("conv_id").alias("session_id"),
        "turn",
        F.when(F.col("conv_id") % 4 != 3, F.col("conv_id") % 100).alias("user_id"),
        "role",
        F.col("text").alias("original_content"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("masked "), key)).alias("masked_content"),
        F.when(key % 5 == 0, F.concat(F.lit("final "), key)).when(key % 5 == 1, "").alias("final_content"),
        _pick(key % 3, ("low", "medium", "high")).alias("risk_level"),
        hours(key % 9_000).alias("created_at"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumnRenamed("ts", "created_at")


def llm_logs(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf).where("event_type in ('click', 'error')").select(
        e.alias("log_id"), (e % 500 * 1_000).alias("message_id"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        (e % 900).cast("int").alias("prompt_tokens"), F.when(e % 7 != 0, e % 300).cast("int").alias("completion_tokens"), "created_at",
    )


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", F.when(F.col("event_type") == "error", "permission_denied").otherwise(F.col("event_type")).alias("event_type"), "created_at")


def retrieval_logs(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf).where("event_type = 'view'").select(e.alias("log_id"), (e % 400 * 1_000 + 1).alias("message_id"), (e % 200).alias("document_id"), (e % 8 + 1).cast("int").alias("rank"), "created_at")


def masking_events(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf).where("event_type = 'purchase'").select(e.alias("log_id"), (e % 300 * 1_000 + 2).alias("message_id"), "created_at")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf).select(
        e.alias("job_id"),
        (e % 200).alias("document_id"),
        _pick(e % 3, ("document", "ocr", "embedding")).alias("job_type"),
        F.when(e % 11 == 0, "queued").when(e % 11 == 1, "running").when(e % 11 == 2, "failed").otherwise("completed").alias("status"),
        (e % 100).cast("int").alias("progress"),
        "created_at",
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0).alias("attempts"),
    )


QUERY = "da"
QUERY_VECTOR = tuple(round(((i * 37) % 64 - 31.5) / 64, 8) for i in range(64))

# ---- the same views as DuckDB SQL ------------------------------------------------------------------------------

_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda w: w <> '')"


def _sql_pick(index: str, values: tuple[str, ...]) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


def _hours(h: str) -> str:
    return f"(TIMESTAMP '{EPOCH}' + CAST({h} AS INTEGER) * INTERVAL 1 HOUR)"


SQL: dict[str, str] = {
    "v_documents": f"""
        SELECT doc_id AS document_id, source AS knowledge_base_id, lang AS language, text,
          {_sql_pick("doc_id % 4", LEVEL_NAMES)} AS confidential_level,
          CASE WHEN doc_id % 3 <> 0 THEN {_sql_pick("doc_id % 5", DEPARTMENTS)} END AS department,
          CASE doc_id % 10 WHEN 7 THEN 'archived' WHEN 8 THEN 'failed' WHEN 9 THEN 'parsing' ELSE 'ready' END AS status,
          CASE WHEN doc_id % 20 = 8 THEN 'broken file ' || doc_id END AS error_message,
          {_hours("doc_id")} AS created_at
        FROM documents""",
    "v_cut": f"""
        SELECT document_id, knowledge_base_id, confidential_level, chunk_index,
          array_to_string(words[chunk_index * {SIZE - OVERLAP} + 1 : chunk_index * {SIZE - OVERLAP} + {SIZE}], ' ') AS content,
          len(words[chunk_index * {SIZE - OVERLAP} + 1 : chunk_index * {SIZE - OVERLAP} + {SIZE}]) AS token_count
        FROM (
          SELECT *, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= {SIZE} THEN 1 ELSE 1 + CAST(ceil((n - {SIZE}) / {SIZE - OVERLAP}.0) AS BIGINT) END)) AS chunk_index
          FROM (SELECT *, len(words) AS n FROM (SELECT document_id, knowledge_base_id, confidential_level, {sql_words("text")} AS words FROM v_documents))
        )""",
    "v_chunks": """
        SELECT c.document_id * 100000 + c.chunk_index AS chunk_id, c.*,
          CASE WHEN c.document_id % 50 <> 49 THEN e.embedding END AS embedding,
          CASE WHEN c.document_id % 2 = 0 THEN 'Document ' || c.document_id END AS title,
          c.chunk_index + 1 AS page_start, c.chunk_index + 1 + c.document_id % 2 AS page_end,
          CASE WHEN c.document_id % 7 = 3 THEN 'pdf_image' ELSE 'pdf_text' END AS source_type,
          CASE WHEN c.document_id % 7 = 3 THEN c.document_id * 10 END AS image_id
        FROM v_cut c LEFT JOIN embeddings e ON e.vec_id = c.document_id % (SELECT count(*) FROM embeddings)""",
    "v_images": """
        SELECT doc_id * 10 + i AS image_id, doc_id AS document_id, i + 1 AS page_number, 1 AS image_index,
          'page-000' || (i + 1) || '-image-001.png' AS image_path,
          CASE WHEN doc_id % 2 = 0 THEN 'Figure ' || doc_id END AS caption,
          CASE WHEN doc_id % 3 = 0 THEN 'text of ' || doc_id END AS ocr_text
        FROM documents, (VALUES (0), (1)) AS t(i)""",
    "v_permissions": f"""
        SELECT doc_id AS document_id, {_sql_pick("doc_id % 3", ("user", "department", "role"))} AS subject_type,
          CASE doc_id % 3 WHEN 0 THEN 'u' || (doc_id % 10) WHEN 1 THEN {_sql_pick("doc_id % 5", DEPARTMENTS)}
            ELSE CASE WHEN quality = 1 THEN 'reader' ELSE 'editor' END END AS subject_value,
          CASE WHEN toxic = 1 THEN 'write' WHEN doc_id % 4 = 0 THEN 'admin' ELSE 'read' END AS permission
        FROM labels""",
    "v_bases": f"""
        SELECT knowledge_base_id, {_sql_pick("length(knowledge_base_id) % 5", DEPARTMENTS)} AS owner_department
        FROM (SELECT DISTINCT source AS knowledge_base_id FROM documents UNION ALL VALUES ('empty_a'), ('empty_b'))""",
    "v_base_permissions": """
        SELECT knowledge_base_id, 'role' AS subject_type, CASE WHEN right(knowledge_base_id, 1) = '1' THEN 'auditor' ELSE 'editor' END AS subject_value, 'read' AS permission
        FROM v_bases WHERE right(knowledge_base_id, 1) IN ('1', '2')""",
    "v_users": "SELECT DISTINCT user_id, 'u' || user_id AS external_user_id FROM events",
    "v_messages": f"""
        SELECT k AS message_id, conv_id AS session_id, turn, CASE WHEN conv_id % 4 <> 3 THEN conv_id % 100 END AS user_id, role, text AS original_content,
          CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'masked ' || k END AS masked_content,
          CASE k % 5 WHEN 0 THEN 'final ' || k WHEN 1 THEN '' END AS final_content,
          {_sql_pick("k % 3", ("low", "medium", "high"))} AS risk_level, {_hours("k % 9000")} AS created_at
        FROM (SELECT *, conv_id * 1000 + turn AS k FROM conversations)""",
    "v_events": "SELECT * EXCLUDE (ts), ts AS created_at FROM events",
    "v_llm_logs": """
        SELECT event_id AS log_id, event_id % 500 * 1000 AS message_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status,
          event_id % 900 AS prompt_tokens, CASE WHEN event_id % 7 <> 0 THEN event_id % 300 END AS completion_tokens, created_at
        FROM v_events WHERE event_type IN ('click', 'error')""",
    "v_audit_events": "SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'permission_denied' ELSE event_type END AS event_type, created_at FROM v_events",
    "v_retrieval_logs": "SELECT event_id AS log_id, event_id % 400 * 1000 + 1 AS message_id, event_id % 200 AS document_id, event_id % 8 + 1 AS rank, created_at FROM v_events WHERE event_type = 'view'",
    "v_masking_events": "SELECT event_id AS log_id, event_id % 300 * 1000 + 2 AS message_id, created_at FROM v_events WHERE event_type = 'purchase'",
    "v_jobs": f"""
        SELECT event_id AS job_id, event_id % 200 AS document_id, {_sql_pick("event_id % 3", ("document", "ocr", "embedding"))} AS job_type,
          CASE event_id % 11 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
          event_id % 100 AS progress, created_at
        FROM v_events""",
}
_NEEDS = {"v_cut": ("v_documents",), "v_chunks": ("v_documents", "v_cut"), "v_base_permissions": ("v_bases",), **{v: ("v_events",) for v in ("v_llm_logs", "v_audit_events", "v_retrieval_logs", "v_masking_events", "v_jobs")}}


def with_views(query: str, *names: str) -> str:
    """The query with the views it names before it."""
    wanted: list[str] = []
    for name in names:
        for v in (*_NEEDS.get(name, ()), name):
            if v not in wanted:
                wanted.append(v)
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in wanted) + query
