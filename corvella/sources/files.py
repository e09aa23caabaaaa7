"""Files in, tables in and out. Any path is a Hadoop file-system URI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_non_empty

# The suffixes that are accepted, and the kind of document each names.
SUPPORTED = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp", "docx", "xlsx", "pptx")
IMAGE_TYPES, OFFICE_TYPES = ("png", "jpg", "jpeg", "tiff", "bmp"), ("docx", "xlsx", "pptx")
#: Embedded pictures and documents are read whole by one task each.
MAX_FILE_BYTES = 512 << 20


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def suffix_of(name: Column) -> Column:
    """The last suffix in lower case, empty without one; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(base_name(name), "^.+\\.([^.]+)$", 1))


def is_supported(name: Column) -> Column:
    return suffix_of(name).isin(*SUPPORTED)


def shown_name(original: Column, name: Column) -> Column:
    return first_non_empty(original, name)


def scan_folder(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """The supported files of a folder, without its subfolders: path, name, file_type, length, modified, content.

    Files beyond MAX_FILE_BYTES keep a null content and an error. Sort by path where the order matters.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.*").load(folder)
    name = base_name(F.col("path"))
    big = F.col("length") > MAX_FILE_BYTES
    columns = [F.col("path"), name.alias("name"), suffix_of(name).alias("file_type"), F.col("length"), F.col("modificationTime").alias("modified")]
    if content:
        columns += [F.when(~big, F.col("content")).alias("content"), F.when(big, F.lit("file too large")).alias("error")]
    return found.where(is_supported(name)).select(*columns)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def point_get(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key; the filter is pushed into the scan."""
    return rows.where(F.col(key) == F.lit(value))


def append_table(rows: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows. Partition columns with few values (knowledge bases) let searches skip the rest."""
    spread = rows.repartition(*[F.col(c) for c in partition_by], F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(16))) if partition_by else rows
    writer = spread.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}")


def replace_snapshot(rows: DataFrame, root: str, name: str, version: int) -> str:
    """Write a changed table as a new version beside the old one, which readers of it keep."""
    path = f"{root}/{name}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def missing_tables(spark: SparkSession, wanted: tuple[str, ...]) -> list[str]:
    return [t for t in wanted if not spark.catalog.tableExists(t)]


TABLES: dict[str, str] = {
    "users": "user_id bigint, external_user_id string, department string, clearance_level string, is_active boolean",
    "roles": "role_id bigint, name string, description string",
    "user_roles": "user_id bigint, role_id bigint",
    "knowledge_bases": "knowledge_base_id string, name string, owner_department string, default_confidential_level string, created_at timestamp_ntz",
    "documents": "document_id bigint, knowledge_base_id string, filename string, original_filename string, title string, language string, file_type string, source_type string, confidential_level string, department string, status string, error_message string, page_count int, chunk_count int, ocr_required boolean, ocr_confidence double, version int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "document_chunks": "chunk_id bigint, document_id bigint, knowledge_base_id string, chunk_index int, content string, token_count int, language string, confidential_level string, metadata struct<title:string,original_filename:string,page_start:int,page_end:int,source_type:string,image_ids:array<string>>, embedding array<float>",
    "document_images": "image_id bigint, document_id bigint, chunk_id bigint, page_number int, image_index int, image_path string, caption string, ocr_text string, width int, height int, mime_type string",
    "document_permissions": "document_id bigint, subject_type string, subject_value string, permission string",
    "knowledge_base_permissions": "knowledge_base_id string, subject_type string, subject_value string, permission string",
    "chat_sessions": "session_id bigint, user_id bigint, title string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chat_messages": "message_id bigint, session_id bigint, user_id bigint, role string, original_content string, masked_content string, final_content string, risk_level string, created_at timestamp_ntz",
    "retrieval_logs": "log_id bigint, message_id bigint, document_id bigint, chunk_id bigint, vector_score double, keyword_score double, rerank_score double, final_score double, rank int, used_in_context boolean, created_at timestamp_ntz",
    "masking_events": "event_id bigint, message_id bigint, entity_type string, original_value string, masked_value string, masking_method string, confidence double, location string, created_at timestamp_ntz",
    "llm_call_logs": "log_id bigint, message_id bigint, model string, prompt_tokens int, completion_tokens int, total_tokens bigint, latency_ms int, status string, error_message string, created_at timestamp_ntz",
    "document_processing_jobs": "job_id bigint, document_id bigint, job_type string, status string, progress int, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string, attempts int",
    "sensitive_dictionaries": "entity_type string, value string, replacement string, risk_level string, is_active boolean, created_at timestamp_ntz",
    "prompt_templates": "name string, version int, template string, is_active boolean",
    "audit_events": "event_id bigint, user_id bigint, event_type string, target_type string, target_id string, metadata string, created_at timestamp_ntz",
}


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    """All tables of the data model, as Parquet, where they don't exist yet."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database + '.' if database else ''}{name} ({columns}) USING parquet")
