"""From parsed pages to stored, searchable chunks, one document after another in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_db_text, detect_language, structured_text
from .chunking import OVERLAP, SIZE, chunk_image_ocr, chunk_images, chunk_pages, link_images
from .security import delete_by_key

METADATA = ("title", "original_filename", "page_start", "page_end", "source_type", "image_ids")


def page_rows(parsed: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page_number, text) with tables and fields appended, of rows (key, pages)."""
    one = parsed.select(key, F.explode("pages").alias("p"))
    return one.select(key, F.col("p.page_number").alias("page_number"), structured_text(F.col("p.text")).alias("text"))


def document_text(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, text, ocr_required): non-blank pages in order, a blank line between them; OCR is due if all are blank."""
    filled = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "(?U)[\\s\\x1c-\\x1f]+", "")) > 0
    texts = F.transform(F.array_sort(F.collect_list(F.when(filled, F.struct("page_number", "text")))), lambda s: s["text"])
    return pages.groupBy(key).agg(F.array_join(texts, "\n\n").alias("text"), (~F.coalesce(F.bool_or(filled), F.lit(False))).alias("ocr_required"))


def chunk_rows(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: cleaned, numbered, with what they inherit from their document.

    The token count is the one from before cleaning.
    """
    have = set(chunks.columns)
    value = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    own = chunks.select("document_id", "chunk_index", "content", "token_count", value("page_start", "int").alias("page_start"), value("page_end", "int").alias("page_end"), "source_type", value("image_ids", "array<string>").alias("image_ids"))
    inherited = documents.select("document_id", "knowledge_base_id", "language", "confidential_level", "original_filename")
    return own.join(inherited, "document_id").select(
        F.xxhash64("document_id", "chunk_index").alias("chunk_id"), "document_id", "knowledge_base_id", "chunk_index",
        F.coalesce(clean_db_text(F.col("content")), F.lit("")).alias("content"), "token_count", "language", "confidential_level",
        F.struct(F.lit(None).cast("string").alias("title"), "original_filename", "page_start", "page_end", "source_type", "image_ids").alias("metadata"),
    )


def _after(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """Both, numbered through within a document. One shuffle; what parsed and chunked the documents runs once."""
    both = chunks.withColumn("_part", F.lit(0)).unionByName(more.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("document_id").orderBy("_part", "chunk_index")
    return both.withColumn("chunk_index", F.row_number().over(order) - 1).drop("_part")


def ingest_pages(documents: DataFrame, pages: DataFrame, images: DataFrame | None = None, source_type: str = "pdf_text", size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame | None]:
    """(chunk rows, images linked to chunks) of documents with page texts, and of their images if any."""
    text = document_text(pages)
    known = documents.drop("language").join(text.select("document_id", detect_language(F.col("text")).alias("language")), "document_id")
    cut = chunk_pages(pages, "document_id", size, overlap, source_type)
    if images is None:
        return chunk_rows(known, cut), None
    stored = chunk_rows(known, _after(cut, chunk_images(images)))
    flat = stored.select("chunk_id", "chunk_index", "metadata.image_ids")
    return stored, link_images(flat, images.drop("chunk_id"))


def ingest_images(documents: DataFrame, images: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk rows, linked images, failed documents) of documents that are images with OCR text.

    Without OCR text a document fails.
    """
    filled = F.length(F.regexp_replace(F.coalesce("ocr_text", F.lit("")), "(?U)[\\s\\x1c-\\x1f]+", "")) > 0
    good = images.where(filled)
    known = documents.drop("language").join(good.groupBy("document_id").agg(detect_language(F.array_join(F.collect_list("ocr_text"), "\n")).alias("language")), "document_id")
    stored = chunk_rows(known, _after(chunk_image_ocr(good, size=size, overlap=overlap), chunk_images(good)))
    failed = documents.join(good.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("OCR produced no text.").alias("error_message"))
    return stored, link_images(stored.select("chunk_id", "chunk_index", "metadata.image_ids"), good.drop("chunk_id")), failed


def finish_documents(documents: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """documents with their outcome: ready with a chunk count, or failed with a message; archived ones stay as they are."""
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("_n"))
    marked = documents.join(counts, "document_id", "left").join(errors.select("document_id", F.col("error_message").alias("_error")).dropDuplicates(["document_id"]), "document_id", "left")
    status = F.when(F.col("status") == "archived", "archived").when(F.col("_error").isNotNull(), "failed").when(F.col("_n") > 0, "ready").otherwise(F.col("status"))
    return marked.withColumn("status", status).withColumn("error_message", F.coalesce("_error", "error_message")).withColumn("chunk_count", F.coalesce("_n", F.lit(0))).drop("_n", "_error")


def reset(documents: DataFrame, chunks: DataFrame, images: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, images) made ready to process ``again``: their chunks and images go, counters start at 0."""
    hit = again.select("document_id").distinct().withColumn("_hit", F.lit(True))
    marked = documents.join(hit, "document_id", "left")
    zero = lambda c: F.when(F.col("_hit"), F.lit(0)).otherwise(F.col(c))
    changed = marked.withColumn("chunk_count", zero("chunk_count")).withColumn("page_count", zero("page_count")).withColumn("error_message", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("error_message"))).drop("_hit")
    return changed, delete_by_key(chunks, again, ["document_id"]), delete_by_key(images, again, ["document_id"])


def reindex_error(status: Column, stored: Column) -> Column:
    """Why a document can't be processed again; null if it can."""
    return F.when(status == "archived", "Archived documents cannot be reindexed.").when(~F.coalesce(stored, F.lit(False)), "Document file is missing.")
