"""Ingestion as one stream into four tables, every upload taking effect once.

A micro-batch of uploads becomes rows of documents, chunks, images and events, each under its table's batch=N. Its number
goes into a ledger last, and readers take only batches that are in it: what a killed run left behind is not seen, and is
overwritten when the stream's checkpoint gives the same batch out again. A batch that is in the ledger is not done twice.
The checkpoint lies in the same folder as the tables, so batch numbers never start anew above rows that are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import words
from ..operators.chunking import OVERLAP, SIZE, link_images
from ..operators.ingestion import ingest_images, ingest_pages
from ..sources.files import IMAGE_TYPES

SINKS = ("documents", "chunks", "images", "events")
LEDGER = "batch long, sink string, n_rows long"
_IMAGE = "image_id:bigint,page_number:int,image_index:int,image_path:string,caption:string,ocr_text:string"
#: One parsed file. ``at`` orders the uploads of a document; ``error`` says why a file could not be read.
UPLOAD = f"document_id bigint, knowledge_base_id string, confidential_level string, original_filename string, file_type string, pages array<struct<page_number:int,text:string>>, images array<struct<{_IMAGE}>>, error string, at timestamp"

NO_TEXT = "Document did not contain extractable text."
#: What chunks of pages are called until their document's type is known.
_PAGE = "page"


def _last_uploads(uploads: DataFrame) -> DataFrame:
    """Of every document the upload with the latest time; equal times are settled by a hash of the whole row."""
    order = Window.partitionBy("document_id").orderBy(F.col("at").desc_nulls_last(), F.xxhash64(*uploads.columns))
    return uploads.where("document_id is not null").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def _some(text: Column) -> Column:
    return F.coalesce(F.size(words(text)) > 0, F.lit(False))


def _is_image() -> Column:
    return F.coalesce(F.col("file_type").isin(*IMAGE_TYPES), F.lit(False))


def _images_of(uploads: DataFrame) -> DataFrame:
    return uploads.select("document_id", F.inline("images"))


def _chunked(good: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunk rows of uploads that can be read."""
    documents = good.select("document_id", "knowledge_base_id", F.lit(None).cast("string").alias("language"), "confidential_level", "original_filename", "file_type")
    files, pictures = good.where(~_is_image()), good.where(_is_image())
    # A file of images alone has one blank page, so that it is known as a document.
    pages = files.select("document_id", F.explode_outer("pages").alias("p")).select("document_id", F.coalesce("p.page_number", F.lit(1)).alias("page_number"), F.coalesce("p.text", F.lit("")).alias("text"))
    of_pages, _ = ingest_pages(documents.where(~_is_image()), pages, _images_of(files), _PAGE, size, overlap)
    of_pictures, _, _ = ingest_images(documents.where(_is_image()), _images_of(pictures), size, overlap)
    both = of_pages.unionByName(of_pictures).join(good.select("document_id", "file_type"), "document_id")
    kind = F.when(F.col("metadata.source_type") == _PAGE, F.concat(F.coalesce("file_type", F.lit("pdf")), F.lit("_text"))).otherwise(F.col("metadata.source_type"))
    return both.withColumn("metadata", F.col("metadata").withField("source_type", kind)).drop("file_type")


def outcome(uploads: DataFrame) -> DataFrame:
    """uploads with ``error``: the file's own, or that it has no text: no word on its pages and no image, or no text in the image it is."""
    written = F.exists(F.coalesce("pages", F.array().cast("array<struct<page_number:int,text:string>>")), lambda p: _some(p["text"]))
    pictures = F.coalesce("images", F.array().cast(f"array<struct<{_IMAGE}>>"))
    read = F.exists(pictures, lambda i: _some(i["ocr_text"]))
    empty = F.when(_is_image(), F.when(~read, "OCR produced no text.")).when(~written & (F.size(pictures) == 0), NO_TEXT)
    return uploads.withColumn("error", F.coalesce("error", empty))


def write_tables(uploads: DataFrame, keep: Callable[[str, DataFrame], DataFrame], size: int = SIZE, overlap: int = OVERLAP) -> None:
    """Give the rows of the four tables that one batch of uploads makes to ``keep``, which returns them as they were written.

    Texts are chunked once: links and counts are made from the chunks that were written.

    Of repeated uploads of a document the latest counts; every upload leaves an event, one without a document id that it
    was rejected. A failed file is a document with a message and without chunks. An empty batch makes empty tables.
    """
    last = outcome(_last_uploads(uploads))
    good = last.where("error is null")
    chunks = keep("chunks", _chunked(good, size, overlap))
    links = chunks.select("chunk_id", "chunk_index", "metadata.image_ids")
    pictures = good.select("document_id", _is_image().alias("_only"), F.inline("images")).where(~F.col("_only") | _some(F.col("ocr_text"))).drop("_only")
    keep("images", link_images(links, pictures))
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"), F.first("language").alias("language"))
    keep("documents", last.join(counts, "document_id", "left").select(
        "document_id", "knowledge_base_id", "original_filename", "file_type", "confidential_level", F.coalesce("language", F.lit("en")).alias("language"),
        F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), F.col("error").alias("error_message"),
        F.coalesce(F.size("pages"), F.lit(0)).alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.col("at").alias("updated_at"),
    ))
    event = lambda kind, message: (F.col("document_id").cast("string").alias("target_id"), kind.alias("event_type"), message.cast("string").alias("message"), F.col("at").alias("created_at"))
    asked = uploads.select(*event(F.when(F.col("document_id").isNull(), "upload_rejected").otherwise("document_uploaded"), F.lit(None)))
    ended = last.select(*event(F.when(F.col("error").isNull(), "document_ready").otherwise("document_failed"), F.col("error")))
    keep("events", asked.unionByName(ended))


def _write_sink(rows: DataFrame, root: str, sink: str, number: int) -> DataFrame:
    where = f"{root}/{sink}/batch={number}"
    rows.write.mode("overwrite").parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(batch, sink, n_rows) of the batches that are done."""
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def ingest_batch(uploads: DataFrame, number: int, root: str, size: int = SIZE, overlap: int = OVERLAP) -> None:
    """Write a batch of uploads; nothing happens if the ledger has its number."""
    spark = uploads.sparkSession
    if not ledger(spark, root).where(F.col("batch") == number).isEmpty():
        return
    kept = uploads.persist(StorageLevel.DISK_ONLY)
    try:
        write_tables(kept, lambda sink, rows: _write_sink(rows, root, sink, number), size, overlap)
        counts = None
        for sink in SINKS:
            n = spark.read.parquet(f"{root}/{sink}/batch={number}").agg(F.count("*").alias("n_rows")).select(F.lit(number).cast("long").alias("batch"), F.lit(sink).alias("sink"), "n_rows")
            counts = n if counts is None else counts.unionByName(n)
        # One file, which its commit makes visible in one step.
        counts.coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    finally:
        kept.unpersist()


def run_ingestion(uploads: DataFrame, root: str, size: int = SIZE, overlap: int = OVERLAP, available_now: bool = True, poll: str = "2 seconds") -> StreamingQuery:
    """Start the stream of ``uploads`` (see UPLOAD) into the tables under ``root``; start it again to go on where it ended."""
    spark = uploads.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{root}/ledger")
    writer = uploads.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, root, size, overlap)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=poll)).start()


def committed(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """The rows of a table, ``batch`` among its columns, of batches in the ledger."""
    done = ledger(spark, root).select("batch").distinct()
    return spark.read.option("basePath", f"{root}/{sink}").parquet(f"{root}/{sink}").withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")


def current(spark: SparkSession, root: str, sink: str) -> DataFrame:
    """Documents, or their chunks or images, by each document's latest upload; all events.

    The same rows come out however the uploads were split into batches, but for uploads of one document at one time.
    """
    rows = committed(spark, root, sink)
    if sink == "events":
        return rows.drop("batch")
    known = committed(spark, root, "documents").select("document_id", "batch", "updated_at")
    last = known.groupBy("document_id").agg(F.max_by("batch", F.struct("updated_at", "batch")).alias("batch"))
    return rows.join(last, ["document_id", "batch"], "left_semi").drop("batch")
