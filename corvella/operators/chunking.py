"""Chunking with overlap. Chunk bounds follow from word counts in closed form; no loop carries state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens, first_non_empty, words

SIZE, OVERLAP = 700, 120


def text_chunk_array(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of one text: a last chunk never consists of overlap alone; no words, no chunk."""
    stride = max(size - overlap, 1)

    def cut(found: Column) -> Column:
        n = F.size(found)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int"))
        at = lambda i: F.array_join(F.slice(found, i * stride + 1, F.lit(size)), " ")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<string>"))

    # As an element of an array the words are bound to a name: the text is split once, not once a chunk.
    return F.get(F.transform(F.array(words(text)), cut), F.lit(0))


def chunk_text(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, chunk_index, content, token_count); what is kept of a document goes along with its chunks."""
    return docs.select(key, *keep, F.posexplode(text_chunk_array(F.col(text), size, overlap)).alias("chunk_index", "content")).withColumn("token_count", count_tokens(F.col("content")))


def chunk_pages(pages: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP, source_type: str = "pdf_text") -> DataFrame:
    """(key, chunk_index, content, token_count, page_start, page_end, source_type) of rows (key, page_number, text).

    The words of a document run on from page to page. Full chunks come at every stride; what is left after them makes
    the tail, even if it is overlap alone.
    """
    if overlap >= size:
        raise ValueError("overlap must be below the chunk size")
    stride = size - overlap
    per_page = F.struct("page_number", words(F.coalesce("text", F.lit(""))).alias("words"))
    whole = pages.groupBy(key).agg(F.array_sort(F.collect_list(per_page)).alias("pages"))
    flat = whole.select(
        key,
        F.flatten("pages.words").alias("words"),
        F.flatten(F.transform("pages", lambda p: F.array_repeat(p["page_number"], F.size(p["words"])))).alias("numbers"),
    )
    n = F.size("words")
    full = F.when(n < size, 0).otherwise(F.floor((n - size) / F.lit(stride)).cast("int") + 1)
    tail = (n - full * stride) > 0
    index = F.when((full > 0) | tail, F.sequence(F.lit(0), full - F.when(tail, 0).otherwise(1)))

    def chunk(i: Column) -> Column:
        part, numbers = (F.slice(c, i * stride + 1, F.lit(size)) for c in ("words", "numbers"))
        return F.struct(i.alias("chunk_index"), F.array_join(part, " ").alias("content"), F.size(part).alias("token_count"), F.array_min(numbers).alias("page_start"), F.array_max(numbers).alias("page_end"))

    return flat.select(key, F.inline(F.transform(index, chunk))).withColumn("source_type", F.lit(source_type))


def image_chunk_content(page: Column, path: Column, caption: Column, ocr_text: Column) -> Column:
    some = lambda label, c: F.when(first_non_empty(c) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.format_string("Image on page %s.", page.cast("string")), F.concat(F.lit("Image path: "), path), some("Caption: ", caption), some("Image OCR text: ", ocr_text))


def chunk_images(images: DataFrame, start_index: int = 0) -> DataFrame:
    """One chunk for each image (document_id, image_id, page_number, image_index, image_path, caption, ocr_text)."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("page_number", "image_index", "image_id")
    content = image_chunk_content(F.col("page_number"), F.col("image_path"), F.col("caption"), F.col("ocr_text"))
    return images.select(
        "document_id",
        (F.row_number().over(order) - 1 + start_index).alias("chunk_index"),
        content.alias("content"),
        count_tokens(content).alias("token_count"),
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        F.lit("pdf_image").alias("source_type"),
        F.array(F.col("image_id").cast("string")).alias("image_ids"),
    )


def chunk_image_ocr(images: DataFrame, start_index: int = 0, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The OCR text of images as ordinary text chunks."""
    cut = images.select("document_id", "image_id", "page_number", F.posexplode(text_chunk_array(F.coalesce("ocr_text", F.lit("")), size, overlap)).alias("i", "content"))
    return cut.select(
        "document_id",
        (F.col("i") + start_index).alias("chunk_index"),
        "content",
        count_tokens(F.col("content")).alias("token_count"),
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        F.lit("image_ocr").alias("source_type"),
        F.array(F.col("image_id").cast("string")).alias("image_ids"),
    )


def link_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """images with chunk_id: of several chunks that name an image, the last one by chunk_index."""
    named = chunks.select("chunk_id", "chunk_index", F.explode("image_ids").alias("_image"))
    last = named.groupBy("_image").agg(F.max_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))
    return images.join(last, F.col("image_id").cast("string") == F.col("_image"), "left").drop("_image")
