"""Retrieval for a table of questions at once: both legs, one ranking a question, contexts and images under budgets.

Every step is a join or a window by question, so questions are dealt over tasks like any key; nothing pairs all questions
with all chunks but the vector leg's matrix products, which keep ``top_k`` a question and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.principal import Principal
from . import context, postings, search
from .search import KEYWORD_WEIGHT, MAX_TOP_K, RERANK_TOP_N, VECTOR_WEIGHT


def nearest_chunks(chunks: DataFrame, documents: DataFrame, permissions: DataFrame, questions: DataFrame, kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None) -> DataFrame:
    """(query_id, chunk_id, vector_score, rank): ``search.vector_search`` of questions (query_id, embedding). Exact.

    Vectors of zeros or of another length than the question's are as far as can be: they are left out here.
    """
    ready = search.searchable(chunks.where("embedding is not null"), documents, permissions, principal, kb_ids)
    asked = questions.select("query_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 8)).alias("embedding"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return search.vector_search_batch(ready.where(norm > 0).select("chunk_id", "embedding"), asked, top_k)


def hybrid_search(chunks: DataFrame, index: postings.GramIndex, documents: DataFrame, permissions: DataFrame, questions: DataFrame, kb_ids: Sequence[str] | None, top_k: int = search.DEFAULT_TOP_K, principal: Principal | None = None, rerank_top_n: int = RERANK_TOP_N) -> DataFrame:
    """``search.hybrid_search`` of questions (query_id, query, embedding): its columns after query_id.

    ``index`` lists the same chunks. A question without a vector, or with blank words, has hits of the other leg alone.
    Ids and scores alone are ranked; content is fetched from the index for the hits that are left.
    """
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    near = nearest_chunks(chunks, documents, permissions, questions, kb_ids, top_k, principal)
    worded = postings.ranked_chunks(index, questions.select("query_id", "query"), documents, permissions, kb_ids, top_k, principal)
    leg = lambda found, vector, keyword, ord, src: found.select("query_id", "chunk_id", vector.alias("vector_score"), keyword.alias("keyword_score"), F.col(ord).alias("ord"), F.lit(src).alias("src"))  # noqa: A006, E731
    both = leg(near, F.col("vector_score"), F.lit(0.0), "rank", 0).unionByName(leg(worded, F.lit(0.0), F.col("_score"), "ord", 1))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("src")
    merged = both.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    scored = merged.withColumn("final_score", VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.col("keyword_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "src", "ord")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rerank_top_n)
    return postings.with_content(index, ranked).select("query_id", "chunk_id", "document_id", "content", "vector_score", "keyword_score", "final_score", "metadata", "ord", "src", "rank")


def contexts(hits: DataFrame, max_tokens: int = context.MAX_TOKENS, max_chars: int = context.MAX_CHARS) -> DataFrame:
    """(query_id, context): the sections of each question's hits that fit its budgets; none without a hit that fits."""
    return context.join_sections(context.build_context(hits, max_tokens, max_chars, ["query_id"]), key=["query_id"])


def images(hits: DataFrame, stored: DataFrame, max_images: int = context.MAX_IMAGES) -> DataFrame:
    """(query_id, rank, image columns): the first images that a question's hits name, or on pages they span, each once."""
    start, end = F.col("metadata.page_start").cast("int"), F.coalesce(F.col("metadata.page_end"), F.col("metadata.page_start")).cast("int")
    named = hits.select("query_id", F.explode("metadata.image_ids").alias("_id")).distinct()
    pages = hits.where(start.isNotNull() & (end >= start)).select("query_id", F.col("document_id").alias("_doc"), F.explode(F.sequence(start, end)).alias("_page")).distinct()
    by_id = stored.join(named, F.col("image_id").cast("string") == F.col("_id")).select("query_id", *stored.columns)
    by_page = stored.join(pages, (F.col("document_id") == F.col("_doc")) & (F.col("page_number") == F.col("_page"))).select("query_id", *stored.columns)
    once = by_id.unionByName(by_page).dropDuplicates(["query_id", "image_id"])
    order = Window.partitionBy("query_id").orderBy(F.col("document_id").cast("string"), "page_number", "image_index", F.col("image_id").cast("string"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_images)
