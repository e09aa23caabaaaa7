"""Vector, keyword and hybrid retrieval over chunks.

Chunks carry chunk_id, document_id, knowledge_base_id, chunk_index, content, embedding, confidential_level and metadata
(struct with title, page_start, page_end, source_type, image_ids). Documents carry document_id, status, department,
confidential_level. All filters stand below the joins, so they reach the scans; each leg ends in a top-k, which every
task cuts for itself before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.principal import Principal
from ..functions.text import wants_images
from ..functions.vectors import cosine_to, trigram_similarity
from ..plans.scratch import scratch_dir
from .security import retrieval_filter

VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.65, 0.35
DEFAULT_TOP_K, MAX_TOP_K, RERANK_TOP_N = 8, 50, 8
MAX_TOOL_CALLS = 4
HIT = ("chunk_id", "document_id", "content", "vector_score", "keyword_score", "final_score", "metadata")
#: A batch of query vectors travels with every task: so many bytes at most.
MAX_QUERY_BYTES = 64 << 20
#: Scores of queries with chunks that a task holds at once, 16 MB, whatever the number of queries.
_SCORES = 1 << 21


def in_bases(kb_ids: Sequence[str] | None) -> Column:
    return F.lit(True) if kb_ids is None else F.col("knowledge_base_id").isin(*kb_ids)


def searchable(chunks: DataFrame, documents: DataFrame, permissions: DataFrame, principal: Principal | None, kb_ids: Sequence[str] | None) -> DataFrame:
    """Chunks of ready documents the principal may search, within the knowledge bases.

    The level in a hit's metadata is the chunk's own.
    """
    ready = retrieval_filter(documents.where("status = 'ready'"), permissions, principal).select("document_id")
    return chunks.where(in_bases(kb_ids)).join(ready, "document_id").withColumn("metadata", F.struct("metadata.*", "confidential_level"))


def vector_search(chunks: DataFrame, documents: DataFrame, permissions: DataFrame, query: Sequence[float], kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None) -> DataFrame:
    """The nearest chunks by cosine, with their order ``ord`` from 1.

    Chunks without an embedding are out. Zero vectors have no similarity: they come last and score 0. No knowledge
    base given at all (an empty list): no result.
    """
    found = searchable(chunks.where("embedding is not null"), documents, permissions, principal, kb_ids)
    scored = found.withColumn("_score", cosine_to(F.col("embedding"), query))
    top = scored.orderBy(F.col("_score").desc_nulls_last(), "chunk_id").limit(top_k)
    order = Window.orderBy(F.col("_score").desc_nulls_last(), "chunk_id")
    score = F.coalesce("_score", F.lit(0.0))
    return top.withColumn("ord", F.row_number().over(order)).select("chunk_id", "document_id", "content", score.alias("vector_score"), F.lit(0.0).alias("keyword_score"), score.alias("final_score"), "metadata", "ord")


def matches_keyword(content: Column, query: str) -> Column:
    """The whole query stands in the text, in any case; % and _ in it keep their pattern meaning."""
    return content.ilike(f"%{query}%")


def keyword_search(chunks: DataFrame, documents: DataFrame, permissions: DataFrame, query: str, kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None) -> DataFrame:
    """Chunks that contain the query, by trigram similarity to it. A blank query finds nothing."""
    wanted = chunks.where(matches_keyword(F.col("content"), query)) if query.strip() else chunks.where(F.lit(False))
    found = searchable(wanted, documents, permissions, principal, kb_ids)
    scored = found.withColumn("_score", trigram_similarity(F.col("content"), F.lit(query)))
    top = scored.orderBy(F.col("_score").desc_nulls_first(), "chunk_id").limit(top_k)
    order = Window.orderBy(F.col("_score").desc_nulls_first(), "chunk_id")
    return top.withColumn("ord", F.row_number().over(order)).select("chunk_id", "document_id", "content", F.lit(0.0).alias("vector_score"), F.col("_score").alias("keyword_score"), F.col("_score").alias("final_score"), "metadata", "ord")


def merge_hits(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both legs as one ranking. A chunk that both found keeps the vector leg's row: its keyword score is not added.

    Ties keep the legs' order, vector hits first.
    """
    both = vector.withColumn("src", F.lit(0)).unionByName(keyword.withColumn("src", F.lit(1)))
    # Each leg is computed once; an anti join would compute the vector leg again.
    first = Window.partitionBy("chunk_id").orderBy("src")
    merged = both.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return merged.withColumn("final_score", VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.col("keyword_score"))


def rerank(hits: DataFrame, top_n: int = RERANK_TOP_N) -> DataFrame:
    """The first hits of a ranking, with their rank from 1; scores stay."""
    order = (F.col("final_score").desc(), F.col("src").asc(), F.col("ord").asc())
    return hits.orderBy(*order).limit(top_n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(chunks: DataFrame, documents: DataFrame, permissions: DataFrame, query: str, vector: Sequence[float], kb_ids: Sequence[str] | None, top_k: int = DEFAULT_TOP_K, principal: Principal | None = None, rerank_top_n: int = RERANK_TOP_N) -> DataFrame:
    """Hits of both legs, each cut to ``top_k`` first, merged, ranked and cut to ``rerank_top_n``."""
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    near = vector_search(chunks, documents, permissions, vector, kb_ids, top_k, principal)
    worded = keyword_search(chunks, documents, permissions, query, kb_ids, top_k, principal)
    return rerank(merge_hits(near, worded), rerank_top_n)


def filter_image_chunks(hits: DataFrame, query: str) -> DataFrame:
    """Without image words in the query, image chunks go, unless nothing else was found."""
    image = F.coalesce(F.col("metadata.source_type") == "pdf_image", F.lit(False))
    any_text = F.max(~image).over(Window.partitionBy(F.lit(0)))
    return hits.withColumn("_text", any_text).where(wants_images(F.lit(query)) | ~F.col("_text") | ~image).drop("_text")


def citations(hits: DataFrame) -> DataFrame:
    page = lambda name: F.col(f"metadata.{name}")
    return hits.select("rank", "document_id", "chunk_id", page("title").alias("title"), page("page_start").alias("page_start"), page("page_end").alias("page_end"), F.col("final_score").alias("score"))


def tool_hits(hits: DataFrame) -> DataFrame:
    """Search-tool output: ids as text, the first 1200 characters."""
    return hits.select("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), F.substring("content", 1, 1200).alias("content"), F.col("final_score").alias("score"))


def agent_search(chunks: DataFrame, documents: DataFrame, permissions: DataFrame, query: str, kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None) -> DataFrame:
    """The search tool: the keyword leg alone."""
    leg = keyword_search(chunks, documents, permissions, query, kb_ids, top_k, principal).withColumn("src", F.lit(1))
    return tool_hits(rerank(leg, top_k))


def first_tool_calls(calls: Column) -> Column:
    """The tool calls that are run: the first MAX_TOOL_CALLS a model asks for."""
    return F.slice(calls, 1, MAX_TOOL_CALLS)


def retrieval_log(hits: DataFrame, message_id: int | str, used: DataFrame | None = None) -> DataFrame:
    """One row a hit; ``used``: the chunks that made it into the context."""
    flag = F.lit(False)
    if used is not None:
        hits = hits.join(used.select("chunk_id", F.lit(True).alias("_used")), "chunk_id", "left")
        flag = F.coalesce("_used", F.lit(False))
    return hits.select(F.lit(message_id).alias("message_id"), "document_id", "chunk_id", "vector_score", "keyword_score", F.lit(None).cast("double").alias("rerank_score"), "final_score", "rank", flag.alias("used_in_context"))


class Nearest:
    """The best ``top_k`` of the vectors added, for each of many unit queries, by score and then by key.

    Scores come in tiles of _SCORES. What may be among the best is scored again row by row, so that equal vectors tie
    wherever they stand in a tile.
    """

    def __init__(self, queries: np.ndarray, top_k: int):
        self.queries, self.top_k, self.keys = queries, top_k, None
        self.scores = np.full((len(queries), top_k), -np.inf)

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        if not len(keys):
            return
        if self.keys is None:
            self.keys = np.full(self.scores.shape, keys[0], keys.dtype)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        step, k = max(1, _SCORES // len(keys)), self.top_k
        for at in range(0, len(self.queries), step):
            queries = self.queries[at : at + step]
            scores = queries @ vectors.T
            edge = self.scores[at : at + step, -1]
            if len(keys) > k and np.isneginf(edge).any():
                edge = np.maximum(edge, np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k])
            query, vector = np.nonzero(scores >= edge[:, None] - 1e-12)
            wide = max(1, _SCORES // max(1, vectors.shape[1]))
            again = [(queries[query[i : i + wide]] * vectors[vector[i : i + wide]]).sum(axis=1) for i in range(0, len(query), wide)]
            if again:
                self._merge(query + at, keys[vector], np.concatenate(again))

    def _merge(self, query: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        k = self.top_k
        rows, own = np.unique(query, return_inverse=True)
        own = np.concatenate([np.repeat(np.arange(len(rows)), k), own])
        keys, scores = np.concatenate([self.keys[rows].ravel(), keys]), np.concatenate([self.scores[rows].ravel(), scores])
        order = np.lexsort((np.unique(keys, return_inverse=True)[1], -scores, own))
        sizes = np.bincount(own)  # k at least: those held
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = order[np.arange(len(order)) - first < k]
        self.keys[rows], self.scores[rows] = keys[kept].reshape(-1, k), scores[kept].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, key, score) of all that is held."""
        query, nth = np.nonzero(self.scores > -np.inf)
        return query, self.keys[query, nth], self.scores[query, nth]


def vector_search_batch(chunks: DataFrame, queries: DataFrame, top_k: int, block: int = 4096, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, vector_score, rank) for many queries (query_id, embedding) at once.

    The query vectors go to the tasks in blocks of about ``max_query_bytes``, sized before anything is fetched; a task
    multiplies blocks of chunks with them and keeps ``top_k`` a query, so what is shuffled is queries x top_k rows a task,
    never all pairs. There are as many tasks as cores, twice, however many parts the chunks have: else both numbers would
    grow with the tables. With several blocks each one's result is written to the shared folder before the next is fetched.
    """
    spark = chunks.sparkSession
    asked = queries.where("embedding is not null")
    n, wide = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    parts = max(1, -(-n * 8 * (wide or 0) // max_query_bytes))
    if parts == 1:
        return _search_block(chunks, asked, top_k, block)[0]
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    root = scratch_dir(spark, "vector-batch")
    for k in range(parts):
        found, sent = _search_block(chunks, asked.where(part == k), top_k, block)
        found.write.parquet(f"{root}/part={k}")
        sent.destroy()
    return spark.read.parquet(*(f"{root}/part={k}" for k in range(parts)))


def _search_block(chunks: DataFrame, queries: DataFrame, top_k: int, block: int) -> tuple[DataFrame, Broadcast]:
    table = queries.select("query_id", "embedding").toArrow()
    matrix = np.array(table.column("embedding").to_pylist(), np.float64).reshape(table.num_rows, -1 if table.num_rows else 0)
    ids, kind = table.column("query_id").to_pylist(), queries.schema["query_id"].dataType.simpleString()
    key = chunks.schema["chunk_id"].dataType.simpleString()
    id_type, key_type = table.schema.field("query_id").type, to_arrow_type(chunks.schema["chunk_id"].dataType)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    sent = chunks.sparkSession.sparkContext.broadcast((ids, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        best = Nearest(q, top_k)
        for batch in batches if names else ():
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = np.array(part.column("embedding").to_pylist(), np.float64).reshape(part.num_rows, -1)
                best.add(part.column("chunk_id").to_numpy(zero_copy_only=False), v)
        if best.keys is not None:
            query, keys, scores = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(names, id_type).take(pa.array(query)), pa.array(keys, key_type), pa.array(scores)], ["query_id", "chunk_id", "vector_score"])

    few = 2 * chunks.sparkSession.sparkContext.defaultParallelism
    local = chunks.where("embedding is not null").select("chunk_id", "embedding").coalesce(few).mapInArrow(run, f"query_id {kind}, chunk_id {key}, vector_score double")
    order = Window.partitionBy("query_id").orderBy(F.col("vector_score").desc(), "chunk_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k), sent
