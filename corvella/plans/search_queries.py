"""Registered queries: retrieval, access control and context, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.principal import LEVELS, token_columns
from ..operators import access, cells, codes, context, postings, questions, search, security
from . import views
from .scratch import scratch_dir
from .views import PRINCIPAL, QUERY, QUERY_VECTOR, with_views

TOP_K = 8
QUERY_IDS_EVERY = 50


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.chunks(spark, sf), views.documents(spark, sf), views.document_permissions(spark, sf)


def _flat(hits: DataFrame, *more: str) -> DataFrame:
    score = lambda c: F.round(c, 6).alias(c)
    return hits.select("chunk_id", "document_id", score("vector_score"), score("keyword_score"), score("final_score"), F.col("metadata.confidential_level").alias("level"), *more)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.vector_search(*_tables(spark, sf), QUERY_VECTOR, None, TOP_K, PRINCIPAL), "ord")


def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.keyword_search(*_tables(spark, sf), QUERY, None, TOP_K, PRINCIPAL), "ord")


def _hybrid(spark: SparkSession, sf: str, top_k: int = TOP_K, top_n: int = 2 * TOP_K) -> DataFrame:
    return search.hybrid_search(*_tables(spark, sf), QUERY, QUERY_VECTOR, None, top_k, PRINCIPAL, top_n)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: both legs, merged and ranked."""
    return _flat(_hybrid(spark, sf), "rank")


def rerank_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_hybrid(spark, sf, top_n=search.RERANK_TOP_N), "rank")


def citations(spark: SparkSession, sf: str) -> DataFrame:
    found = search.citations(_hybrid(spark, sf))
    return found.withColumn("score", F.round("score", 6))


def agent_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.agent_search(*_tables(spark, sf), QUERY, None, TOP_K, PRINCIPAL)
    return found.withColumn("score", F.round("score", 6))


def image_chunk_filter(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hybrid(spark, sf)
    return search.filter_image_chunks(hits, QUERY).select("rank", "chunk_id", F.col("metadata.source_type").alias("source_type"))


def vector_cells(spark: SparkSession, sf: str) -> DataFrame:
    """vector_topk by the cell index with every cell probed, which must give the exact result."""
    chunks, documents, permissions = _tables(spark, sf)
    centroids = cells.fit_centroids(chunks)
    return _flat(cells.cell_search(cells.with_cells(chunks, centroids), centroids, documents, permissions, QUERY_VECTOR, None, TOP_K, PRINCIPAL, cells.LISTS), "ord")


def vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector by the index of codes, with default probes: its best hit, and whether recall over all is 0.9 or more."""
    vectors = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.lit("kb").alias("knowledge_base_id"), "embedding")
    queries = vectors.where(F.col("chunk_id") % QUERY_IDS_EVERY == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    found = codes.search_batch(codes.build(vectors, scratch_dir(spark, "vector-index")), queries, TOP_K)
    exact = search.vector_search_batch(vectors.select("chunk_id", "embedding"), queries, TOP_K).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "chunk_id"], "full")
    recall = both.agg(F.count(F.when(F.col("rank").isNotNull(), F.col("hit"))) / F.count("hit")).first()[0] or 0.0
    return found.where("rank = 1").select("query_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), F.lit(recall >= 0.9).alias("recall_ok"))


def keyword_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve characters of every 50th document, looked up by the gram index among all chunks."""
    documents, permissions = views.documents(spark, sf), views.document_permissions(spark, sf)
    asked = documents.where(F.col("document_id") % QUERY_IDS_EVERY == 0).select(F.col("document_id").alias("query_id"), F.regexp_replace(F.substring("text", 11, 12), r"[%_\\\\]", "").alias("query"))
    index = postings.build(views.chunks(spark, sf, embedded=False), scratch_dir(spark, "gram-index"))
    found = postings.keyword_search_batch(index, asked, documents, permissions, None, TOP_K, PRINCIPAL)
    return found.select("query_id", "chunk_id", "document_id", F.round("keyword_score", 6).alias("keyword_score"), F.col("metadata.confidential_level").alias("level"), "ord")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve characters of every 50th document as a question, with a vector."""
    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    said = F.regexp_replace(F.substring("text", 11, 12), r"[%_\\]", "")
    asked = views.documents(spark, sf).where(F.col("document_id") % QUERY_IDS_EVERY == 0).select(F.col("document_id").alias("query_id"), said.alias("query"), F.pmod(F.col("document_id") + 7, F.lit(n)).alias("vec_id"))
    return asked.join(vectors, "vec_id").drop("vec_id")


def _question_hits(spark: SparkSession, sf: str) -> DataFrame:
    chunks, documents, permissions = _tables(spark, sf)
    index = postings.build(views.chunks(spark, sf, embedded=False), scratch_dir(spark, "gram-index"))
    return questions.hybrid_search(chunks, index, documents, permissions, _questions(spark, sf), None, TOP_K, PRINCIPAL, 2 * TOP_K)


def question_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking of every question of a table."""
    return _flat(_question_hits(spark, sf), "query_id", "rank")


def question_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The context of every question under tight budgets."""
    found = questions.contexts(_question_hits(spark, sf), 1_500, 9_000)
    return found.select("query_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def vector_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector as a query against all vectors."""
    vectors = views.table(spark, sf, "embeddings")
    queries = vectors.where(F.col("vec_id") % QUERY_IDS_EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.vector_search_batch(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, TOP_K)
    return found.withColumn("vector_score", F.round("vector_score", 6)).select("query_id", "chunk_id", "vector_score", "rank")


def context_build(spark: SparkSession, sf: str) -> DataFrame:
    """Which hits fit into the default budgets, and what each contributes."""
    left = context.budgets()
    used = context.build_context(_hybrid(spark, sf), left["tokens"], left["text_chars"])
    return used.select("rank", "chunk_id", F.length("section").alias("n_chars"), F.sha2("section", 256).alias("section_sha256"))


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    """The context under tight budgets, as one text."""
    used = context.build_context(_hybrid(spark, sf), 1_500, 9_000)
    return context.join_sections(used).select(F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def restricted_block(spark: SparkSession, sf: str) -> DataFrame:
    return context.restricted(_hybrid(spark, sf))


def hit_images(spark: SparkSession, sf: str) -> DataFrame:
    found = context.images_for_hits(_hybrid(spark, sf), views.images(spark, sf))
    return found.select("image_id", "document_id", "page_number")


def image_context(spark: SparkSession, sf: str) -> DataFrame:
    found = context.images_for_hits(_hybrid(spark, sf), views.images(spark, sf))
    return context.image_sections(context.order_images(found), 400).select("rank", "image_id", "section")


def acl_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return security.retrieval_filter(views.documents(spark, sf), views.document_permissions(spark, sf), PRINCIPAL).select("document_id")


def acl_documents(spark: SparkSession, sf: str) -> DataFrame:
    marked = security.can_read_documents(views.documents(spark, sf), views.document_permissions(spark, sf), views.base_permissions(spark, sf), PRINCIPAL)
    return marked.select("document_id", "can_read")


def _principals(spark: SparkSession, sf: str) -> DataFrame:
    """The users as principals: departments, levels and roles by number, an administrator among fifty."""
    u = F.col("user_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    roles = F.when(u % 50 == 0, F.array(F.lit("admin"))).when(u % 3 == 0, F.array(F.lit("reader"), F.lit("auditor"))).when(u % 3 == 1, F.array(F.lit("editor"))).otherwise(F.array().cast("array<string>"))
    return views.users(spark, sf).select(u.alias("principal_id"), F.col("external_user_id").alias("user"), F.when(u % 7 != 0, pick(views.DEPARTMENTS, u % 5)).alias("department"), roles.alias("roles"), pick(views.LEVEL_NAMES, u % 4).alias("clearance"), (u % 9 != 0).alias("active"))


def principals_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """How many principals may search each document, by classes of both."""
    found = access.access_classes(views.documents(spark, sf), "document_id", views.document_permissions(spark, sf), _principals(spark, sf), "confidential_level")
    return found.principals_of_objects().select(F.col("object_id").alias("document_id"), "n")


def principals_of_bases(spark: SparkSession, sf: str) -> DataFrame:
    """How many active principals may use each knowledge base."""
    found = access.access_classes(views.knowledge_bases(spark, sf), "knowledge_base_id", views.base_permissions(spark, sf), _principals(spark, sf), department="owner_department", active_only=True)
    return found.principals_of_objects().select(F.col("object_id").alias("knowledge_base_id"), "n")


def kb_access(spark: SparkSession, sf: str) -> DataFrame:
    return security.can_access_bases(views.knowledge_bases(spark, sf), views.base_permissions(spark, sf), PRINCIPAL).select("knowledge_base_id", "can_access")


def bearer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens made from documents, read back."""
    d = views.documents(spark, sf)
    role = F.when(F.col("document_id") % 3 == 0, " reader, auditor,").otherwise("")
    token = F.concat_ws("|", F.concat(F.lit("u"), "document_id"), F.coalesce("department", F.lit("")), F.when(F.col("document_id") % 7 == 0, "secret").otherwise(F.col("confidential_level")), role)
    t = d.select("document_id", token_columns(token).alias("t"))
    return t.select("document_id", F.col("t.user").alias("user_name"), F.col("t.department").alias("department"), F.col("t.clearance").alias("clearance"), F.array_join("t.roles", ",").alias("roles"), F.col("t.error").isNull().alias("valid"))


def base_choice(spark: SparkSession, sf: str) -> DataFrame:
    """What a search may look into when a document's id, its base and a base that is not allowed are asked for."""
    allowed = F.array(F.lit("source_a"), F.lit("empty_a"), F.lit("empty_b"))
    d = F.col("document_id")
    asked = F.when(d % 3 == 0, F.array(F.lit("empty_b"), F.lit("nowhere"), F.lit("empty_a"), F.lit("empty_b"))).when(d % 3 == 1, F.array(F.lit("nowhere"), d.cast("string")))
    return views.documents(spark, sf).select(d, F.array_join(security.restrict_bases(asked, allowed), ",").alias("bases"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The instructions and the prompt for every document's whole text, every second one with an image."""
    d = F.col("document_id")
    images = F.when(d % 2 == 0, F.concat(F.lit("[Image "), d, F.lit("]"))).otherwise("")
    said = context.user_prompt(F.concat(F.lit("What does "), d, F.lit(" say?")), F.coalesce("text", F.lit("")), images)
    return views.documents(spark, sf).select(d, F.sha2(F.lit(context.SYSTEM_PROMPT), 256).alias("system_sha256"), F.sha2(said, 256).alias("user_sha256"))


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Up to seven calls asked for, of which at most four are run."""
    asked = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(i <= F.col("document_id") % 8, F.concat(F.lit("call "), i)))
    return views.documents(spark, sf).select("document_id", F.array_join(search.first_tool_calls(F.array_compact(asked)), ",").alias("calls"))


QUERIES = {
    f.__name__: f
    for f in (hybrid_search, vector_topk, keyword_topk, rerank_cut, citations, agent_search, image_chunk_filter, vector_cells, vector_codes, keyword_postings, question_hits, question_contexts, vector_batch, context_build, context_text, restricted_block, hit_images, image_context, acl_retrieval, acl_documents, principals_of_documents, principals_of_bases, kb_access, bearer_tokens, base_choice, prompts, tool_calls)
}

# ---- DuckDB ----------------------------------------------------------------------------------------------------

_ROLES = ", ".join(f"'{r}'" for r in sorted(PRINCIPAL.roles))
_LEVELS = ", ".join(f"'{x}'" for x in PRINCIPAL.levels)


def _match(p: str) -> str:
    return f"({p}.permission IN ('read', 'admin') AND (({p}.subject_type = 'user' AND {p}.subject_value = '{PRINCIPAL.user}') OR ({p}.subject_type = 'department' AND {p}.subject_value = '{PRINCIPAL.department}') OR ({p}.subject_type = 'role' AND {p}.subject_value IN ({_ROLES}))))"


def open_sql(table: str, key: str, outer: str) -> str:
    return f"(NOT EXISTS (SELECT 1 FROM {table} p WHERE p.{key} = {outer}.{key}) OR EXISTS (SELECT 1 FROM {table} p WHERE p.{key} = {outer}.{key} AND {_match('p')}))"


def readable_sql(d: str) -> str:
    """Whether the principal may read a document, as a condition."""
    own = f"coalesce({d}.department = '{PRINCIPAL.department}', false)"
    return f"coalesce({d}.status <> 'archived' AND {d}.confidential_level IN ({_LEVELS}) AND ({own} OR ({open_sql('v_base_permissions', 'knowledge_base_id', d)} AND {open_sql('v_permissions', 'document_id', d)})), false)"


_ALLOWED = f"""
  SELECT d.document_id FROM v_documents d
  WHERE d.confidential_level IN ({_LEVELS}) AND (coalesce(d.department = '{PRINCIPAL.department}', false) OR {open_sql('v_permissions', 'document_id', 'd')})"""

_TRIGRAMS = r"""list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""

_LEGS = f"""
, allowed AS ({_ALLOWED}),
found AS (SELECT c.* FROM v_chunks c JOIN v_documents d USING (document_id) WHERE d.status = 'ready' AND c.document_id IN (SELECT document_id FROM allowed)),
vec AS (
  SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, chunk_id) AS ord
  FROM (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({list(QUERY_VECTOR)} AS DOUBLE[])) AS score FROM found WHERE embedding IS NOT NULL)
  QUALIFY ord <= {TOP_K}
),
kw AS (
  SELECT * EXCLUDE (grams, asked), row_number() OVER (ORDER BY score DESC, chunk_id) AS ord
  FROM (SELECT *, len(list_intersect(grams, asked)) * 1.0 / (len(grams) + len(asked) - len(list_intersect(grams, asked))) AS score
        FROM (SELECT *, {_TRIGRAMS.format("content")} AS grams, {_TRIGRAMS.format(f"'{QUERY}'")} AS asked FROM found WHERE content ILIKE '%{QUERY}%'))
  QUALIFY ord <= {TOP_K}
),
merged AS (
  SELECT * EXCLUDE (score), score AS vector_score, 0.0 AS keyword_score, 0 AS src FROM vec
  UNION ALL
  SELECT * EXCLUDE (score), 0.0, score, 1 FROM kw WHERE chunk_id NOT IN (SELECT chunk_id FROM vec)
),
hits AS (
  SELECT *, row_number() OVER (ORDER BY final_score DESC, src, ord) AS rank
  FROM (SELECT *, 0.65 * vector_score + 0.35 * keyword_score AS final_score FROM merged)
)"""


def _hits(select: str, *more: str, extra: str = "") -> str:
    return with_views(_LEGS + extra + "\n" + select, "v_chunks", "v_permissions", *more)


_SCORES = "chunk_id, document_id, round({v}, 6) AS vector_score, round({k}, 6) AS keyword_score, round({f}, 6) AS final_score, confidential_level AS level"
_HYBRID = "SELECT " + _SCORES.format(v="vector_score", k="keyword_score", f="final_score") + ", CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= {n}"


def _sections(tokens: int, chars: int) -> str:
    """The budgeted prefix by recursion over ranks, as a loop would do it."""
    words = views.sql_words
    return f""",
headed AS (
  SELECT rank, chunk_id, content, '[Source ' || rank || ']' || chr(10) || 'Document: ' || coalesce(title, CAST(document_id AS VARCHAR)) || chr(10)
    || 'Page: ' || page_start || '-' || page_end || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Content:' AS header
  FROM hits
),
loop AS (
  SELECT CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS chars, CAST(0 AS BIGINT) AS tokens, CAST(NULL AS VARCHAR) AS section
  UNION ALL
  SELECT rank, chunk_id, chars + length(header) + 1 + length(body) + 2, tokens + len({words("body")}), header || chr(10) || body
  FROM (
    SELECT h.rank, h.chunk_id, l.chars, l.tokens, h.header,
      CASE WHEN {chars} - l.chars - length(h.header) - 2 <= 0 OR l.tokens >= {tokens} THEN ''
        WHEN len({words(f"h.content[1 : {chars} - l.chars - length(h.header) - 2]")}) <= {tokens} - l.tokens THEN h.content[1 : {chars} - l.chars - length(h.header) - 2]
        ELSE array_to_string({words(f"h.content[1 : {chars} - l.chars - length(h.header) - 2]")}[1 : {tokens} - l.tokens], ' ') END AS body
    FROM loop l JOIN headed h ON h.rank = l.rank + 1
  ) WHERE body <> ''
)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_LEFT = context.budgets()
_IMAGES = """,
named AS (SELECT image_id AS id FROM hits WHERE image_id IS NOT NULL),
pages AS (SELECT DISTINCT document_id, unnest(range(page_start, page_end + 1)) AS page_number FROM hits),
shown AS (
  SELECT i.* FROM v_images i
  WHERE i.image_id IN (SELECT id FROM named) OR EXISTS (SELECT 1 FROM pages p WHERE p.document_id = i.document_id AND p.page_number = i.page_number)
)"""

_VECTOR_TOPK = _hits("SELECT " + _SCORES.format(v="score", k="0.0", f="score") + ", CAST(ord AS INTEGER) AS ord FROM vec")

ORACLES: dict[str, str] = {
    "vector_topk": _VECTOR_TOPK,
    "vector_cells": _VECTOR_TOPK,
    "keyword_topk": _hits("SELECT " + _SCORES.format(v="0.0", k="score", f="score") + ", CAST(ord AS INTEGER) AS ord FROM kw"),
    "hybrid_search": _hits(_HYBRID.format(n=2 * TOP_K)),
    "rerank_cut": _hits(_HYBRID.format(n=search.RERANK_TOP_N)),
    "citations": _hits("SELECT CAST(rank AS INTEGER) AS rank, document_id, chunk_id, title, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, round(final_score, 6) AS score FROM hits"),
    "agent_search": _hits("SELECT CAST(ord AS INTEGER) AS rank, CAST(chunk_id AS VARCHAR) AS chunk_id, CAST(document_id AS VARCHAR) AS document_id, content[1:1200] AS content, round(score, 6) AS score FROM kw"),
    "image_chunk_filter": _hits("SELECT CAST(rank AS INTEGER) AS rank, chunk_id, source_type FROM hits WHERE source_type <> 'pdf_image' OR NOT EXISTS (SELECT 1 FROM hits WHERE source_type <> 'pdf_image')"),
    "vector_batch": f"""
        SELECT query_id, chunk_id, round(score, 6) AS vector_score, CAST(rank AS INTEGER) AS rank FROM (
          SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
          FROM embeddings q, embeddings v WHERE q.vec_id % {QUERY_IDS_EVERY} = 0
        ) WHERE rank <= {TOP_K}""",
    "context_build": _recursive(_hits("SELECT CAST(rank AS INTEGER) AS rank, chunk_id, CAST(length(section) AS INTEGER) AS n_chars, sha256(section) AS section_sha256 FROM loop WHERE rank > 0", extra=_sections(_LEFT["tokens"], _LEFT["text_chars"]))),
    "context_text": _recursive(_hits("SELECT CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS context_sha256 FROM (SELECT string_agg(section, chr(10) || chr(10) ORDER BY rank) AS t FROM loop WHERE rank > 0)", extra=_sections(1_500, 9_000))),
    "restricted_block": _hits("SELECT coalesce(bool_or(confidential_level = 'restricted'), false) AS blocked FROM hits"),
    "hit_images": _hits("SELECT image_id, document_id, CAST(page_number AS INTEGER) AS page_number FROM shown", "v_images", extra=_IMAGES),
    "image_context": _hits(
        """, sections AS (
          SELECT rank, image_id, '[Image ' || rank || ']' || chr(10) || 'Image ID: ' || image_id || chr(10) || 'Document ID: ' || document_id || chr(10) || 'Page: ' || page_number || chr(10) || 'Path: ' || image_path
            || CASE WHEN caption <> '' THEN chr(10) || 'Caption: ' || caption ELSE '' END || CASE WHEN ocr_text <> '' THEN chr(10) || 'OCR text: ' || ocr_text ELSE '' END AS section
          FROM (SELECT *, row_number() OVER (ORDER BY CAST(document_id AS VARCHAR), page_number, image_index, CAST(image_id AS VARCHAR)) AS rank FROM shown) WHERE rank <= 4
        )
        SELECT CAST(rank AS INTEGER) AS rank, image_id, CASE WHEN length(section) > room THEN rtrim(section[1:room], ' ' || chr(10)) ELSE section END AS section
        FROM (SELECT *, 400 - coalesce(sum(length(section) + 2) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM sections) WHERE room > 0""",
        "v_images",
        extra=_IMAGES,
    ),
    "acl_retrieval": with_views(_ALLOWED, "v_documents", "v_permissions"),
    "acl_documents": with_views(f" SELECT d.document_id, {readable_sql('d')} AS can_read FROM v_documents d", "v_documents", "v_permissions", "v_base_permissions"),
    "kb_access": with_views(f" SELECT b.knowledge_base_id, coalesce(b.owner_department = '{PRINCIPAL.department}', false) OR {open_sql('v_base_permissions', 'knowledge_base_id', 'b')} AS can_access FROM v_bases b", "v_base_permissions"),
    "bearer_tokens": with_views(
        f"""
        SELECT document_id, 'u' || document_id AS user_name, department, CASE WHEN document_id % 7 = 0 THEN 'secret' ELSE confidential_level END AS clearance,
          CASE WHEN document_id % 3 = 0 THEN 'auditor,reader' ELSE '' END AS roles, document_id % 7 <> 0 OR 'secret' IN ({", ".join(f"'{x}'" for x in LEVELS)}) AS valid
        FROM v_documents""",
        "v_documents",
    ),
}

_QUESTIONS = f"""
, allowed AS ({_ALLOWED}),
found AS (SELECT c.* FROM v_chunks c JOIN v_documents d USING (document_id) WHERE d.status = 'ready' AND c.document_id IN (SELECT document_id FROM allowed)),
asked AS (
  SELECT d.document_id AS query_id, regexp_replace(substring(d.text, 11, 12), '[%_\\\\]', '', 'g') AS query, e.embedding AS asked_vector
  FROM v_documents d JOIN embeddings e ON e.vec_id = (d.document_id + 7) % (SELECT count(*) FROM embeddings) WHERE d.document_id % {QUERY_IDS_EVERY} = 0
),
vec AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS ord
  FROM (SELECT q.query_id, c.*, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), list_transform(q.asked_vector, lambda x: round(CAST(x AS DOUBLE), 8))) AS score FROM found c, asked q WHERE c.embedding IS NOT NULL)
  QUALIFY ord <= {TOP_K}
),
kw AS (
  SELECT * EXCLUDE (grams, own, query), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS ord
  FROM (SELECT *, coalesce(len(list_intersect(grams, own)) * 1.0 / nullif(len(grams) + len(own) - len(list_intersect(grams, own)), 0), 0) AS score
        FROM (SELECT q.query_id, q.query, c.*, {_TRIGRAMS.format("c.content")} AS grams, {_TRIGRAMS.format("q.query")} AS own FROM found c JOIN asked q ON trim(q.query, ' ') <> '' AND contains(lower(c.content), lower(q.query))))
  QUALIFY ord <= {TOP_K}
),
merged AS (
  SELECT * EXCLUDE (score), score AS vector_score, 0.0 AS keyword_score, 0 AS src FROM vec
  UNION ALL
  SELECT * EXCLUDE (score), 0.0, score, 1 FROM kw WHERE NOT EXISTS (SELECT 1 FROM vec WHERE vec.query_id = kw.query_id AND vec.chunk_id = kw.chunk_id)
),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, src, ord) AS rank FROM (SELECT *, 0.65 * vector_score + 0.35 * keyword_score AS final_score FROM merged))
  WHERE rank <= {2 * TOP_K}
)"""
ORACLES["question_hits"] = with_views(_QUESTIONS + " SELECT query_id, " + _SCORES.format(v="vector_score", k="keyword_score", f="final_score") + ", CAST(rank AS INTEGER) AS rank FROM hits", "v_chunks", "v_permissions")
#: The budgeted prefix as for one question, with every step by question.
_BY_QUESTION = (
    _sections(1_500, 9_000)
    .replace("SELECT rank, chunk_id, content,", "SELECT query_id, rank, chunk_id, content,")
    .replace("SELECT CAST(0 AS BIGINT) AS rank,", "SELECT query_id, CAST(0 AS BIGINT) AS rank,")
    .replace("AS section\n  UNION ALL\n  SELECT rank,", "AS section FROM asked\n  UNION ALL\n  SELECT query_id, rank,")
    .replace("SELECT h.rank,", "SELECT h.query_id, h.rank,")
    .replace("ON h.rank = l.rank + 1", "ON h.query_id = l.query_id AND h.rank = l.rank + 1")
)
ORACLES["question_contexts"] = _recursive(
    with_views(
        _QUESTIONS + _BY_QUESTION + " SELECT query_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS context_sha256 FROM (SELECT query_id, string_agg(section, chr(10) || chr(10) ORDER BY rank) AS t FROM loop WHERE rank > 0 GROUP BY query_id)",
        "v_chunks",
        "v_permissions",
    )
)
ORACLES["vector_codes"] = f"""
  SELECT query_id, chunk_id, round(score, 6) AS vector_score, true AS recall_ok FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % {QUERY_IDS_EVERY} = 0
  ) WHERE rank = 1"""
ORACLES["keyword_postings"] = with_views(
    f""", allowed AS ({_ALLOWED}),
    found AS (SELECT c.* FROM v_chunks c JOIN v_documents d USING (document_id) WHERE d.status = 'ready' AND c.document_id IN (SELECT document_id FROM allowed)),
    asked AS (SELECT document_id AS query_id, regexp_replace(substring(text, 11, 12), '[%_\\\\]', '', 'g') AS query FROM v_documents WHERE document_id % {QUERY_IDS_EVERY} = 0),
    pairs AS (SELECT q.query_id, q.query, c.* FROM found c JOIN asked q ON trim(q.query, ' ') <> '' AND contains(lower(c.content), lower(q.query))),
    scored AS (
      SELECT *, coalesce(len(list_intersect(grams, own)) * 1.0 / nullif(len(grams) + len(own) - len(list_intersect(grams, own)), 0), 0) AS score
      FROM (SELECT *, {_TRIGRAMS.format("content")} AS grams, {_TRIGRAMS.format("query")} AS own FROM pairs)
    )
    SELECT query_id, chunk_id, document_id, round(score, 6) AS keyword_score, confidential_level AS level, CAST(ord AS INTEGER) AS ord
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS ord FROM scored) WHERE ord <= {TOP_K}""",
    "v_chunks",
    "v_permissions",
)
_PRINCIPALS = f"""principals AS (
  SELECT user_id, 'u' || user_id AS name, CASE WHEN user_id % 7 <> 0 THEN {list(views.DEPARTMENTS)}[user_id % 5 + 1] END AS department, user_id % 4 AS clearance, user_id % 9 <> 0 AS active, user_id % 50 = 0 AS is_admin,
    CASE WHEN user_id % 50 = 0 THEN ['admin'] WHEN user_id % 3 = 0 THEN ['reader', 'auditor'] WHEN user_id % 3 = 1 THEN ['editor'] ELSE [] END AS roles
  FROM (SELECT DISTINCT user_id FROM events)
)"""


def _open_to(table: str, key: str, o: str) -> str:
    """Whether principal p may use object o by its grants or for want of them."""
    named = "(g.subject_type = 'user' AND g.subject_value = p.name) OR (g.subject_type = 'department' AND g.subject_value = p.department) OR (g.subject_type = 'role' AND list_contains(p.roles, g.subject_value))"
    return f"(NOT EXISTS (SELECT 1 FROM {table} g WHERE g.{key} = {o}.{key}) OR EXISTS (SELECT 1 FROM {table} g WHERE g.{key} = {o}.{key} AND g.permission IN ('read', 'admin') AND ({named})))"


ORACLES["principals_of_documents"] = with_views(
    f""", {_PRINCIPALS} SELECT d.document_id, count(*) FILTER (WHERE p.is_admin OR (list_position({list(views.LEVEL_NAMES)}, d.confidential_level) - 1 <= p.clearance
      AND (coalesce(d.department = p.department, false) OR {_open_to("v_permissions", "document_id", "d")}))) AS n
    FROM v_documents d, principals p GROUP BY d.document_id""",
    "v_documents",
    "v_permissions",
)
ORACLES["principals_of_bases"] = with_views(
    f""", {_PRINCIPALS} SELECT b.knowledge_base_id, count(*) FILTER (WHERE p.active AND (p.is_admin OR coalesce(b.owner_department = p.department, false) OR {_open_to("v_base_permissions", "knowledge_base_id", "b")})) AS n
    FROM v_bases b, principals p GROUP BY b.knowledge_base_id""",
    "v_base_permissions",
)
ORACLES["base_choice"] = with_views(" SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'empty_b,empty_a,empty_b' ELSE 'source_a,empty_a,empty_b' END AS bases FROM v_documents", "v_documents")
ORACLES["prompts"] = with_views(
    f""" SELECT document_id, sha256('{context.SYSTEM_PROMPT.replace("'", "''")}') AS system_sha256,
      sha256('User question:' || chr(10) || 'What does ' || document_id || ' say?' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(text, '') || chr(10)
        || CASE document_id % 2 WHEN 0 THEN chr(10) || 'Image context:' || chr(10) || '[Image ' || document_id || ']' || chr(10) ELSE '' END
        || chr(10) || chr(10) || array_to_string(['Required output format:', '1. Answer', '2. Key points', '3. Sources', '4. Confidence', '5. Limitations', ''], chr(10))) AS user_sha256
    FROM v_documents""",
    "v_documents",
)
ORACLES["tool_calls"] = with_views(" SELECT document_id, array_to_string(list_transform(range(1, CAST(least(document_id % 8, 4) + 1 AS BIGINT)), lambda i: 'call ' || i), ',') AS calls FROM v_documents", "v_documents")
