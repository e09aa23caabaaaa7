"""Merging, context budgets and images, against loops that spend the budgets one hit after another."""

import random

import pytest
from pyspark.sql import functions as F

from corvella.operators import context, search

META = "struct<title:string,page_start:int,page_end:int,source_type:string,image_ids:array<string>,confidential_level:string>"


def _hits(spark, rows):
    """rows: (rank, chunk_id, document_id, content, metadata tuple)."""
    return spark.createDataFrame(rows, f"rank int, chunk_id long, document_id long, content string, metadata {META}")


def _loop(rows, tokens, chars):
    """Sections of the hits that fit."""
    out, used_tokens, used_chars = [], 0, 0
    for rank, chunk, doc, content, (title, start, end, *_) in rows:
        first = "" if start is None else start
        header = f"[Source {rank}]\nDocument: {title if title is not None else doc}\nPage: {first}-{first if end is None else end}\nChunk ID: {chunk}\nContent:"
        room = chars - used_chars - len(header) - 2
        if room <= 0 or used_tokens >= tokens:
            break
        body = content[:room]
        if len(body.split()) > tokens - used_tokens:
            body = " ".join(body.split()[: tokens - used_tokens])
        if not body:
            break
        out.append(f"{header}\n{body}")
        used_tokens += len(body.split())
        used_chars += len(header) + 1 + len(body) + 2
    return out


@pytest.mark.parametrize("seed", range(6))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    frames, want = [], {}
    for q in range(25):
        rows = []
        for rank in range(1, rng.randrange(2, 8)):
            words = " ".join(rng.choice(["a", "bb", "ccc", "\n", "  "]) for _ in range(rng.randrange(0, 40)))
            rows.append((rank, rank * 10, rank, words, (rng.choice([None, "T"]), rng.choice([None, 2]), rng.choice([None, 3]), "pdf_text", None, "public")))
        frames.append(_hits(spark, rows).withColumn("q", F.lit(q)))
        want[q] = (rows, rng.randrange(1, 60), rng.randrange(60, 700))
    tokens, chars = want[0][1:]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    built = context.build_context(union, tokens, chars, key=["q"])
    got = {}
    for r in built.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.section)
    assert got == {q: s for q, (rows, *_) in want.items() if (s := _loop(rows, tokens, chars))}
    joined = {r.q: r.context for r in context.join_sections(built, key=["q"]).collect()}
    assert joined == {q: "\n\n".join(s) for q, s in got.items()}


def test_default_budgets():
    assert context.budgets() == {"tokens": 5756, "image_chars": 6000, "text_chars": 21000}


def _leg(spark, rows):
    m = F.struct(F.lit(None).cast("string").alias("source_type"))
    return spark.createDataFrame(rows, "chunk_id long, document_id long, content string, vector_score double, keyword_score double, final_score double, ord int").withColumn("metadata", m)


def test_merge_keeps_the_vector_row_and_ties_in_order(spark):
    vector = _leg(spark, [(1, 1, "a", 0.8, 0.0, 0.8, 1), (2, 2, "b", 0.35, 0.0, 0.35, 2)])
    keyword = _leg(spark, [(1, 1, "a", 0.0, 0.9, 0.9, 1), (3, 3, "c", 0.0, 0.65, 0.65, 2), (4, 4, "d", 0.0, 0.1, 0.1, 3)])
    rows = search.rerank(search.merge_hits(vector, keyword), 3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.final_score, 6), r.keyword_score) for r in rows] == [(1, 0.52, 0.0), (2, 0.2275, 0.0), (3, 0.2275, 0.65)]


def test_image_chunks_stay_only_when_asked_for_or_alone(spark):
    text = (1, 10, 1, "x", (None, 1, 1, "pdf_text", None, "public"))
    image = (2, 20, 1, "y", (None, 1, 1, "pdf_image", ["7"], "public"))
    ranks = lambda rows, q: sorted(r.rank for r in search.filter_image_chunks(_hits(spark, rows), q).collect())
    assert ranks([text, image], "what") == [1] and ranks([text, image], "which figure") == [1, 2] and ranks([image], "what") == [2]


def test_restricted_hits_block(spark):
    rows = [(1, 10, 1, "x", (None, 1, 1, "pdf_text", None, "public"))]
    assert not context.restricted(_hits(spark, rows)).first().blocked
    assert context.restricted(_hits(spark, [*rows, (2, 20, 1, "y", (None, 1, 1, None, None, "restricted"))])).first().blocked
    assert not context.restricted(_hits(spark, rows).limit(0)).first().blocked


def _images(spark):
    rows = [(7, 1, 1, 1, "p", "cap", None), (8, 1, 2, 1, "p", "", "words"), (9, 2, 1, 2, "p", None, ""), (10, 2, 1, 1, "p", None, None), (11, 10, 1, 1, "p", None, None)]
    return spark.createDataFrame(rows, "image_id long, document_id long, page_number int, image_index int, image_path string, caption string, ocr_text string")


def test_images_by_id_and_by_page(spark):
    rows = [(1, 10, 1, "x", (None, 3, 1, "pdf_text", ["9", "junk"], None)), (2, 20, 1, "x", (None, 1, None, "t", None, None)), (3, 30, 10, "x", (None, None, 4, "t", None, None))]
    found = context.images_for_hits(_hits(spark, rows), _images(spark))
    assert sorted(r.image_id for r in found.collect()) == [7, 9]
    ranked = context.order_images(_images(spark)).orderBy("rank").collect()
    assert [r.image_id for r in ranked] == [7, 8, 11, 10]  # by document as text: "1" < "10" < "2"


def test_image_sections_spend_their_budget(spark):
    rows = context.image_sections(context.order_images(_images(spark)), 130).orderBy("rank").collect()
    whole = "[Image 1]\nImage ID: 7\nDocument ID: 1\nPage: 1\nPath: p\nCaption: cap"
    second = "[Image 2]\nImage ID: 8\nDocument ID: 1\nPage: 2\nPath: p\nOCR text: words"
    assert [r.section for r in rows] == [whole, second[: 130 - len(whole) - 2].rstrip()]


def test_prompts(spark):
    said = spark.range(1).select(context.user_prompt(F.lit("q"), F.lit("c"), F.lit("")), context.user_prompt(F.lit("q"), F.lit("c"), F.lit("i"))).first()
    form = "Required output format:\n1. Answer\n2. Key points\n3. Sources\n4. Confidence\n5. Limitations\n"
    assert said[0] == f"User question:\nq\n\nContext:\nc\n\n\n{form}" and said[1] == f"User question:\nq\n\nContext:\nc\n\nImage context:\ni\n\n\n{form}"


def test_keyword_patterns_and_blank_queries(spark):
    chunks = spark.createDataFrame([(1, 1, "kb", "Fifty%Cent"), (2, 1, "kb", "fiftyXcent"), (3, 1, "kb", "other")], "chunk_id long, document_id long, knowledge_base_id string, content string").withColumn("confidential_level", F.lit("public")).withColumn("metadata", F.struct(F.lit(1).alias("page_start")))
    documents = spark.createDataFrame([(1, "ready", "public", None)], "document_id long, status string, confidential_level string, department string")
    grants = spark.createDataFrame([], "document_id long, subject_type string, subject_value string, permission string")
    ids = lambda q, kbs=None: sorted(r.chunk_id for r in search.keyword_search(chunks, documents, grants, q, kbs, 8, None).collect())
    assert ids("FIFTY%cent") == [1, 2] and ids("  ") == [] and ids("fifty", []) == [] and ids("fifty", ["kb"]) == [1, 2]
