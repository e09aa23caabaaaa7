"""Retrieval for a table of questions against the functions for one question."""

import pytest
from pyspark.sql import functions as F

from corvella.operators import context, postings, questions, search
from corvella.plans import views
from corvella.plans.views import PRINCIPAL, QUERY_VECTOR

SF = "/root/testdata/sf0.001"
SAID = {50: "da", 100: "mente", 150: " ", 0: "e%a", 7: None}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    chunks, documents, permissions = (t.cache() for t in (views.chunks(spark, SF, 60, 10), views.documents(spark, SF), views.document_permissions(spark, SF)))
    index = postings.build(chunks, str(tmp_path_factory.mktemp("grams")), parts=8)
    asked = spark.createDataFrame([(k, q, None if k == 100 else [x * (1 + k % 3) - k / 99 for x in QUERY_VECTOR]) for k, q in SAID.items()], "query_id long, query string, embedding array<double>").cache()
    hits = questions.hybrid_search(chunks, index, documents, permissions, asked, None, 6, PRINCIPAL, 10).cache()
    return chunks, documents, permissions, asked, hits


def _one(tables, key):
    chunks, documents, permissions, asked, _ = tables
    row = asked.where(F.col("query_id") == key).first()
    legs = []
    if row.embedding:
        legs.append(search.vector_search(chunks, documents, permissions, row.embedding, None, 6, PRINCIPAL))
    legs.append(search.keyword_search(chunks, documents, permissions, row["query"] or "", None, 6, PRINCIPAL))
    near = legs[0] if len(legs) == 2 else legs[0].limit(0)
    return search.rerank(search.merge_hits(near, legs[-1]), 10)


@pytest.mark.parametrize("key", sorted(SAID))
def test_every_question_as_if_alone(spark, tables, key):
    one, mine = _one(tables, key).cache(), tables[4].where(F.col("query_id") == key)
    rows = lambda df: [(r.rank, r.chunk_id, round(r.final_score, 9), round(r.vector_score, 9), r.keyword_score, r.metadata.confidential_level) for r in df.orderBy("rank").collect()]
    assert rows(mine) == rows(one)
    text = context.join_sections(context.build_context(one, 120, 2_000)).first()
    found = questions.contexts(mine, 120, 2_000).first()
    assert (found.context if found else "") == (text.context or "")
    stored = views.images(spark, SF)
    shown = context.order_images(context.images_for_hits(one, stored))
    ids = lambda df: [(r.rank, r.image_id) for r in df.orderBy("rank").collect()]
    assert ids(questions.images(mine, stored)) == ids(shown)


def test_limits_and_no_question(spark, tables, tmp_path):
    chunks, documents, permissions, asked, _ = tables
    index = postings.build(chunks.limit(5), str(tmp_path), parts=1)
    with pytest.raises(ValueError, match="top_k"):
        questions.hybrid_search(chunks, index, documents, permissions, asked, None, 51)
    none = questions.hybrid_search(chunks, index, documents, permissions, asked.where("false"), None, 5)
    assert none.count() == 0 and questions.contexts(none).count() == 0


def test_many_questions_read_the_chunks_once(spark, tables, tmp_path, monkeypatch):
    """The ranking is the same where the keyword leg matches by one automaton."""
    chunks, documents, permissions, asked, hits = tables
    monkeypatch.setattr(postings, "READ_ONCE", 0)
    index = postings.build(chunks, str(tmp_path), parts=8)
    again = questions.hybrid_search(chunks, index, documents, permissions, asked, None, 6, PRINCIPAL, 10)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.final_score, 9)) for r in df.collect())
    assert rows(again) == rows(hits) != []


def test_rows_shuffled_by_the_vector_leg_follow_cores_not_parts(spark, tables):
    """Each task keeps the best of every question: more parts of the chunks must not mean more of them."""
    chunks, _, _, asked, _ = tables
    near = chunks.where("embedding is not null").select("chunk_id", "embedding")
    rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"]) for r in df.collect())
    found = search.vector_search_batch(near.repartition(60), asked, 6)
    tasks = 2 * spark.sparkContext.defaultParallelism
    local, sent = search._search_block(near.repartition(60), asked.where("embedding is not null"), 6, 4096)
    assert f"Coalesce {tasks}" in local._jdf.queryExecution().executedPlan().toString()
    sent.destroy()
    assert rows(found) == rows(search.vector_search_batch(near, asked, 6)) != []


def test_legs_are_ranked_without_content(spark, tables, tmp_path, monkeypatch):
    """Content is fetched for the hits that are left; it went through every step of both legs."""
    chunks, documents, permissions, asked, hits = tables
    index = postings.build(chunks, str(tmp_path), parts=8)
    written = []
    narrow = postings._write
    monkeypatch.setattr(postings, "_write", lambda df, name: written.append(df.columns) or narrow(df, name))
    again = questions.hybrid_search(chunks, index, documents, permissions, asked, None, 6, PRINCIPAL, 10)
    assert again.columns == hits.columns and written and not any({"content", "metadata"} & set(c) for c in written)
    rows = lambda df: sorted((r.query_id, r.context) for r in questions.contexts(df, 120, 2_000).collect())
    assert rows(again) == rows(hits) != []
