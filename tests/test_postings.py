import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.functions.vectors import trigrams
from corvella.operators import postings, search
from corvella.plans import views
from corvella.plans.views import PRINCIPAL

SF = "/root/testdata/sf0.001"
PATTERNS = ["da", "e", "mente raarga", "DE la", "%", "_", "a%e", "q_e", "ciónñ", "--", "zzzzqqq", " ", "", None, ". ", "los%", "\\%", "ß", "İ"]


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(t.cache() for t in (views.chunks(spark, SF, 40, 10), views.documents(spark, SF), views.document_permissions(spark, SF)))


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    return postings.build(tables[0], str(tmp_path_factory.mktemp("index")), parts=64)


def _rows(hits):
    return [(r.chunk_id, r.document_id, round(r.keyword_score, 9), r.metadata.title, r.ord) for r in hits.orderBy("ord").collect()]


@pytest.mark.parametrize("principal,top_k", [(PRINCIPAL, 8), (None, 3)])
def test_a_batch_of_queries_equals_the_scan_of_each(spark, tables, index, principal, top_k):
    asked = spark.createDataFrame(list(enumerate(PATTERNS)), "query_id long, query string")
    found = postings.keyword_search_batch(index, asked, *tables[1:], None, top_k, principal).cache()
    for k, pattern in list(enumerate(PATTERNS))[:: 1 if principal else 4]:
        scan = [] if pattern is None else _rows(search.keyword_search(*tables, pattern, None, top_k, principal))
        assert _rows(found.where(F.col("query_id") == k)) == scan, pattern


def test_many_queries_read_the_chunks_once(spark, tables, index, monkeypatch):
    """By one automaton: as by the lists, but of queries without wildcards only matches are candidates."""
    monkeypatch.setattr(postings, "READ_ONCE", 0)
    asked = spark.createDataFrame(list(enumerate(PATTERNS)), "query_id long, query string")
    found = postings.keyword_search_batch(index, asked, *tables[1:], None, 3, None).cache()
    for k, pattern in list(enumerate(PATTERNS)):
        scan = [] if pattern is None else _rows(search.keyword_search(*tables, pattern, None, 3, None))
        assert _rows(found.where(F.col("query_id") == k)) == scan, pattern
    reads: list[dict] = []
    postings.keyword_search_batch(index, spark.createDataFrame([(1, "mente raarga"), (2, "de la")], "query_id long, query string"), *tables[1:], None, 10**6, None, reads).collect()
    said = F.lower("content")
    assert sum(r["candidates"] for r in reads) == sum(tables[0].where(F.contains(said, F.lit(q))).count() for q in ("mente raarga", "de la"))


def test_one_query_within_knowledge_bases(tables, index):
    bases = ["src0", "src3"]
    scan = search.keyword_search(*tables, "er", bases, 5, PRINCIPAL)
    hits = postings.keyword_search(index, *tables[1:], "er", bases, 5, PRINCIPAL)
    assert hits.columns == scan.columns and _rows(hits) == _rows(scan)


def test_every_fiftieth_document_reads_a_small_part(spark, tables, tmp_path):
    """Phrases of documents: few candidates, few parts of the content."""
    chunks, documents, permissions = tables
    index = postings.build(chunks, str(tmp_path), parts=512)
    asked = documents.where("document_id % 50 = 0").select(F.col("document_id").alias("query_id"), F.substring("text", 30, 24).alias("query"))
    reads: list[dict] = []
    found = postings.keyword_search_batch(index, asked, documents, permissions, None, 8, None, reads).cache()
    for r in asked.collect():
        assert _rows(found.where(F.col("query_id") == r.query_id)) == _rows(search.keyword_search(*tables, r.query, None, 8, None))
    assert sum(r["rows_read"] for r in reads) < 0.1 * chunks.count()


def test_a_common_word_stops_before_the_last_band(spark, tables, index):
    """Short chunks are as like the query as any can be: longer ones are not read."""
    extra = tables[0].where("document_id = 0").limit(1)
    short = extra.crossJoin(spark.range(9).select(F.col("id").alias("nth"))).select(*[F.lit("mente").alias("content") if c == "content" else (F.lit(10**9) + F.col("nth")).alias("chunk_id") if c == "chunk_id" else F.col(c) for c in extra.columns])
    grown = postings.build(tables[0].unionByName(short), index.root + "-short", parts=16)
    reads: list[dict] = []
    asked = spark.createDataFrame([(1, "mente")], "query_id int, query string")
    hits = postings.keyword_search_batch(grown, asked, *tables[1:], None, 8, None, reads).collect()
    assert [r.chunk_id for r in hits] == [10**9 + k for k in range(8)] and {r.keyword_score for r in hits} == {1.0}
    assert sum(r["rows_read"] for r in reads) < 0.5 * tables[0].count()


def test_additions_are_found_and_a_repeated_one_of_grams_does_no_harm(spark, tables, tmp_path):
    chunks, documents, permissions = tables
    old, new = chunks.where("document_id % 2 = 0"), chunks.where("document_id % 2 = 1")
    index = postings.build(old, str(tmp_path), parts=8)
    assert _rows(postings.keyword_search(index, documents, permissions, "er", None, 8, None)) == _rows(search.keyword_search(old, documents, permissions, "er", None, 8, None))
    postings.add(index, new)
    again = index.grams(spark).where("gram % 3 = 0").toPandas()
    spark.createDataFrame(again, index.grams(spark).schema).write.mode("append").partitionBy("bucket").parquet(f"{index.root}/grams")
    for said in ("er", "ciónñ"):
        assert _rows(postings.keyword_search(index, documents, permissions, said, None, 8, PRINCIPAL)) == _rows(search.keyword_search(*tables, said, None, 8, PRINCIPAL))


def test_no_chunk_and_no_query(spark, tables, index, tmp_path):
    chunks, documents, permissions = tables
    empty = postings.build(chunks.where("false"), str(tmp_path))
    none = spark.createDataFrame([], "query_id long, query string")
    assert postings.keyword_search_batch(index, none, documents, permissions, None, 8, None).count() == 0
    assert postings.keyword_search(empty, documents, permissions, "a", None, 8, None).count() == 0


@given(st.text(alphabet="ab%_\\éZ", max_size=6), st.text(alphabet="abéZ%_ ", max_size=12))
def test_a_match_has_all_grams_of_the_query(pattern, text):
    like = "".join(".*" if p == "%" else "." if p == "_" else re.escape(p[-1]) for p in re.findall(r"\\.|[^\\]", pattern.rstrip("\\"), re.S))
    if re.search(like, text, re.S):
        assert set(postings.query_grams(pattern.rstrip("\\"))) <= set(postings.gram_keys(text).tolist())


def test_sets_of_padded_words_are_those_of_trigrams(spark):
    """Their sizes are counted, and queries cut, from words laid end to end."""
    said = ["", " ", "a", "ab, a", ". ", "İstanbul ß", "x  y\tz", "ciónñ--9", "  lead", "日本語 \U0001f600q", "a a a", "É_1"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, content string")
    padded = postings._padded(F.lower("content"))
    got = rows.select("k", padded.alias("p"), F.arrow_udf(postings._n_trigrams, "int")(padded).alias("n"), trigrams(F.col("content")).alias("t")).collect()
    assert [(r.n, postings.padded_trigrams(r.p)) for r in got] == [(len(r.t), set(r.t)) for r in got] and len(got) == len(said)


def test_content_is_written_once_and_rounds_keep_ids_alone(spark, tables, tmp_path, monkeypatch):
    """On disk: the index, and narrow tables beside it. Another copy of the content, or one a round, would not fit at scale."""
    monkeypatch.setattr(postings, "READ_ONCE", 0)
    written = []
    narrow = postings._write
    monkeypatch.setattr(postings, "_write", lambda df, name: written.append(df.columns) or narrow(df, name))
    index = postings.build(tables[0], str(tmp_path))
    assert not written and sorted(p.name for p in tmp_path.iterdir()) == ["content", "grams", "ledger", "sizes"]
    asked = spark.createDataFrame([(1, "da"), (2, "mente"), (3, "los%")], "query_id long, query string")
    hits = postings.keyword_search_batch(index, asked, *tables[1:], None, 8, None)
    assert {r.query_id for r in hits.collect()} == {1, 2, 3}
    assert written and not any({"content", "metadata"} & set(c) for c in written)


def test_large_sides_of_joins_are_not_sent_to_all_tasks(spark, tables, index, monkeypatch):
    """However small a table of ids is on disk; the results are the same."""
    asked = spark.createDataFrame([(1, "da"), (2, "e%a")], "query_id long, query string")
    want = [_rows(postings.keyword_search_batch(index, asked, *tables[1:], None, 8, PRINCIPAL).where(F.col("query_id") == k)) for k in (1, 2)]
    monkeypatch.setattr(postings, "SENT_ROWS", 0)
    found = postings.keyword_search_batch(index, asked, *tables[1:], None, 8, PRINCIPAL)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [_rows(found.where(F.col("query_id") == k)) for k in (1, 2)] == want


def test_an_addition_that_was_broken_off_is_not_seen(spark, tables, tmp_path, monkeypatch):
    chunks, documents, permissions = tables
    monkeypatch.setattr(postings, "READ_ONCE", 0)
    index = postings.build(chunks.where("document_id % 2 = 0"), str(tmp_path), parts=8)
    new = chunks.where("document_id % 2 = 1")
    with monkeypatch.context() as m:
        m.setattr(postings, "_lists", lambda content: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            postings.add(index, new)
    assert index.content(spark).where("document_id % 2 = 1").count() == 0
    postings.add(index, new)
    assert _rows(postings.keyword_search(index, documents, permissions, "er", None, 8, None)) == _rows(search.keyword_search(*tables, "er", None, 8, None))


def test_a_task_lets_go_of_all_but_the_best_matches(spark, tables, index, monkeypatch):
    """Matches of a query that asks for many copies: what leaves a task is top_k a query, of readable chunks alone."""
    asked = spark.createDataFrame([(1, "e"), (2, "de"), (3, "e")], "query_id long, query string")
    stored = index.content(spark).where("content is not null").coalesce(1)
    for held, most in ((1_000, 24), (40, None)):
        monkeypatch.setattr(postings, "HELD_MATCHES", held)
        matches, sent = postings._read_once(stored, asked, 8)
        assert most is None or matches.count() <= most < stored.count()
        sent.destroy()
        monkeypatch.setattr(postings, "READ_ONCE", 0)
        found = postings.keyword_search_batch(index, asked, *tables[1:], None, 8, PRINCIPAL).cache()
        for k, said in ((1, "e"), (2, "de"), (3, "e")):
            assert _rows(found.where(F.col("query_id") == k)) == _rows(search.keyword_search(*tables, said, None, 8, PRINCIPAL))
