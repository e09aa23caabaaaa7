"""The index of cells and codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.operators import codes, search
from corvella.plans import views
from corvella.plans.views import PRINCIPAL, QUERY_VECTOR

TOP = 8


def _as_chunks(df):
    return df.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.concat(F.lit("kb"), F.col("vec_id") % 3).alias("knowledge_base_id"), "embedding")


@pytest.fixture(scope="module")
def vectors(spark):
    return _as_chunks(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return codes.build(vectors, str(tmp_path_factory.mktemp("vectors") / "index"))


def _found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.vector_score, 6)))
    return out


def _queries(vectors):
    return vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def test_recall_of_every_fiftieth_row_with_few_rows_compared(vectors, index):
    """Default probes and rows compared: vectors without clusters, less than a tenth of the rows compared."""
    n = vectors.count()
    assert len(index.centroids) == round(n**0.5)
    assert codes.COMPARED * TOP < 0.1 * n
    exact, found = (_found(f) for f in (search.vector_search_batch(vectors, _queries(vectors), TOP), codes.search_batch(index, _queries(vectors), TOP)))
    hits = sum(len(set(exact[q]) & set(found.get(q, []))) for q in exact)
    assert hits >= 0.9 * TOP * len(exact)
    assert all(found[q][0] == (q, 1.0) for q in exact)


def test_all_cells_and_rows_give_the_exact_result_in_blocks_too(vectors, index, monkeypatch):
    exact = _found(search.vector_search_batch(vectors, _queries(vectors), TOP))
    assert _found(codes.search_batch(index, _queries(vectors), TOP, probes=len(index.centroids), compared=2_000, max_query_bytes=300_000)) == exact


def test_cells_that_are_not_probed_are_not_read(spark, vectors, index):
    near = codes.search_batch(index, vectors.where("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), "embedding"), 3, probes=2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [cell") >= 2
    assert near.orderBy("rank").first().chunk_id == 7
    parts = index.rows(spark).groupBy("cell").count().collect()
    assert sum(r["count"] for r in parts) == vectors.count() and max(r["count"] for r in parts) < 0.2 * vectors.count()


def test_rows_are_added_and_deleted_without_a_new_fit(spark, vectors, tmp_path):
    old, new = vectors.where("chunk_id % 4 > 0"), vectors.where("chunk_id % 4 = 0")
    index = codes.build(old, str(tmp_path / "i"), lists=20)
    asked = vectors.where("chunk_id in (8, 12, 13)").select(F.col("chunk_id").alias("query_id"), "embedding")
    full = {"probes": 20, "compared": 2_000}
    assert _found(codes.search_batch(index, asked, TOP, **full)) == _found(search.vector_search_batch(old, asked, TOP))
    codes.add(index, new)
    assert _found(codes.search_batch(index, asked, TOP, **full)) == _found(search.vector_search_batch(vectors, asked, TOP))
    codes.delete(index, vectors.where("chunk_id % 3 = 1"))
    assert _found(codes.search_batch(index, asked, TOP, **full)) == _found(search.vector_search_batch(vectors.where("chunk_id % 3 != 1"), asked, TOP))


def test_access_rules_and_bases_hold(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    chunks, documents, permissions = views.chunks(spark, sf), views.documents(spark, sf), views.document_permissions(spark, sf)
    index = codes.build(chunks, str(tmp_path / "i"))
    for bases, principal in ((None, PRINCIPAL), (["src0", "src1"], PRINCIPAL), (None, None)):
        scan = search.vector_search(chunks, documents, permissions, QUERY_VECTOR, bases, TOP, principal)
        hits = codes.vector_search(index, documents, permissions, QUERY_VECTOR, bases, TOP, principal, probes=len(index.centroids))
        assert hits.columns == scan.columns
        rows = lambda df: [(r.chunk_id, round(r.vector_score, 6), r.metadata.confidential_level, r.ord) for r in df.orderBy("ord").collect()]
        assert rows(hits) == rows(scan)


def test_odd_rows(spark, tmp_path):
    """Nulls, zero vectors, other lengths, many copies of one vector, ties; a length that is no multiple of a run."""
    rows = [(i, i, "kb", [float(i % 7), 1.0, -2.0, 0.5, i / 50, 1.0]) for i in range(60)] + [(100 + i, 1, None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(40)]
    rows += [(200, 2, "kb", None), (201, 2, "kb", [0.0] * 6), (202, 2, "kb", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, knowledge_base_id string, embedding array<double>").repartition(4)
    index = codes.build(df, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, None), (3, [0.0] * 6)], "query_id int, embedding array<double>")
    found = _found(codes.search_batch(index, asked, 5, probes=len(index.centroids), compared=60))
    assert found[1] == [(100 + i, 1.0) for i in range(5)] and 2 not in found
    assert [s for _, s in found[3]] == [0.0] * 5
    everything = codes.search_batch(index, asked.where("query_id = 1"), 200, probes=len(index.centroids), compared=500)
    assert {r.chunk_id for r in everything.collect()} == {r[0] for r in rows} - {200}
    assert codes.search_batch(index, asked.where("false"), 5).count() == 0
    none = codes.build(df.where("embedding is null"), str(tmp_path / "none"))
    assert codes.search_batch(none, asked, 5).count() == 0


def test_codewords_are_near_what_they_stand_for(vectors, index):
    unit = np.array([r.embedding for r in vectors.collect()])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    error = 0.0
    for k, words in enumerate(index.words):
        part = unit[:, k * codes.SUB : (k + 1) * codes.SUB]
        error += ((part - words[codes._nearest(part, words)]) ** 2).sum()
    assert error / len(unit) < 0.25


def test_best_of_many_queries_in_bounded_memory(monkeypatch):
    """Scores are held by tiles: memory does not grow with the number of queries; copies tie by key wherever they stand."""
    rng = np.random.default_rng(5)
    few = rng.normal(size=(700, 16))
    vectors = np.concatenate([few, few, np.zeros((3, 16))])  # every vector twice
    q = few / np.linalg.norm(few, axis=1, keepdims=True)
    monkeypatch.setattr(search, "_SCORES", 5_000)
    for keys in (rng.permutation(len(vectors)), np.array([f"k{i:04}" for i in rng.permutation(len(vectors))], object)):
        best = search.Nearest(q, 5)
        for at in range(0, len(vectors), 333):
            best.add(keys[at : at + 333], vectors[at : at + 333])
        norms = np.linalg.norm(vectors, axis=1)
        scores = np.array([(vectors * row).sum(axis=1) for row in q]) / np.where(norms > 0, norms, 1)
        query, found, _ = best.rows()
        for i, row in enumerate(scores):
            want = sorted(range(len(vectors)), key=lambda j, row=row: (-round(row[j], 12), keys[j]))[:5]
            assert found[query == i].tolist() == [keys[j] for j in want]


def test_tiles_of_scores_stay_small():
    import tracemalloc

    rng = np.random.default_rng(6)
    q = rng.normal(size=(20_000, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    tracemalloc.start()
    best = search.Nearest(q, 8)
    best.add(np.arange(4_096), rng.normal(size=(4_096, 8)))
    codes._nearest(q, rng.normal(size=(4_096, 8)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # one score of each pair alone has 625 MB
