"""The cell index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.operators import cells, search

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")


@pytest.fixture(scope="module")
def centroids(vectors):
    return cells.fit_centroids(vectors)


def test_every_row_is_indexed_by_its_nearest_centroid(vectors, centroids):
    assert len(centroids) == cells.LISTS
    rows = cells.with_cells(vectors, centroids).collect()
    assert len(rows) == vectors.count()
    assert all(r.cell == int(np.argmax(centroids @ np.array(r.embedding))) for r in rows)


def test_recall_of_every_fiftieth_row(vectors, centroids):
    """Top 8 of the probed cells, against the top 8 of all rows."""
    rows = cells.with_cells(vectors, centroids).collect()
    data, ids, cell = np.array([r.embedding for r in rows]), np.array([r.chunk_id for r in rows]), np.array([r.cell for r in rows])
    queries = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact: dict = {}
    for r in search.vector_search_batch(vectors, queries, 8).collect():
        exact.setdefault(r.query_id, set()).add(r.chunk_id)
    found = 0
    for q, want in exact.items():
        v = data[ids == q][0]
        inside = np.isin(cell, cells.probed(centroids, v))
        scores = (data[inside] @ v) / np.linalg.norm(data[inside], axis=1)
        found += len(want & set(ids[inside][np.argsort(-scores)[:8]].tolist()))
    recall = found / (8 * len(exact))
    assert recall >= 0.9, recall


def test_a_search_skips_the_other_cells_files(spark, vectors, centroids, tmp_path):
    cells.with_cells(vectors, centroids).write.partitionBy("cell").parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index")).withColumn("document_id", F.lit(1)).withColumn("knowledge_base_id", F.lit("kb")).withColumn("content", F.lit("")).withColumn("confidential_level", F.lit("public")).withColumn("metadata", F.struct(F.lit(1).alias("page_start")))
    documents = spark.createDataFrame([(1, "ready", "public", None)], "document_id int, status string, confidential_level string, department string")
    grants = spark.createDataFrame([], "document_id int, subject_type string, subject_value string, permission string")
    query = list(vectors.where("chunk_id = 7").first().embedding)
    near = cells.cell_search(stored, centroids, documents, grants, query, None, 5, None, probes=3)
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString()
    assert near.orderBy("ord").first().chunk_id == 7
    whole = cells.cell_search(stored, centroids, documents, grants, query, None, 5, None, probes=cells.LISTS)
    exact = search.vector_search(stored, documents, grants, query, None, 5, None)
    assert [r.chunk_id for r in whole.orderBy("ord").collect()] == [r.chunk_id for r in exact.orderBy("ord").collect()]


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, -2.0]), (4, [0.0, -2.0])], "chunk_id long, embedding array<double>")
    centroids = cells.fit_centroids(rows, lists=2)
    got = sorted((r.chunk_id, r.cell is None, r.cell == cells.NO_CELL) for r in cells.with_cells(rows, centroids).collect())
    assert got == [(1, False, True), (2, True, False), (3, False, False), (4, False, False), (4, False, False)]
    none = cells.fit_centroids(rows.where("chunk_id = 2"))
    assert len(none) == 0 and cells.probed(none, [1.0]) == [cells.NO_CELL]
    assert [r.cell for r in cells.with_cells(rows.where("chunk_id = 1"), none).collect()] == [cells.NO_CELL]


def test_query_vectors_beyond_the_bound_go_in_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist() if i % 7 else None) for i in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 5 = 0").selectExpr("chunk_id AS query_id", "embedding")
    plain = sorted(map(tuple, search.vector_search_batch(vectors, queries, 4).collect()))
    blocks = sorted(map(tuple, search.vector_search_batch(vectors, queries, 4, max_query_bytes=600).collect()))
    assert [r[:2] + r[3:] for r in plain] == [r[:2] + r[3:] for r in blocks] and len(plain) > 100
    assert search.vector_search_batch(vectors, queries.where("query_id < 0"), 4).count() == 0
