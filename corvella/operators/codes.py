"""A vector index of cells and product codes: scan a few bytes a row, compare few rows exactly.

Every vector belongs to the cell of its nearest centroid and has a code: for each run of SUB numbers the nearest of 256
codewords. A search looks at the codes of the cells it probes, keeps the most promising rows and compares only those
exactly. Centroids and codewords are fitted together by Lloyd rounds, one Spark job each over a bounded sample; every row
is indexed. Tables are laid out by cell, so cells that are not probed are not read. Rows can be added and deleted later
without another fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.principal import Principal
from .cells import NO_CELL
from .search import MAX_QUERY_BYTES, in_bases
from .security import retrieval_filter

#: Numbers a byte of code stands for, and codewords of a byte.
SUB, WORDS = 4, 256
#: Centroids, the square root of the rows, travel with tasks: so many bytes at most.
CENTROID_BYTES = 64 << 20
#: Rows the fit looks at, taken by the lowest hashes of their ids, and its rounds.
SAMPLE_ROWS, ROUNDS = 65_536, 8
#: The share of cells a search probes, and how many rows for each wanted one are compared exactly (fewer of a small table).
#: Vectors without any clusters need most cells; the codes of a row are a sixteenth of its numbers.
PROBE_SHARE, COMPARED = 0.8, 16
#: Scores of queries, and distances to centers, that a task holds at once.
_SCORES, _DISTANCES = 1 << 22, 1 << 20


@dataclass(frozen=True)
class VectorIndex:
    """``root``/codes (chunk_id, document_id, knowledge_base_id, code, cell), ``root``/rows (whole chunks), ``root``/deleted (chunk_id)."""

    root: str
    centroids: np.ndarray = field(repr=False)
    words: np.ndarray = field(repr=False)
    schema: StructType

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.root}/rows")

    def codes(self, spark: SparkSession) -> DataFrame:
        """Codes of what is not deleted."""
        kinds = {c: self.schema[c].dataType.simpleString() for c in ("chunk_id", "document_id", "knowledge_base_id")}
        all_codes = spark.read.schema(", ".join(f"{c} {k}" for c, k in kinds.items()) + ", code binary, cell int").parquet(f"{self.root}/codes")
        gone = spark.read.schema(f"chunk_id {kinds['chunk_id']}").parquet(f"{self.root}/deleted")
        return all_codes.join(gone, "chunk_id", "left_anti")


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a column without nulls; vectors of another length or with nulls count as zero."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        if len(v) == dim and None not in v:
            out[i] = v
    return _unit(out)


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of each point's nearest center; _DISTANCES at once, since centers grow with the rows."""
    length, step = (centers * centers).sum(axis=1), max(1, _DISTANCES // len(centers))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(length - 2 * points[at : at + step] @ centers.T, axis=1) for at in range(0, len(points), step))])


def _round(sample: DataFrame, books: list[tuple[int, np.ndarray]], dim: int) -> list[tuple[int, np.ndarray]]:
    """One Lloyd round for all books (first number, centers): tasks sum up what is nearest, sums of one center meet."""
    sent = sample.sparkSession.sparkContext.broadcast(books)
    schema = "book int, center int, total array<double>, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros_like(c), np.zeros(len(c), np.int64)) for _, c in sent.value]
        for b in batches:
            points = _matrix(b.column("embedding"), dim)
            points = points[points.any(axis=1)]
            for (at, centers), (total, n) in zip(sent.value, sums, strict=True):
                part = points[:, at : at + centers.shape[1]]
                own = _nearest(part, centers)
                np.add.at(total, own, part)
                n += np.bincount(own, minlength=len(centers))
        for book, (total, n) in enumerate(sums):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), book, np.int32)), pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64())), pa.array(n[used])], ["book", "center", "total", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for book, center, total, n in zip(*(b.column(c).to_pylist() for c in ("book", "center", "total", "n")), strict=True):
                held = sums.setdefault((book, center), [np.zeros(len(total)), 0])
                held[0] += total
                held[1] += n
        for (book, center), (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([book], pa.int32()), pa.array([center], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["book", "center", "total", "n"])

    summed = sample.mapInArrow(run, schema).repartition("book", "center").mapInArrow(add, schema).toArrow()
    new = [(at, c.copy()) for at, c in books]
    for book, center, total, n in zip(*(summed.column(c).to_pylist() for c in ("book", "center", "total", "n")), strict=True):
        new[book][1][center] = np.array(total) / n
    sent.destroy()
    return [(0, _unit(new[0][1])), *new[1:]]


def fit(chunks: DataFrame, lists: int | None = None, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, codewords by run of numbers) of chunks (chunk_id, embedding).

    ``lists`` follows the square root of the rows. Fewer different vectors give fewer centers; no vector gives one of zeros.
    The length of vectors is that of the first ids by hash; the last run may be shorter, filled up with zeros.
    """
    there = chunks.where("embedding is not null").select("chunk_id", "embedding", F.xxhash64("chunk_id").alias("h"))
    n = there.count()
    first = there.orderBy("h", "chunk_id").limit(1).first()
    dim = max(1, len(first.embedding)) if first else 1
    lists = lists or max(1, min(round(n**0.5), CENTROID_BYTES // (8 * dim)))
    share = min(1.0, 1.1 * sample_rows / max(n, 1))
    some = there if share == 1.0 else there.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
    sample = some.select("embedding", "h")
    start = _matrix(sample.orderBy("h").limit(max(lists, WORDS)).toArrow().column("embedding").combine_chunks(), dim) if n else np.zeros((0, dim))
    start = start[np.sort(np.unique(start, axis=0, return_index=True)[1])] if len(start) else np.zeros((1, dim))
    books = [(0, start[:lists])] + [(at, start[:WORDS, at : at + SUB].copy()) for at in range(0, dim, SUB)]
    for _ in range(rounds if n else 0):
        books = _round(sample, books, dim)
    words = np.zeros((len(books) - 1, WORDS, SUB))
    for k, (_, centers) in enumerate(books[1:]):
        words[k, : len(centers), : centers.shape[1]] = centers
        words[k, len(centers) :] = words[k, 0]
    return books[0][1], words


def _coded(chunks: DataFrame, centroids: np.ndarray, words: np.ndarray) -> DataFrame:
    """(chunk_id, document_id, knowledge_base_id, code, cell); vectors without direction are in NO_CELL."""
    rows = chunks.select("chunk_id", "document_id", "knowledge_base_id", "embedding")
    sent = chunks.sparkSession.sparkContext.broadcast((centroids, words))
    out = rows.select("chunk_id", "document_id", "knowledge_base_id", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("int").alias("cell")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = sent.value
        for b in batches:
            points = _matrix(b.column("embedding"), centers.shape[1])
            step = max(1, _DISTANCES // len(centers))
            best = np.concatenate([np.zeros(0, np.int64), *(np.argmax(points[at : at + step] @ centers.T, axis=1) for at in range(0, len(points), step))])
            cell = np.where(points.any(axis=1), best, NO_CELL)
            padded = np.pad(points, ((0, 0), (0, len(books) * SUB - points.shape[1])))
            code = np.stack([_nearest(padded[:, k * SUB : (k + 1) * SUB], w) for k, w in enumerate(books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], out.names)

    return rows.mapInArrow(run, out)


def build(chunks: DataFrame, root: str, lists: int | None = None) -> VectorIndex:
    """Fit, and write an index of chunks (chunk_id, document_id, knowledge_base_id, embedding and any others) under a shared folder."""
    centroids, words = fit(chunks, lists)
    schema = chunks.where("embedding is not null").withColumn("cell", F.lit(0)).schema
    index = VectorIndex(root.rstrip("/"), centroids, words, schema)
    delete(index, chunks.select("chunk_id").limit(0))
    add(index, chunks)
    return index


def add(index: VectorIndex, chunks: DataFrame) -> None:
    """Append chunks with new ids. Rows without an embedding are left out. Codes come last: until then nothing finds the rows."""
    there = chunks.where("embedding is not null")
    spark = chunks.sparkSession
    coded = _coded(there, index.centroids, index.words)
    placed = there.join(coded.select("chunk_id", "cell"), "chunk_id").select(*index.schema.names)
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("cell", "chunk_id").write.mode("append").partitionBy("cell").parquet(f"{index.root}/rows")
    coded.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("cell", "chunk_id").write.mode("append").partitionBy("cell").parquet(f"{index.root}/codes")
    spark.catalog.refreshByPath(index.root)


def delete(index: VectorIndex, ids: DataFrame) -> None:
    """Chunks (chunk_id) that no search finds any more; their ids may not be used again."""
    ids.select("chunk_id").write.mode("append").parquet(f"{index.root}/deleted")


def probes_of(index: VectorIndex, share: float = PROBE_SHARE) -> int:
    return max(1, round(share * len(index.centroids)))


def search_batch(index: VectorIndex, queries: DataFrame, top_k: int, allowed: DataFrame | None = None, kb_ids: Sequence[str] | None = None, probes: int | None = None, compared: int | None = None, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, vector_score, rank) of the nearest rows of many queries (query_id, embedding).

    ``allowed``: document ids that may be found. ``compared``: rows a query is compared with exactly, COMPARED times
    ``top_k`` if not given, of a table below that size a twelfth, four times ``top_k`` at least. Queries without an
    embedding find nothing; fewer than ``top_k`` rows may come back. Blocks of queries of bounded size go to the tasks.
    """
    spark = queries.sparkSession
    codes = index.codes(spark).where(in_bases(kb_ids))
    if allowed is not None:
        codes = codes.join(allowed.select("document_id"), "document_id", "left_semi")
    compared = compared or min(COMPARED * top_k, max(4 * top_k, codes.count() // 12))
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    per_query = 8 * (index.dim + len(index.words) * WORDS)
    blocks = max(1, -(-asked.count() * per_query // max_query_bytes))
    out: DataFrame | None = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        found = _search_block(index, part, codes, top_k, probes or probes_of(index), compared)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(index: VectorIndex, asked: DataFrame, codes: DataFrame, top_k: int, probes: int, compared: int) -> DataFrame:
    spark = asked.sparkSession
    table = asked.toArrow()
    ids = table.column("query_id").to_pylist()
    q = _matrix(table.column("embedding").combine_chunks(), index.dim) if ids else np.zeros((0, index.dim))
    near = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")[:, :probes]
    wanted = np.zeros((len(ids), len(index.centroids) + 1), bool)  # the last is NO_CELL
    np.put_along_axis(wanted, near, True, axis=1)
    wanted[:, NO_CELL] = True
    cells = [*np.flatnonzero(wanted[:, :-1].any(axis=0)).tolist(), NO_CELL]
    sent = spark.sparkContext.broadcast((ids, q, wanted))
    words = spark.sparkContext.broadcast(index.words)
    query_kind, key = asked.schema["query_id"].dataType.simpleString(), index.schema["chunk_id"].dataType.simpleString()

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, probed = sent.value
        books = words.value
        padded = np.pad(vectors, ((0, 0), (0, len(books) * SUB - vectors.shape[1]))).reshape(len(names), len(books), SUB)
        tables = np.einsum("qks,kws->qkw", padded, books)
        best: list[list[tuple]] = [[] for _ in names]
        step = max(1, _SCORES // max(1, len(names)))
        for whole in batches if names else ():
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                keys, cell = b.column("chunk_id").to_pylist(), b.column("cell").to_numpy()
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(keys), len(books))
                scores = np.zeros((len(names), len(keys)))
                for k in range(len(books)):
                    scores += tables[:, k, code[:, k]]
                scores[:, cell == NO_CELL] = 0.0
                scores = np.where(probed[:, cell], np.round(scores, 9), -np.inf)
                for i, row in enumerate(scores):
                    edge = best[i][-1][0] if len(best[i]) == compared else np.inf
                    if len(row) > compared:
                        edge = min(edge, -np.partition(row, len(row) - compared)[len(row) - compared])
                    fresh = np.flatnonzero((-row <= edge) & (row > -np.inf))
                    if len(fresh):
                        best[i] = sorted([*best[i], *((-float(row[j]), keys[j], int(cell[j])) for j in fresh)])[:compared]
        out = [(name, k, c, -s) for name, b in zip(names, best, strict=True) for s, k, c in b]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query_id", "chunk_id", "cell", "score"]).cast(pa.schema([("query_id", table.schema.field("query_id").type), ("chunk_id", whole.schema.field("chunk_id").type), ("cell", pa.int32()), ("score", pa.float64())]))

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    local = codes.where(F.col("cell").isin(cells)).select("chunk_id", "code", "cell").mapInArrow(promising, f"query_id {query_kind}, chunk_id {key}, cell int, score double")
    candidates = local.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= compared).select("query_id", "chunk_id", "cell")
    rows = index.rows(spark).where(F.col("cell").isin(cells)).select("cell", "chunk_id", "embedding")
    pairs = rows.join(candidates, ["cell", "chunk_id"]).select("query_id", "chunk_id", "embedding")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, _ = sent.value
        number = {name: k for k, name in enumerate(names)}
        for b in batches:
            points = _matrix(b.column("embedding"), vectors.shape[1])
            own = vectors[[number[x] for x in b.column("query_id").to_pylist()]]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("chunk_id"), pa.array((points * own).sum(axis=1))], ["query_id", "chunk_id", "vector_score"])

    scored = pairs.mapInArrow(exact, f"query_id {query_kind}, chunk_id {key}, vector_score double")
    best = Window.partitionBy("query_id").orderBy(F.col("vector_score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def vector_search(index: VectorIndex, documents: DataFrame, permissions: DataFrame, query: Sequence[float], kb_ids: Sequence[str] | None, top_k: int, principal: Principal | None, probes: int | None = None) -> DataFrame:
    """``search.vector_search`` by the index: rows may be missed, what is found has its exact score."""
    spark = documents.sparkSession
    allowed = retrieval_filter(documents.where("status = 'ready'"), permissions, principal)
    asked = spark.createDataFrame([(0, [round(float(v), 8) for v in query])], "query_id int, embedding array<double>")
    found = search_batch(index, asked, top_k, allowed, kb_ids, probes).select("chunk_id", "vector_score", F.col("rank").alias("ord"))
    rows = index.rows(spark).withColumn("metadata", F.struct("metadata.*", "confidential_level"))
    score = F.col("vector_score")
    return rows.join(found, "chunk_id").select("chunk_id", "document_id", "content", "vector_score", F.lit(0.0).alias("keyword_score"), score.alias("final_score"), "metadata", "ord")
