"""Ranked lexical search of many items over all documents, by sort-based accumulation.

Documents are read once for each block of items: a task keeps of every document how many terms it has and which terms of
the items, how often. When the statistics are known, a task lays the matched (item, document, impact) arrays of many
documents end to end, sorts their packed keys by radix, sums runs of equal keys and keeps each item's best documents in a
heap. The tasks' best are dealt by ranges of item and score, selected again, and ranked.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _spread
from .common import materialize, release_memory, shuffle_width, table, text_chunks

TOP = 10
#: Distinct terms of the items that travel with every task: so many bytes (with what Python adds) at most, or one item.
BLOCK_BYTES, _TERM_COST = 64 << 20, 120
#: Impacts that are sorted together; a document's are never parted.
IMPACTS = 1 << 21
#: Bytes of a text that are split into terms at once.
_SLICE = 1 << 20
#: A-Z become lower case, other ASCII characters that are no letters or digits become spaces; all else is part of terms.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_NO_ID = 1 << 63


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    folded = (text or "").encode("utf-8").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + _SLICE) if len(folded) - at > _SLICE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys: 16 bits a pass, which numpy sorts by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while len(keys) and int(keys.max()) >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term) once each; item is a struct of item_id, so that null is an id too."""
    rows = items.select(F.struct("item_id").alias("item"), "text")
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            own, names = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                found = {t for terms in terms_of(text) for t in terms}
                own += [k] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(own, pa.int64())), pa.array(names, pa.binary())], ["item", "term"])

    return rows.mapInArrow(run, f"item {kind}, term binary").distinct()


class _Block:
    """The terms of a block of items, numbered, and for each the items that have it."""

    def __init__(self, rows: pa.Table):
        self.items = list(dict.fromkeys(x["item_id"] for x in rows.column("item").to_pylist()))
        number = {x: k for k, x in enumerate(self.items)}
        terms = rows.column("term").to_pylist()
        self.index: dict[bytes, int] = {t: k for k, t in enumerate(dict.fromkeys(terms))}
        of_term = np.array([self.index[t] for t in terms], np.int64)
        of_item = np.array([number[x["item_id"]] for x in rows.column("item").to_pylist()], np.int64)
        order = np.lexsort((of_item, of_term))
        self.owners = of_item[order]
        self.counts = np.bincount(of_term, minlength=len(self.index)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1]


def _matched(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms, and of every task and batch a row without n: terms and in how many documents.

    A text is split piece by piece; only its matches are kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.index.get
        for b in text_chunks(batches, 4 << 20):
            ids, ns, terms, tfs = [], [], [], []
            held = np.zeros(len(sent.value.index), np.int64)
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, found = 0, []
                for words in terms_of(text):
                    n += len(words)
                    hits = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    found.append(hits[hits >= 0])
                if n:
                    which, times = np.unique(np.concatenate(found), return_counts=True)
                    held[which] += 1
                    for column, value in ((ids, doc), (ns, n), (terms, which), (tfs, times)):
                        column.append(value)
            there = np.flatnonzero(held)
            for column, value in ((ids, None), (ns, None), (terms, there), (tfs, held[there])):
                column.append(value)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((terms, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        release_memory()

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class _Best:
    """Each item's best documents so far: heaps whose first entry is the worst kept."""

    def __init__(self, n_items: int, top: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.top = top
        self.score, self.doc = np.zeros(n_items, np.int64), np.full(n_items, -1, np.int64)

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """doc: ids, of which the smaller win ties."""
        might = (score > self.score[item]) | ((score == self.score[item]) & (doc < self.doc[item]) & (score > 0))
        item, doc, score = item[might], doc[might], score[might]
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        fresh = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.zeros(0, bool)
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(fresh, np.arange(len(item)), 0)) if len(item) else item
        few = place < self.top
        for i, d, s in zip(item[few].tolist(), doc[few].tolist(), score[few].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.top:
                self.score[i], self.doc[i] = heap[0][0], -heap[0][1]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(i, -d, s) for i, heap in enumerate(self.heaps) for s, d in heap]


def _best_of_tasks(matched: DataFrame, sent, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents of each item, by item number."""
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = sent.value, weights.value
        best = _Best(len(block.items), top)
        for b in batches:
            docs = np.array([last if d is None else d for d in b.column("doc_id").to_pylist()], np.int64)
            n = b.column("n").to_numpy()
            lengths, inverse = np.unique(n, return_inverse=True)
            m = np.array([10 + 90 * x * n_docs // n_terms for x in lengths.tolist()], np.int64)[inverse]
            offsets = b.column("terms").offsets.to_numpy().astype(np.int64)
            terms = b.column("terms").values.to_numpy().astype(np.int64)
            tfs = b.column("tfs").values.to_numpy().astype(np.int64)
            first = int(offsets[0]) if len(offsets) else 0
            fans = np.concatenate([[0], np.cumsum(block.counts[terms[first : int(offsets[-1])]])])[offsets - first]
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(fans, fans[at] + IMPACTS, "right")) - 1)
                t, tf = terms[offsets[at] : offsets[end]], tfs[offsets[at] : offsets[end]]
                local = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
                impact = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at:end][local]))
                times = block.counts[t]
                item = block.owners[_spread(block.starts[t], times)]
                key = item * (end - at) + np.repeat(local, times)
                order = radix_order(key)
                key, impacts = key[order], np.repeat(impact, times)[order]
                if len(key):
                    runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    who, where = np.divmod(key[runs], end - at)
                    best.offer(who, docs[at:end][where], np.add.reduceat(impacts, runs))
                at = end
        out = best.rows()
        if out:
            items, ids, scores = (list(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array([None if d == last else d for d in ids], pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])
        release_memory()

    return matched.where("n is not null").mapInArrow(run, "item int, doc_id long, score long")


def _selected(candidates: DataFrame, top: int) -> DataFrame:
    """The best of every item in each range of items and scores: ranges part an item that many tasks have found."""
    order = [F.col("item"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = candidates.repartitionByRange(shuffle_width(candidates.sparkSession), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for item, doc, score in zip(*(b.column(c).to_pylist() for c in ("item", "doc_id", "score")), strict=True):
                heap = heaps.setdefault(item, [])
                entry = (score, -(_NO_ID if doc is None else doc))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
        out = [(i, None if -d == _NO_ID else -d, s) for i, heap in heaps.items() for s, d in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    ranked = F.row_number().over(Window.partitionBy("item").orderBy(*order[1:]))
    return dealt.mapInArrow(run, "item int, doc_id long, score long").withColumn("rank", ranked).where(F.col("rank") <= top)


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest scores above 0 of every item.

    Equal scores stand by doc_id, null last; rows of documents that agree in all are documents each. Rows of items with
    one id (null is one) are one item: a term counts once. Null or empty texts have no terms; an item without any, or an
    empty table, gives no rows. Items go to the tasks in blocks of bounded size, one pass over the documents each; the
    distinct terms of a single item must fit a task. Only the named columns are read.
    """
    spark = documents.sparkSession
    wanted = materialize(_item_terms(items), "lexical-items")
    size = wanted.agg(F.sum(F.length("term") + _TERM_COST)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    out: DataFrame | None = None
    totals = None
    for k in range(blocks):
        block = _Block(wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow())
        sent = spark.sparkContext.broadcast(block)
        matched = materialize(_matched(documents, sent), "lexical-matches")
        totals = totals or matched.agg(F.count("n"), F.sum("n")).first()
        n_docs, n_terms = totals[0], totals[1] or 0
        pairs = matched.where("n is null").select(F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        held = pairs.groupBy("x.terms").agg(F.sum("x.tfs").alias("df")).toArrow()
        df = np.zeros(len(block.index), np.int64)
        df[held.column("terms").to_numpy()] = held.column("df").to_numpy()
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))
        names = _names(spark, block, wanted)
        found = _selected(_best_of_tasks(matched, sent, weights, n_docs, max(1, n_terms), top), top).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def _names(spark: SparkSession, block: _Block, wanted: DataFrame) -> DataFrame:
    """(item, item_id) of a block, bounded as the block is."""
    kind = wanted.select("item.item_id").schema["item_id"].dataType.simpleString()
    return spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kind}")


def op13_lexical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"

OP13_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT rid, doc_id, terms, len(terms) AS n FROM split WHERE len(terms) > 0),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weighted AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole),
scored AS (
  SELECT a.item_id, c.rid, any_value(s.doc_id) AS doc_id, CAST(sum(t.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * s.n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked a JOIN counted c USING (term) JOIN weighted t USING (term) JOIN sized s USING (rid), whole GROUP BY a.item_id, c.rid
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
