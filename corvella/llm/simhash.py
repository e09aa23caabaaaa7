"""SimHash near-duplicates, found with tables of Hamming distances to reference fingerprints.

Texts become 64-bit fingerprints; equal ones collapse to one class first. Of any division into bit blocks, two
fingerprints that differ in at most 2 bits agree in all blocks but two, so each class is dealt to one key for every
choice of all blocks but two. The more classes there are, the more blocks and the longer the keys: a key keeps few
classes, and the pairs that are looked at grow with the table and not with its square.
Within a key every fingerprint has a row of precomputed distances to the reference fingerprints (pivots); by
the triangle inequality a pair whose rows differ by more than 2 anywhere can't link and is discarded. The
survivors are verified by their exact distance, and each key's links leave as a spanning forest, never as
all pairs. Keys with more classes than ``run_limit`` are linked exactly another way: two fingerprints differ in
at most 2 bits just when they share a fingerprint within 1 bit of both, so grouping by those gives the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, shuffle_width, table, whole_text
from .components import connected_components, one_of_each

SHINGLE_WORDS = 3
MAX_BITS = 2
N_PIVOTS = 16
RUN_LIMIT = 65_536
#: Bits beyond those that number the classes that a key has at least, as far as the numbers of blocks allow.
_SPARE_BITS = 1
_BLOCKS = (3, 4, 5, 6)
_PIVOTS = np.random.default_rng(20_240_901).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)
_SHORT = 24  # runs up to this length are compared by shifts, all runs at once


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        part = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every whole text as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    return map_texts(rows, run, f"doc_id {kind}, text_hash long, fp long")


def block_keys(n_classes: int) -> list[list[tuple[int, int]]]:
    """For every key the blocks (lowest bit, bits) it consists of: all but MAX_BITS of the least number of blocks that gives keys long enough."""
    for n in _BLOCKS:
        edges = [64 * k // n for k in range(n + 1)]
        blocks = [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]
        keys = [list(c) for c in combinations(blocks, n - MAX_BITS)]
        if min(sum(bits for _, bits in key) for key in keys) >= n_classes.bit_length() + _SPARE_BITS:
            break
    return keys


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Row per fingerprint, column per pivot: their Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ _PIVOTS[None, :]).astype(np.int8)


def _survivors(fps: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those that no pivot discards and whose own distance is small enough."""
    for k in range(0, N_PIVOTS, 4):
        near = (np.abs(rows[i, k : k + 4] - rows[j, k : k + 4]) <= MAX_BITS).all(axis=1)
        i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
    return i[near], j[near]


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the trees of i and j in place; parent always points at roots."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]


def _long_run(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps, by a band over the sorted first pivot distance."""
    rows = pivot_distances(fps)
    order = np.argsort(rows[:, 0], kind="stable")
    fps, rows = fps[order], rows[order]
    first = rows[:, 0].astype(np.int64)
    parent = np.arange(len(fps))
    step = max(1, (1 << 21) // len(fps))
    for at in range(0, len(fps), step):
        end = min(at + step, len(fps))
        stop = int(np.searchsorted(first, first[end - 1] + MAX_BITS, "right"))
        near = np.ones((end - at, stop - at), bool)
        for k in range(4):
            near &= np.abs(rows[at:end, k, None] - rows[None, at:stop, k]) <= MAX_BITS
        i, j = np.nonzero(np.triu(near, 1))
        _hook(parent, *_survivors(fps, rows, i + at, j + at))
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[child], fps[parent[child]]


def _short_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links within equal keys of a sorted array whose runs are short."""
    rows, left, right = pivot_distances(fps), [], []
    for shift in range(1, _SHORT):
        i = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(i):
            break
        i, j = _survivors(fps, rows, i, i + shift)
        left.append(fps[i])
        right.append(fps[j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(limit: int):
    """Edges (a, b) of every key's run; of a run over the limit, rows (fp, null)."""

    def batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], ["a", "b"])

    def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs, sorted by key."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        lens = np.diff(np.concatenate([starts, [len(keys)]]))
        for s, n in zip(starts[lens > _SHORT].tolist(), lens[lens > _SHORT].tolist(), strict=True):
            yield batch(*_long_run(fps[s : s + n]))
        few = np.repeat((lens > 1) & (lens <= _SHORT), lens)
        if few.any():
            yield batch(*_short_runs(keys[few], fps[few]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            k, f = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            if over is not None:  # the rest of a run that is over the limit
                same = k == over
                if same.any():
                    yield batch(f[same], None)
                k, f = k[~same], f[~same]
            if not len(k):
                continue
            over = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            yield from close(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > limit:
                yield batch(fps, None)
                over, keys, fps = keys[0], keys[:0], fps[:0]
        yield from close(keys, fps)

    return run


def link_fingerprints(classes: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most 2 bits connect; classes: distinct column fp."""
    spark = classes.sparkSession
    width = shuffle_width(spark)
    keys = []
    for k, blocks in enumerate(block_keys(classes.count())):
        key = F.lit(k).cast("long")
        for low, bits in blocks:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        keys.append(key)
    dealt = classes.select("fp", F.explode(F.array(*keys)).alias("key"))
    runs = dealt.repartition(width, "key").sortWithinPartitions("key").select("key", "fp")
    found = materialize(runs.mapInArrow(_links(run_limit), "a long, b long"), "simhash-links")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)))
    near = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("via"))
    via = near.groupBy("via").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("via", "b")
    rest = near.join(via, "via").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    return found.where("b is not null").unionByName(rest)


def _components(docs: DataFrame, run_limit: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row; root is the component's least fingerprint."""
    prints = materialize(fingerprints(docs), "simhash-fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(link_fingerprints(classes.select("fp"), run_limit), "simhash-cc")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(component, "root").select("fp", "root", "component_id")
    return prints.join(by_class, "fp")


def near_duplicates(docs: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id among all documents reachable over links of at most 2 bits. Null, empty and
    blank texts have fingerprint zero and link like any other. Repeated rows come back as often as they stand.
    Null ids get the least known id of their component (null if it has none). Columns beyond doc_id and text
    are not read.
    """
    return _components(docs, run_limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, run_limit: int = RUN_LIMIT, percent: int | None = None) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row of its least id stays.

    Texts link by their fingerprints or, with ``percent``, if their sets of five-word shingles have at least that Jaccard
    similarity: links of fingerprints are compared exactly first, then, since texts 80 % alike may differ in some ten bits,
    what other candidates ``nearcopies`` finds between the components they leave. Of several rows with the least id the one whose text hashes
    lowest stays; a component without any id keeps the one row of all whose text hashes lowest. Of rows repeated in
    full one stays. Null and empty texts are copies of each other. All columns are returned, whatever their names.
    """
    if percent is None:
        return one_of_each(docs, _components(docs, run_limit))
    from . import nearcopies  # it takes its links of fingerprints from here

    return one_of_each(docs, nearcopies.components_of(docs, percent=percent, run_limit=run_limit))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
