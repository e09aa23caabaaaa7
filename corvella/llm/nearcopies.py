"""Near copies by exact Jaccard similarity of word shingles, found by fingerprints and then by prefix filtering.

Every set of shingles has a 64-bit fingerprint. Those of 2 differing bits or fewer link as in ``simhash``, by tables of
distances to pivots over runs of equal bit blocks; what the links join is compared by whole sets and contracted to
components. Similar sets may be further apart than that, so prefix filtering looks for the pairs between components.

Two sets of shingles with similarity t share at least t times the larger one's size. So in any common order of all
shingles each set may be cut to its first n - ceil(t n) + 1 shingles, and two similar sets still have one of them in
common. The order puts shingles that a sample shows to be common last; it decides how many candidates there are, never
which pairs are found. Candidates pass a bound on the sets' difference (the Hamming distance of bitmaps in which every
shingle flips one bit never exceeds it; longer texts have longer bitmaps, folded to compare) and are then compared by
their whole sets. Equal sets collapse first. Keys with more than ``crowd`` sets first link their sets to a few centres;
only pairs that these links leave apart are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, hash_filter, map_texts, materialize, passes, shuffle_width, whole_text
from .components import connected_components, one_of_each

SHINGLE_WORDS = 5
SIMILARITY = 80  # per cent
CROWD = 8
SAMPLE = 2_000  # texts whose shingles are counted for the order
COMMON = 100_000  # common shingles at most; more would only order the rest better
_BITS = 1_024


def shingles(text: str, words_per_shingle: int = SHINGLE_WORDS) -> set[bytes]:
    """The shingles of one whole text; a shorter text is one shingle, a blank one has none."""
    words = text.encode("utf-8").lower().split()
    if len(words) <= words_per_shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False)))


def similar(a: set[bytes], b: set[bytes], percent: int = SIMILARITY) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _hashes(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles."""
    found = shingles(text, width)
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in found), np.uint64, len(found)))


def _bitmap(hashes: np.ndarray) -> bytes:
    size = max(_BITS, min(1 << len(hashes).bit_length(), 64 * _BITS))
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that several texts of a sample have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_hashes(t, width) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    total = rows.count()
    part = rows if total <= SAMPLE else rows.where(F.pmod(F.xxhash64("text_hash"), F.lit(1 << 30)) < F.lit(int((1 << 30) * SAMPLE / total)))
    counts = map_texts(part, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _prints(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, id, n, bits, fp, prefix) of every row; id names the set of shingles, n is its size, fp its fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    known, counts = _common(rows, width)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, bits, fps, prefixes = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            h = _hashes(text, width)
            n = len(h)
            ids.append(xxhash.xxh64_intdigest(h.tobytes(), 11))
            sizes.append(n)
            bits.append(_bitmap(h))
            fps.append(simhash.majority(h))
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                seen = np.where(known[at] == h, counts[at], 0)
                h = h[np.argsort(seen, kind="stable")]
            prefixes.append(h[: n + 1 - -(-percent * n // 100) if n else 0].view(np.int64))
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "id", "n", "bits", "fp", "prefix"])

    return map_texts(rows, run, f"doc_id {kind}, text_hash long, id long, n int, bits binary, fp long, prefix array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole runs of a sorted key, many runs at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if cut or (held and held[-1].column("key")[-1].as_py() != keys[-1]):
            whole = pa.Table.from_batches([*held, b.slice(0, cut)])
            yield {c: whole.column(c).to_numpy() for c in whole.column_names}
            held = []
        held.append(b.slice(cut))
    if held:
        whole = pa.Table.from_batches(held)
        yield {c: whole.column(c).to_numpy() for c in whole.column_names}


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.concatenate([starts[1:], [len(keys)]])
    many = ends - starts > 1
    return zip(starts[many].tolist(), ends[many].tolist(), strict=True)


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _first(crowd: int, percent: int):
    """Candidate pairs (a, b) of every key; of crowded keys links to centres, and rows (key, null) besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            keys, ids, sizes = part["key"], part["id"], part["n"].astype(np.int64)
            left, right, full = [], [], []
            once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])  # equal sets count once
            keys, ids, sizes = keys[once], ids[once], sizes[once]
            for start, end in _bounds(keys):
                i, n = ids[start:end], sizes[start:end]
                if end - start <= crowd:
                    x, y = np.triu_indices(end - start, 1)
                    near = _fits(n[x], n[y], percent)
                    left.append(i[x[near]])
                    right.append(i[y[near]])
                    continue
                full.append(keys[start])
                while len(i):  # rows are sorted by id, so most keys of a group have the same centre
                    near = _fits(n, n[0], percent)
                    left.append(np.full(int(near.sum()) - 1, i[0]))
                    right.append(i[near][1:])
                    i, n = i[~near], n[~near]
            pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(full, np.int64)), pa.nulls(len(full), pa.int64())], ["a", "b"])

    return run


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap at a smaller number of bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _apart(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


def _may(apart: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets so far apart at least, of these sizes (added up), can be similar: |A - B| + |B - A| <= (1 - t) / (1 + t) (|A| + |B|)."""
    return (100 + percent) * apart <= (100 - percent) * total


def _second(percent: int):
    """Candidate pairs of crowded keys whose sets are still in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            for start, end in _bounds(part["key"]):
                order = start + np.argsort(part["n"][start:end], kind="stable")
                ids, n, root = part["id"][order], part["n"][order].astype(np.int64), part["root"][order]
                if (root == root[0]).all():
                    continue
                bits = np.stack([_folded(x, _BITS // 8) for x in part["bits"][order]])
                stops = np.searchsorted(percent * n, 100 * n, "right")
                for at in range(len(n) - 1):
                    for low in range(at + 1, int(stops[at]), 1 << 16):
                        y = np.arange(low, min(low + (1 << 16), int(stops[at])))
                        y = y[root[y] != root[at]]
                        y = y[_may(np.bitwise_count(bits[y] ^ bits[at]).sum(axis=1, dtype=np.int64), n[y] + n[at], percent)]
                        if len(y):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[y], ids[at])), pa.array(np.maximum(ids[y], ids[at]))], ["a", "b"])

    return run


def _verified(docs: DataFrame, prints: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets of shingles are similar."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([_apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)], np.int64)
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_may(apart, total, percent)))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True)
        return batch.select(["a", "b"]).filter(pa.array([similar(shingles(x, width), shingles(y, width), percent) for x, y in texts], pa.bool_()))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    left = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bound, "a long, b long"), "near-pairs")
    ends = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    one = prints.join(ends, "id").groupBy("id").agg(F.min(F.struct("text_hash", "doc_id")).alias("_row")).select("id", "_row.*")
    one = materialize(one, "near-ends")
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(one, "text_hash"))

    def among(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(passes(bits.value, batch.column("_hash").to_numpy())))

    # Only texts that may be wanted are moved.
    held = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(whole_text()).alias("_hash"), whole_text().alias("text"))
    held = map_texts(held, among, held.schema)
    texts = held.join(one, (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("id", "text").dropDuplicates(["id"])
    texts = materialize(texts, "near-texts")
    both = left.join(texts.withColumnRenamed("id", "a"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    out = materialize(map_texts(both.select("a", "b", "text", "other"), compare, "a long, b long"), "near-links")
    for done in (left, one, texts):
        discard(done)
    return out


def _keyed(prints: DataFrame) -> DataFrame:
    """(id, n, key) for every prefix shingle that sets of several ids have; some others pass as well."""
    keys = prints.select("id", F.explode("prefix").alias("key"))
    repeated = keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    bits = prints.sparkSession.sparkContext.broadcast(hash_filter(repeated, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            key = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            keep = passes(bits.value, key)
            row = row[keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(key[keep])], ["id", "n", "key"])

    return materialize(prints.select("id", "n", "prefix").mapInArrow(run, "id long, n int, key long"), "near-keys")


def _by_fingerprint(sets: DataFrame, run_limit: int) -> DataFrame:
    """Candidate pairs (a, b): the first set of every fingerprint with its others, and with those of linked fingerprints."""
    classes = sets.groupBy("fp").agg(F.min("id").alias("lead"))
    same = sets.join(classes, "fp").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = simhash.link_fingerprints(classes.select("fp"), run_limit).select(F.col("a").alias("x"), F.col("b").alias("y"))
    lead = lambda fp, name: classes.select(F.col("fp").alias(fp), F.col("lead").alias(name))
    other = links.join(lead("x", "a"), "x").join(lead("y", "b"), "y").select("a", "b")
    pairs = same.unionByName(other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(pairs, "near-fingerprints")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    end = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    known = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return known.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def components_of(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY, crowd: int = CROWD, run_limit: int = simhash.RUN_LIMIT) -> DataFrame:
    """(doc_id, text_hash, root, component_id) of every row; root is the component's least set."""
    spark = docs.sparkSession
    prints = materialize(_prints(docs, width, percent), "near-prints")
    keyed = _keyed(prints)
    sets = prints.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp"))
    sets = materialize(sets, "near-sets")
    slim = materialize(prints.select("doc_id", "text_hash", "id"), "near-rows")
    discard(prints)
    links = _verified(docs, slim, sets, _by_fingerprint(sets, run_limit), width, percent)
    roots = connected_components(links, "near-cc")
    dealt = keyed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "id").select("key", "id", "n")
    found = materialize(dealt.mapInArrow(_first(crowd, percent), "a long, b long"), "near-first")
    links = links.unionByName(_verified(docs, slim, sets, _between(found.where("b is not null").distinct(), roots), width, percent))
    roots = connected_components(links, "near-cc")
    crowded = found.where("b is null").select(F.col("a").alias("key")).distinct()
    if not crowded.isEmpty():
        rooted = sets.join(roots, F.col("id") == F.col("node"), "left").select("id", "n", "bits", F.coalesce("root", "id").alias("root"))
        rows = keyed.select("key", "id").join(crowded, "key", "left_semi").distinct().join(rooted, "id")
        rows = rows.repartition(shuffle_width(spark), "key").sortWithinPartitions("key").select("key", "id", "n", "bits", "root")
        rest = materialize(rows.mapInArrow(_second(percent), "a long, b long"), "near-second").distinct()
        more = _verified(docs, slim, sets, rest, width, percent)
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more), "near-cc")
    rooted = sets.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = materialize(slim.join(rooted.join(component, "root").select("id", "root", "component_id"), "id"), "near-components")
    for done in (keyed, sets, slim, roots):
        discard(done)
    return out


def keep_one(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, percent: int = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """The rows of docs without near copies: of each component one row of its least id stays.

    A component is what is reachable over pairs of texts whose sets of shingles have at least this Jaccard similarity.
    Ties, null ids and repeated rows are settled as by ``simhash.keep_one``. All columns are returned.
    """
    return one_of_each(docs, components_of(docs, words_per_shingle, percent, crowd))
