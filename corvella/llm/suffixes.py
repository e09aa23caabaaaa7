"""Exact removal of repeated passages with suffix arrays built by linear grouping.

A text of N bytes is far too long for one suffix array, so passages that can repeat are brought together first:
every window of ``length`` bytes picks the byte gram in it that hashes lowest (of ties the last), so two equal
windows pick equal grams at equal places. Grams that occur once settle their windows: those don't repeat. The
windows that pick one place, which follow each other, span a segment. Equal segments settle each other: all their
windows repeat. Segments that differ meet by gram, lined up at it, lose the bytes at both ends that no other one
shares, and a suffix array over each such group decides which windows repeat. Every step is a Spark aggregation or
join on hashes; a text moves only to fetch segments and to cut the result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hash_filter, map_texts, materialize, passes, release_memory, shuffle_width, table, text_chunks, whole_text

LENGTH = 200
GRAM = 32
#: Bytes of segments of one gram that share a suffix array, about; more are dealt to several, and their windows counted exactly.
GROUP_BYTES = 8 << 20
_PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D


def suffix_array(s: Sequence[int]) -> Sequence[int]:
    """Suffix array of s, whose last value is its only least one.

    Phase 1 goes through groups of suffixes from the greatest to the least. A group's common prefix is final when
    it comes up. Its suffixes leave the list of open positions; the open position left of each one (the previous
    smaller pointer) has its own prefix continued by the group's, once for every group member between it and
    what follows. Those positions move to the end of their groups as new groups, more repeats higher.
    Phase 2 reads the array from the least suffix on: a suffix whose prefix ends where the current one starts goes
    to the next free place of its group. No names are ever sorted again.
    """
    n = len(s)
    first = np.array(s, np.int32)
    # Lists are faster, arrays take an eighth of the memory.
    hold = list if n < 1 << 18 else lambda values: array("i", values)
    s, sa = hold(s), hold(np.argsort(first, kind="stable").tolist())
    place, group, size = (hold([0]) * n for _ in range(3))
    start = 0
    for k, i in enumerate(sa):
        if k and s[sa[k - 1]] != s[i]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1
    # Open positions as a linked list; index -1, which is index n, closes it into a ring.
    left, right = hold(range(-1, n)), hold([*range(1, n + 1), 0])
    repeats = hold([0]) * n
    end = n
    while end:
        start = group[sa[end - 1]]
        parents = []
        for i in sa[start:end] if end - start == 1 else sorted(sa[start:end]):
            p, r = left[i], right[i]
            right[p] = r
            left[r] = p
            if p >= 0:
                if not repeats[p]:
                    parents.append(p)
                repeats[p] += 1
        end = start
        while parents:
            most = max([repeats[p] for p in parents]) if len(parents) > 1 else repeats[parents[0]]
            moved = parents if most == 1 else [p for p in parents if repeats[p] == most]
            for p in moved:
                g = group[p]
                size[g] -= 1
                to, at = g + size[g], place[p]
                q = sa[to]
                sa[at], place[q] = q, at
                sa[to], place[p] = p, to
            fresh = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, fresh):
                group[p] = g
                size[g] += 1
                repeats[p] = 0
            if most == 1:
                break
            parents = [p for p in parents if repeats[p]]
    free = hold(range(n))
    sa[0] = n - 1
    for k in range(n):
        i = sa[k]
        low = group[i]
        j = i - 1
        while j >= 0 and group[j] >= low:
            g = group[j]
            sa[free[g]] = j
            free[g] += 1
            j = left[j]
    return sa


def window_classes(strings: list[tuple[bytes, bytes]], symbols: int) -> list[tuple[int, list[int]]]:
    """Equal windows of ``symbols`` symbols as (bytes left of the gram, numbers of the strings that have it).

    A string is what stands left and right of the gram, the same in all strings, which counts as one symbol and is
    part of every window.
    """
    text, owner, reach, flat = array("i"), array("i"), array("i"), []
    for k, (left, right) in enumerate(strings):
        at = len(text)
        text.extend([b + 2 for b in left])
        text.append(258)
        text.extend([b + 2 for b in right])
        text.append(1)
        size = len(text) - at
        owner.extend([k] * size)
        # Bytes left of the gram for the windows that fit; -1 for starts without one.
        fits = min(len(left), size - 1 - symbols)
        reach.extend([len(left) - i if i <= fits else -1 for i in range(size)])
        flat += [left, b"\0", right, b"\0"]
    text.append(0)
    reach.append(-1)
    joined = b"".join(flat)
    classes: list[tuple[int, list[int]]] = []
    before = None
    for i in suffix_array(text):
        if reach[i] >= 0:
            now = (reach[i], joined[i : i + symbols])
            if now == before:
                classes[-1][1].append(owner[i])
            else:
                classes.append((reach[i], [owner[i]]))
                before = now
    return classes


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def _most_shared(parts: list[bytes], copies: list[bool]) -> list[int]:
    """For every part the longest beginning that it shares with another one: a neighbour in sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [len(p) if c else 0 for p, c in zip(parts, copies, strict=True)]
    for x, y in zip(order, order[1:], strict=False):
        n = _shared(parts[x], parts[y])
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


# Powers of the rolling hash and their inverses, for pieces up to _PIECE bytes.
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE + 1, base, np.uint64)])))
    return _POWERS[0][:n], _POWERS[1][:n]


def _picked(piece: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of every gram that windows of one piece pick."""
    power, inverse = _powers(len(piece) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    h = (prefix[gram:] - prefix[:-gram]) * inverse[: len(piece) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    h *= _ODD
    n, w = len(h), length - gram + 1
    low = np.uint64((1 << 20) - 1)
    at = np.arange(n, dtype=np.uint64)
    rank = (h & ~low) | (low - at)  # of equal hashes the last place is least
    rows = -(-n // w)
    padded = np.full(rows * w, np.uint64(2**64 - 1))
    padded[:n] = rank
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    places = (low - (least[first] & low)).astype(np.int64)
    return places, h[places].view(np.int64), first, last


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, segment's first byte, its last byte + 1) of every picked gram of a text.

    Long texts go in pieces that overlap so that every window is in exactly one.
    """
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 4
    data = np.frombuffer(raw, np.uint8)
    found = []
    for at in range(0, len(raw) - length + 1, _PIECE - length + 1):
        places, hashes, first, last = _picked(data[at : at + _PIECE], length, gram)
        found.append((places + at, hashes, first + at, last + at + length))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))  # type: ignore[return-value]


def _segment_hashes(raw: bytes, places: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the segments and where in them the gram stands."""
    return np.array([xxhash.xxh3_64_intdigest(raw[a:z], p - a) for p, a, z in zip(places.tolist(), lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal keys (k1, k2) have equal texts, so the same is cut from them."""
    return docs.select("doc_id", whole_text().alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.crc32(F.encode("text", "UTF-8")).alias("k2"), "text")


def _count_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(a, n, s_min, s_max) of every gram that occurs at least twice."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        all_a, all_s = [], []
        for text in batch.column("text").to_pylist():
            raw = text.encode("utf-8")
            places, a, lo, hi = anchors(raw, length, gram)
            if len(places):
                all_a.append(a)
                all_s.append(_segment_hashes(raw, places, lo, hi))
        if not all_a:
            return None
        a, s = np.concatenate(all_a), np.concatenate(all_s)
        order = np.lexsort((s, a))
        a, s = a[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        last = np.concatenate([first[1:], [len(a)]]) - 1
        columns = {"a": a[first], "n": last + 1 - first, "s_min": s[first], "s_max": s[last]}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    found = map_texts(rows.select("text"), run, "a long, n long, s_min long, s_max long")
    total = found.groupBy("a").agg(F.sum("n").alias("n"), F.min("s_min").alias("s_min"), F.max("s_max").alias("s_max"))
    return total.where("n > 1").select("a", (F.col("s_min") != F.col("s_max")).alias("mixed"))


_HIT = "a long, s long, k1 long, k2 long, place int, lo int, hi int"


def _hits(rows: DataFrame, bits, length: int, gram: int) -> DataFrame:
    """Every occurrence of a gram that passes the filter."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list[np.ndarray]] = []
        for text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
            raw = text.encode("utf-8")
            places, a, lo, hi = anchors(raw, length, gram)
            keep = passes(bits.value, a)
            if keep.any():
                places, a, lo, hi = places[keep], a[keep], lo[keep], hi[keep]
                s, n = _segment_hashes(raw, places, lo, hi), len(places)
                out.append([a, s, np.full(n, k1), np.full(n, k2), places.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)])
        if not out:
            return None
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "s", "k1", "k2", "place", "lo", "hi"])

    return map_texts(rows.select("k1", "k2", "text"), run, _HIT)


def _cut_segments(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, part, parts, s, n, k1, k2, place, lo, segment): the bytes of one occurrence of every wanted segment."""
    own = ("a", "part", "parts", "s", "n", "place", "lo", "hi")
    lists = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct(*own)).alias("cuts"))
    joined = rows.select("k1", "k2", "text").join(lists, ["k1", "k2"])

    kinds = {"a": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "s": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "place": pa.int32(), "lo": pa.int32(), "segment": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # of a row that stands often one is cut, or few
        for batch in text_chunks(batches):
            out: dict[str, list] = {c: [] for c in kinds}
            for text, k1, k2, cuts in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2", "cuts")), strict=True):
                if (k1, k2) in done:
                    continue
                if len(done) > 100_000:
                    done.clear()
                done.add((k1, k2))
                raw = text.encode("utf-8")
                for c in cuts:
                    for name, value in {**c, "k1": k1, "k2": k2, "segment": raw[c["lo"] : c["hi"]]}.items():
                        if name in out:
                            out[name].append(value)
            if out["a"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], list(out))
        release_memory()

    cut = joined.mapInArrow(run, "a long, part int, parts int, s long, n long, k1 long, k2 long, place int, lo int, segment binary")
    # A row that stands in several tasks gives its cuts in each: one of each is enough.
    return cut.dropDuplicates(["a", "s"])


def _decide(length: int, gram: int):
    """For groups of segments sorted by gram and part: repeated windows as ranges of their documents.

    Rows (0, k1, k2, first, last): windows first to last (of a segment that occurs once) repeat. For a gram of
    several parts also rows (1, k1, k2, first, first, h1, h2, seen): a window that no other one of its part equals, or
    (seen 2) one of those that repeat in it, to be counted over all parts.
    """
    names = ["kind", "k1", "k2", "first", "last", "h1", "h2", "seen"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def close(part: list[tuple], split: bool) -> Iterator[tuple]:
        """part: (n, k1, k2, place, lo, segment) of one gram."""
        if len(part) == 1 and not split:
            return
        left = [seg[: place - lo] for _, _, _, place, lo, seg in part]
        right = [seg[place - lo + gram :] for _, _, _, place, lo, seg in part]
        if not split:
            copies = [p[0] > 1 for p in part]
            keep_left, keep_right = _most_shared([x[::-1] for x in left], copies), _most_shared(right, copies)
            left = [x[len(x) - k :] for x, k in zip(left, keep_left, strict=True)]
            right = [x[:k] for x, k in zip(right, keep_right, strict=True)]
        members: dict[tuple[bytes, bytes], list[int]] = {}
        for k, both in enumerate(zip(left, right, strict=True)):
            if len(both[0]) + len(both[1]) + gram >= length:
                members.setdefault(both, []).append(k)
        if not members:
            return
        owners = list(members.values())
        hit: dict[int, list[int]] = {}
        for before, strings in window_classes(list(members), length - gram + 1):
            having = [k for x in strings for k in owners[x]]
            again = len(having) > 1 or part[having[0]][0] > 1
            if again:
                for k in having:
                    if part[k][0] == 1:
                        hit.setdefault(k, []).append(part[k][3] - before)
            if split:
                _, k1, k2, place, lo, seg = part[having[0]]
                start = place - before - lo
                d = xxhash.xxh3_128_digest(seg[start : start + length])
                h1, h2 = (int.from_bytes(d[x : x + 8], "little", signed=True) for x in (0, 8))
                yield 1, k1, k2, lo + start, lo + start, h1, h2, 2 if again else 1
        for k, starts in hit.items():
            starts.sort()
            first = last = starts[0]
            for x in starts[1:]:
                if x != last + 1:
                    yield 0, part[k][1], part[k][2], first, last, 0, 0, 0
                    first = x
                last = x
            yield 0, part[k][1], part[k][2], first, last, 0, 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group() -> Iterator[tuple]:
            current, part, split = None, [], False
            for b in batches:
                for a, number, parts, *row in zip(*(b.column(c).to_pylist() for c in ("a", "part", "parts", "n", "k1", "k2", "place", "lo", "segment")), strict=True):
                    if (a, number) != current:
                        yield from close(part, split) if part else ()
                        current, part, split = (a, number), [], parts > 1
                    part.append(row)
            yield from close(part, split) if part else ()
            release_memory()

        rows = []
        for row in group():
            rows.append(row)
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = GROUP_BYTES) -> DataFrame:
    """(k1, k2, lo, hi): byte ranges that windows which repeat cover; ranges of a text may overlap."""
    spark = rows.sparkSession
    repeated = materialize(_count_anchors(rows, length, gram), "sa-anchors")
    bits = spark.sparkContext.broadcast(hash_filter(repeated, "a"))
    hits = materialize(_hits(rows, bits, length, gram).join(repeated, "a"), "sa-hits")
    discard(repeated)
    one = F.min(F.struct("k1", "k2", "place", "lo", "hi")).alias("one")
    known = materialize(hits.groupBy("a", "s").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), one), "sa-segments")
    whole = hits.join(known.where("n > 1").select("a", "s"), ["a", "s"], "left_semi").select("k1", "k2", "lo", "hi")
    # A gram with very many segments is dealt to several parts, each a group of its own in a task of its own.
    mixed = known.where("mixed")
    parts = mixed.groupBy("a").agg(F.ceil(F.sum(F.col("one.hi") - F.col("one.lo")) / limit).cast("int").alias("parts"))
    wanted = mixed.join(parts, "a").select("a", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part"), "parts", "s", "n", "one.*")
    grouped = _cut_segments(rows, wanted).repartition(shuffle_width(spark), "a", "part").sortWithinPartitions("a", "part", "s")
    decided = materialize(grouped.mapInArrow(_decide(length, gram), "kind int, k1 long, k2 long, first int, last int, h1 long, h2 long, seen int"), "sa-decided")
    ranges = decided.where("kind = 0").select("k1", "k2", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    windows = decided.where("kind = 1")
    spot = F.struct("k1", "k2", "first")
    again = windows.groupBy("h1", "h2").agg(F.max("seen").alias("seen"), F.min(spot).alias("one"), F.max(spot).alias("other")).where("seen > 1 or one <> other").select("h1", "h2")
    late = windows.where("seen = 1").join(again, ["h1", "h2"], "left_semi").select("k1", "k2", F.col("first").alias("lo"), (F.col("last") + length).alias("hi"))
    return whole.unionByName(ranges).unionByName(late)


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, kept binary, n_removed, n_spans): every byte that a repeated window covers is cut.

    A window repeats if its bytes also start anywhere else in the table, in the same text or another, overlaps
    included; matches never cross texts. Rows repeated in full, even with equal ids, are elsewhere to each other, so
    texts of ``length`` bytes or more go whole then. Null, empty and shorter texts lose nothing. Only doc_id and
    text are read.
    """
    rows = _keyed(docs)
    ranges = repeated_ranges(rows, length, gram, limit).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw = text.encode("utf-8")
            kept, spans, at, end = [], 0, 0, -1
            for lo, hi in sorted((r["lo"], r["hi"]) for r in found or []):
                if lo > end:
                    spans += 1
                    kept.append(raw[at:lo])
                at = end = max(end, hi)
            kept.append(raw[at:])
            rest = b"".join(kept)
            for column, value in zip(out, (len(raw), rest, len(raw) - len(rest), spans), strict=True):
                column.append(value)
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])

    return map_texts(joined, run, f"doc_id {kind}, n_bytes long, kept binary, n_removed long, n_spans long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
