"""Quality rules: fixed base rules plus a calibrated logistic regression over hashed n-grams.

Features are relative frequencies of hashed character 3-grams, words and word pairs, each family in a table of its
own. The model is fitted on a bounded, hash-chosen sample of the labelled rows (``max_labelled``), calibrated by
a logistic curve on rows held out from the fit, and scored over whole texts in Arrow batches. Weights are
rounded to integers, so a score does not depend on how rows are batched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, release_memory, table, text_chunks, whole_text

TABLE_BITS = 16
FAMILIES = 3
DIM = FAMILIES << TABLE_BITS
#: The fit sees at most so many labelled ids, and so many features of each.
MAX_LABELLED = 6_000
MAX_FEATURES = 4_096
KEEP_PROBABILITY = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SCALE = 1 << 16
#: Bytes of text looked at together: each takes some hundred bytes of hashes and sums.
_CHUNK = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _pieces(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A text in pieces of about _CHUNK bytes, cut after white space, each with the two characters that follow it.

    A word is never cut, however long.
    """
    at = 0
    while len(raw) - at > _CHUNK and (m := _SPACE.search(raw, at + _CHUNK)):
        yield raw[at : m.end()], raw[m.end() : m.end() + 8].decode("utf-8", "ignore")[:2].encode("utf-8")
        at = m.end()
    yield raw[at:] if at else raw, b""


class Layout:
    """Texts, or pieces of them, as one byte array, with their words."""

    def __init__(self, raw: list[bytes], following: list[bytes] | None = None):
        self.raw = raw
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.following = following
        sizes = np.array([len(r) for r in raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.end = self.begin + sizes
        ws = _WS[self.bytes]
        self.ws = ws
        before = np.concatenate([[True], ws[:-1]])
        self.word_start = np.flatnonzero(~ws & before)
        self.word_end = np.flatnonzero(ws & ~before)
        self.word_from = np.searchsorted(self.word_start, self.begin)
        self.word_to = np.searchsorted(self.word_start, self.end)

    def per_doc(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        lo = np.minimum(lo, len(values))  # an empty last document begins past the last gram
        return total[np.minimum(np.maximum(hi, lo), len(values))] - total[lo]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of character 3-grams, and the place of the first and after the last one of every text."""
        after = self.following[0] if self.following else b""
        b = np.frombuffer(self.bytes[:-1].tobytes() + after + b"\n", np.uint8) if after else self.bytes
        at = np.flatnonzero((b & 0xC0) != 0x80)  # where characters begin
        code = np.zeros(len(at), np.uint64)
        sizes = np.diff(np.concatenate([at, [len(b)]]))
        for k in range(4):
            part = np.minimum(at + k, len(b) - 1)
            code = np.where(sizes > k, code << np.uint64(8) | b[part], code)
        grams = (code[:-2] * _MULT + code[1:-1]) * _STEP + code[2:] if len(code) > 2 else code[:0]
        grams ^= grams >> np.uint64(29)
        lo, hi = np.searchsorted(at, self.begin), np.searchsorted(at, self.end)
        return grams, lo, np.maximum(hi - 2 + len(after.decode("utf-8")), lo)

    def words(self) -> np.ndarray:
        """Hashes of the words: sums of bytes times powers that begin anew with every word."""
        keep = ~self.ws
        sizes = self.word_end - self.word_start
        first = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max(initial=0)), _STEP)]))
        values = (self.bytes[keep].astype(np.uint64) + np.uint64(1)) * power[inside]
        words = np.add.reduceat(values, first) if len(first) else values
        words ^= words >> np.uint64(29)
        return words

    def families(self, last_word: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hashed feature of every place, first place and after the last one of every text) by family.

        last_word is the hash of the word before the first one, if the texts go on from an earlier piece.
        """
        shift = np.uint64(64 - TABLE_BITS)
        grams, lo, hi = self.grams()
        yield (grams * _MULT >> shift).astype(np.int64), lo, hi
        words = self.words()
        yield (words * _MULT >> shift).astype(np.int64) + (1 << TABLE_BITS), self.word_from, self.word_to
        start, stop = self.word_from, self.word_to
        if last_word is not None and len(last_word):
            words, stop = np.concatenate([last_word, words]), stop + 1
        pairs = words[:-1] * _STEP + words[1:] if len(words) else words
        pairs ^= pairs >> np.uint64(31)
        last = np.minimum(np.maximum(stop - 1, start), len(pairs))
        yield (pairs * _MULT >> shift).astype(np.int64) + (2 << TABLE_BITS), np.minimum(start, last), last


def _parts(raw: bytes) -> Iterator[tuple[Layout, list[np.ndarray]]]:
    """Layout and features by family of every piece of one text."""
    last = None
    for piece, following in _pieces(raw):
        layout = Layout([piece], [following])
        yield layout, [index[int(lo[0]) : int(hi[0])] for index, lo, hi in layout.families(last)]
        if len(layout.word_start):
            last = layout.words()[-1:]


@dataclass
class QualityModel:
    """Integer weights by feature, bias and the calibrating line; without labels every score is 1."""

    weights: np.ndarray | None
    bias: float
    slope: float
    shift: float

    def probability(self, layout: Layout) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(layout.raw))
        logit = np.full(len(layout.raw), self.bias)
        for index, lo, hi in layout.families():
            sums = layout.per_doc(self.weights[index], lo, hi)
            logit += sums / _SCALE / np.maximum(hi - lo, 1)
        return _sigmoid(self.slope * logit + self.shift)

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Counts and probability of every text; a text beyond _CHUNK bytes is looked at piece by piece."""
        raw = [t.encode("utf-8") for t in texts]
        if len(raw) == 1 and len(raw[0]) > _CHUNK:
            return self._measure_long(raw[0])
        layout = Layout(raw)
        found = _counts(layout)
        return found | {"repeats": np.array([_repeat_words(r.split()) for r in raw], np.int64), "dups": np.array([_dup_lines(r) for r in raw], np.int64), "probability": self.probability(layout)}

    def _measure_long(self, raw: bytes) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        sums, sizes = np.zeros(FAMILIES, np.int64), np.zeros(FAMILIES, np.int64)
        for layout, found in _parts(raw):
            for name, value in _counts(layout).items():
                total[name] = total.get(name, 0) + value
            if self.weights is not None:
                sums += [int(self.weights[f].sum()) for f in found]
                sizes += [len(f) for f in found]
        logit = self.bias
        for s, n in zip(sums.tolist(), sizes.tolist(), strict=True):
            logit += s / _SCALE / max(n, 1)
        probability = 1.0 if self.weights is None else float(_sigmoid(np.float64(self.slope * logit + self.shift)))
        return total | {"repeats": np.array([_repeat_words(raw.split())], np.int64), "dups": np.array([_dup_lines(raw)], np.int64), "probability": np.array([probability])}


def _counts(layout: Layout) -> dict[str, np.ndarray]:
    """words, chars and symbols of every text."""
    point = (layout.bytes & 0xC0) != 0x80
    return {
        "words": layout.word_to - layout.word_from,
        "chars": layout.per_doc(point & ~layout.ws, layout.begin, layout.end),
        "symbols": layout.per_doc(_SYMBOL[layout.bytes], layout.begin, layout.end),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Relative frequencies of every text's features; of a text with more than MAX_FEATURES of them the most frequent ones."""
    none_i, none_v = np.zeros(0, np.int32), np.zeros(0, np.float32)
    index: list[np.ndarray] = []
    value: list[np.ndarray] = []
    for text in batch.column("text").to_pylist():
        counts, sizes = np.zeros(DIM, np.int64), np.zeros(FAMILIES, np.int64)
        used: list[np.ndarray] = [none_i]
        for _, found in _parts(text.encode("utf-8")):
            for k, f in enumerate(found):
                features, n = np.unique(f, return_counts=True)
                counts[features] += n
                sizes[k] += len(f)
                used.append(features)
        features = np.unique(np.concatenate(used))
        share = (counts[features] / np.maximum(sizes, 1)[features >> TABLE_BITS]).astype(np.float32)
        if len(features) > MAX_FEATURES:
            most = np.sort(np.lexsort((features, -share))[:MAX_FEATURES])
            features, share = features[most], share[most]
        index.append(features.astype(np.int32))
        value.append(share)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none_i, *index]), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none_v, *value]), pa.float32()))],
        ["doc_id", "label", "idx", "val"],
    )


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 100, ridge: float = 3e-3, block: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Full-batch Adam on sparse rows (indices, values); deterministic.

    Rows go in blocks of about ``block`` values, so a round needs little beyond the rows themselves.
    """
    used = np.zeros(DIM, bool)
    for i, _ in rows:
        used[i] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    n_used = int(used.sum())
    ends = np.cumsum([len(i) for i, _ in rows])
    starts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, block), "right"))
    cuts = [*starts[starts < len(rows)].tolist(), len(rows)]
    blocks, square = [], np.zeros(n_used)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), [len(i) for i, _ in rows[lo:hi]])
        idx = place[np.concatenate([i for i, _ in rows[lo:hi]])]
        val = np.concatenate([v for _, v in rows[lo:hi]]).astype(np.float32)
        square += np.bincount(idx, val.astype(np.float64) ** 2, n_used)
        blocks.append((lo, hi, row, idx, val))
    # Rare features have tiny frequencies: divide each by its root mean square so that all learn alike.
    spread = np.sqrt(square / len(rows)) + 1e-4
    blocks = [(lo, hi, row, idx, (val / spread[idx]).astype(np.float32)) for lo, hi, row, idx, val in blocks]
    w, bias = np.zeros(n_used), 0.0
    m, v = np.zeros(n_used + 1), np.zeros(n_used + 1)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(rows)  # classes weigh alike
    for t in range(1, rounds + 1):
        grad = np.concatenate([ridge * w, [0.0]])
        for lo, hi, row, idx, val in blocks:
            residual = (_sigmoid(np.bincount(row, val * w[idx], hi - lo) + bias) - y[lo:hi]) * share[lo:hi]
            grad[:-1] += np.bincount(idx, val * residual[row], n_used)
            grad[-1] += residual.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    full = np.zeros(DIM)
    full[used] = w / spread
    return full, float(bias)


def calibrate(logits: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out logits.

    Platt's targets (just short of 0 and 1) keep the curve finite where the classes are apart; each Newton step
    is halved until the loss falls. Held-out rows of one class only leave the logits as they are.
    """
    good = int(y.sum())
    if good in (0, len(y)):
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    unit = max(float(np.std(logits)), 1e-9)
    design = np.stack([logits / unit, np.ones(len(logits))], axis=1)

    def loss(theta: np.ndarray) -> float:
        z = design @ theta
        return float((np.logaddexp(0, z) - target * z).sum())

    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(design @ theta)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        move, size, now = np.linalg.solve(hessian, design.T @ (p - target)), 1.0, loss(theta)
        while size > 1e-6 and loss(theta - size * move) >= now:
            size /= 2
        if size <= 1e-6:
            break
        theta = theta - size * move
    return float(theta[0]) / unit, float(theta[1])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, rows, keys = [], [], []
    for b in batches:
        keys += b.column("doc_id").to_pylist()
        labels += b.column("label").to_pylist()
        rows += [(np.array(i.values), np.array(v.values)) for i, v in zip(b.column("idx"), b.column("val"), strict=True)]  # copies: batches go
    order = sorted(range(len(rows)), key=lambda i: (keys[i], labels[i], len(rows[i][0])))
    rows, y = [rows[i] for i in order], np.array([labels[i] for i in order], np.float64)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        return
    weights, bias = fit_logistic([r for r, h in zip(rows, held, strict=True) if not h], y[~held])
    rounded = np.clip(np.round(weights * _SCALE), -(2**31) + 1, 2**31 - 1).astype(np.int32)
    logits = np.array([bias + (rounded[i] / _SCALE) @ v for (i, v), h in zip(rows, held, strict=True) if h])
    slope, shift = calibrate(logits, y[held]) if held.any() else (1.0, 0.0)
    del rows, weights
    yield pa.RecordBatch.from_arrays([pa.array([rounded], pa.list_(pa.int32())), pa.array([bias]), pa.array([slope]), pa.array([shift])], ["weights", "bias", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most ``max_labelled`` labelled ids, chosen by their hash.

    Null ids and null labels are left out; an id labelled twice counts as good if any label says so; of several rows
    with one id the text that hashes lowest counts, and a null text is empty. The sample is small by its bounds (ids, and
    features of each), so its rows meet in one task; only the weights (DIM integers) reach the driver. Without labels of
    both kinds the model keeps everything. Columns beyond those named are not read.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.max("quality") > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    text = whole_text()
    rows = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("one")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("one").alias("one")).select("doc_id", "label", "one.text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = map_texts(rows, _features, f"doc_id {kind}, label int, idx array<int>, val array<float>", _CHUNK)
    found = features.repartition(1).mapInArrow(_fit, "weights array<int>, bias double, slope double, shift double").collect()
    if not found:
        return QualityModel(None, 0.0, 1.0, 0.0)
    return QualityModel(np.array(found[0].weights, np.int64), found[0].bias, found[0].slope, found[0].shift)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(number) + ids[1:]
    if len(words) > 1 << 16:  # numbers of pairs, so that a window's number fits 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(words), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    marked = again.copy()
    marked[1:] |= again[:-1]
    marked[2:] |= again[:-2]
    return int(marked.sum())


def _dup_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if x.strip()]
    return len(worded) - len(set(worded))


def _fails(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["words"] < MIN_WORDS) | (100 * m["repeats"] > MAX_REPEAT_PERCENT * m["words"])


def judge(docs: DataFrame, model: QualityModel, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one, so repeated rows get
    equal verdicts. Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value.measure(batch.column("text").to_pylist())
        failed = _fails(m)
        columns = {"doc_id": batch.column("doc_id"), "n_words": m["words"], "word_chars": m["chars"], "n_symbols": m["symbols"], "n_dup_lines": m["dups"], "n_repeat_words": m["repeats"], "base_failed": failed, "kept": ~failed & (m["probability"] >= keep_probability), "probability": m["probability"]}
        return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], list(columns))

    rows = docs.select("doc_id", whole_text().alias("text"))
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_texts(rows, run, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, probability double", _CHUNK)


def keep_good(docs: DataFrame, model: QualityModel, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of docs whose text passes the base rules and the model; all columns stay, whatever their names.

    Null and empty texts fail and go. Repeated rows stay or go together; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, _CHUNK, at):
            m = sent.value.measure([t or "" for t in batch.column(at).to_pylist()])
            kept = ~_fails(m) & (m["probability"] >= keep_probability)
            if kept.any():
                yield batch.filter(pa.array(kept))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
