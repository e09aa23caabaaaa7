"""Personal data: fixed base patterns, and bootstrapped contextual extraction of identifiers they miss.

One pass over the texts finds the base spans and, as possible identifiers, the digit-bearing tokens outside them, and
runs of short ones such as a number written in groups. Both give (lexical pattern, instance) pairs: a pattern is the
word or two words before the value. Base spans are the seeds, and so are long tokens of mixed letters and digits, as keys
and access tokens are. A second pass counts how often each pattern that could do stands before anything at all, so that words
such as "the" come out as unsure as they are. Spark then scores the pattern-instance graph in rounds: a pattern is as
sure as the mean score of all that follows it, an instance outside the seeds as sure as its surest accepted pattern.
Rounds end when no pattern is added. Patterns that stay sure mark every possible identifier that follows them, short ones
only if they are very sure.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hash_filter, map_texts, materialize, passes, release_memory, table, text_chunks, unused, whole_text

KINDS = ("email", "ip", "card", "phone", "context")
#: Bounds of the bootstrapping: least sum of instance scores, least mean score, and that for short identifiers.
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.7
SHORT_CONFIDENCE = 0.9
#: A possible identifier has so many letters and digits (a short one fewer), and digits, at least.
MIN_ALNUM, MIN_SHORT, MIN_DIGITS = 8, 5, 2
#: A token of so many characters, so many of them digits and letters each at least, is a seed.
SECRET_LENGTH, SECRET_MIX = 20, 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a digit run begins and takes whole runs, so these look back and never back up.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_GROUP = re.compile(r"[0-9A-Z()+./-]*+")
_SECRET = re.compile(rf"[A-Za-z0-9_+/=-]{{{SECRET_LENGTH},}}+")
_EDGE = "\"'`()[]{}<>,.;:!?"

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, 0, end
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans of one text by start, then kind; offsets in code points."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8")) - (1 << 63)


BASE, FULL, SHORT = range(3)


def _secret(value: str) -> bool:
    if not _SECRET.fullmatch(value):
        return False
    digits = sum("0" <= c <= "9" for c in value)
    return digits >= SECRET_MIX and sum(c.isalpha() for c in value) >= SECRET_MIX


def contexts(text: str, spans: list[Span]) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(start, end, instance, seed, grade, patterns) of every base span and every other possible identifier."""
    if not spans and not _DIGIT.search(text):
        return []
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out = []

    def patterns(first: int, start: int) -> list[int]:
        """Of the value at ``start`` in token ``first``: what stands before it in the token, else words before."""
        glued = text[tokens[first][0] : start].lower().lstrip(_EDGE)
        before = [text[a:b].lower() for a, b in tokens[max(0, first - 2) : first]]
        if any(c.isalnum() for c in glued):
            return [_hash("0 " + glued)]
        found = [_hash("1 " + before[-1])] if before else []
        return found + ([_hash("2 " + " ".join(before))] if len(before) == 2 else [])

    def add(first: int, start: int, end: int) -> None:
        value = text[start:end]
        start += len(value) - len(value.lstrip(_EDGE))
        value = value.strip(_EDGE)
        n = sum(c.isalnum() for c in value)
        if n >= MIN_SHORT and sum("0" <= c <= "9" for c in value) >= MIN_DIGITS:
            out.append((start, start + len(value), _hash(value.lower()), _secret(value), FULL if n >= MIN_ALNUM else SHORT, patterns(first, start)))

    taken, t = sorted((s, e) for s, _, e in spans), 0
    i = 0
    for s, e in taken:
        while i < len(tokens) and tokens[i][1] <= s:
            i += 1
        out.append((s, e, _hash(text[s:e].lower()), True, BASE, patterns(i, s)))
    reach = 0
    run: list[tuple[int, int, int]] = []  # tokens next to each other that may be one number written in groups

    def close() -> None:
        if len(run) > 1:
            add(run[0][0], run[0][1], run[-1][2])
        elif run:
            add(*run[0])
        run.clear()

    for i, (a, b) in enumerate(tokens):
        while t < len(taken) and taken[t][0] < b:
            reach = max(reach, taken[t][1])
            t += 1
        if a < reach or not _DIGIT.search(text, a, b):
            close()
            continue
        start = a + _cut(text[a:b])
        group = _GROUP.fullmatch(text[start:b].strip(_EDGE)) and sum(c.isalnum() for c in text[start:b]) < MIN_ALNUM
        if not group or start > a or (run and a != run[-1][2] + 1):
            close()
        if not group:
            add(i, start, b)
            continue
        run.append((i, start, b))
        if text[b - 1] in ",;:!?":
            close()
    close()
    return out


_SPAN = "struct<start:int,kind:int,end:int>"
_SEEN = "struct<start:int,end:int,instance:bigint,seed:boolean,grade:int,patterns:array<bigint>>"
_SPAN_PA = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SEEN_PA = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("grade", pa.int32()), ("patterns", pa.list_(pa.int64()))])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base_sha256, base, seen): base spans and pattern contexts of every row, without its text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        spans = [base_spans(t) for t in texts]
        seen = [contexts(t, s) for t, s in zip(texts, spans, strict=True)]
        names = ("start", "end", "instance", "seed", "grade", "patterns")
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array([hashlib.sha256(render(s).encode()).hexdigest() for s in spans]),
                pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in s] for s in spans], pa.list_(_SPAN_PA)),
                pa.array([[dict(zip(names, x, strict=True)) for x in s] for s in seen], pa.list_(_SEEN_PA)),
            ],
            ["doc_id", "key", "base_sha256", "base", "seen"],
        )

    rows = docs.select("doc_id", row_key().alias("key"), whole_text().alias("text"))
    return map_texts(rows, run, f"doc_id {kind}, key string, base_sha256 string, base array<{_SPAN}>, seen array<{_SEEN}>")


def row_key():
    """Rows with equal keys have equal texts, so equal spans."""
    return F.concat_ws(":", F.xxhash64("doc_id", whole_text()), F.crc32(F.encode(whole_text(), "UTF-8")))


def _cut(token: str) -> int:
    """Where the value begins in a token such as key=value or key:value."""
    end = len(token) - 1
    return max(token.rfind("=", 0, end), token.rfind(":", 0, end)) + 1


def followers(docs: DataFrame, patterns: DataFrame, remembered: int = 100_000) -> DataFrame:
    """(pattern, total): how often each of the patterns stands before a token, or the value of one, in all texts.

    What a word means for patterns is looked up once a word; counting is done on whole batches of word numbers. A task
    that knows ``remembered`` words forgets them.
    """
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(patterns, "pattern"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        lowered: list[str] = []
        counted, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def sums() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in counted]), len(keys)).astype(np.int64)
            counted[:] = [(keys, n)]
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pattern", "total"])

        # By word number: its one-word pattern and its glued one, and whether they are wanted.
        before, before_ok, glued, glued_ok = (np.zeros(0, t) for t in (np.int64, bool, np.int64, bool))
        for batch in text_chunks(batches):
            if len(number) > remembered:
                number.clear()
                lowered.clear()
                before, before_ok, glued, glued_ok = before[:0], before_ok[:0], glued[:0], glued_ok[:0]
            split = [_TOKEN.findall(t) for t in batch.column("text").to_pylist()]
            tokens = [w for words in split for w in words]
            if not tokens:
                continue
            fresh = list(set(tokens).difference(number))
            number.update(zip(fresh, range(len(number), len(number) + len(fresh)), strict=True))
            low = [w.lower() for w in fresh]
            lowered += low
            h = np.array([_hash("1 " + w) for w in low], np.int64)
            before, before_ok = np.concatenate([before, h]), np.concatenate([before_ok, passes(bits.value, h)])
            heads = [_glue(w) for w in fresh]
            h = np.array([_hash("0 " + g) if g else 0 for g in heads], np.int64)
            glued, glued_ok = np.concatenate([glued, h]), np.concatenate([glued_ok, passes(bits.value, h) & np.array([g != "" for g in heads], bool)])

            ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
            ends = np.cumsum([len(words) for words in split])
            first, last = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
            first[np.concatenate([[0], ends[:-1]])] = True
            last[ends - 1] = True  # of an empty text: the token before, which is a last one itself, or the spare place
            at = np.flatnonzero(before_ok[ids] & ~last[:-1])
            inner = at[~first[at]]
            pair, n_pair = np.unique(ids[inner - 1] << 32 | ids[inner], return_counts=True)
            h = np.array([_hash(f"2 {lowered[x]} {lowered[y]}") for x, y in zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist(), strict=True)], np.int64)
            ok = passes(bits.value, h)
            found, n = np.concatenate([before[ids[at]], glued[ids[glued_ok[ids]]], h[ok]]), np.concatenate([np.ones(len(at), np.int64), np.ones(int(glued_ok[ids].sum()), np.int64), n_pair[ok]])
            if len(found):
                counted.append((found, n))
                held += len(found)
                if held > 1 << 20:  # sums of a task's batches; too many different patterns leave early
                    early = sums()
                    held = early.num_rows
                    if held > 1 << 19:
                        yield early
                        counted[:], held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield sums()
        del number, lowered, before, glued
        release_memory()

    found = docs.select(whole_text().alias("text")).mapInArrow(run, "pattern long, total long")
    return found.groupBy("pattern").agg(F.sum("total").alias("total"))


def _glue(token: str) -> str:
    """The key in front of a value in its token, as patterns name it; empty if there is none."""
    at = _cut(token) if "=" in token or ":" in token else 0
    if not at:
        return ""
    return token[: len(token) - len(token[at:].lstrip(_EDGE))].lower().lstrip(_EDGE)


def accepted_patterns(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(pattern, confidence) when no round over rows (pattern, instance, seed) found in docs adds a pattern.

    Looked at are patterns of at least MIN_SUPPORT instances that are seeds or found in several places.
    """
    graph = materialize(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-graph")
    # Only seeds and instances of several places can make a pattern sure: one place gives an instance two patterns at most.
    telling = graph.groupBy("instance").agg(F.max("seed").alias("seed"), F.count("*").alias("patterns")).where("seed or patterns > 2").select("instance")
    prospects = graph.join(telling, "instance", "left_semi").groupBy("pattern").count().where(F.col("count") >= MIN_SUPPORT).select("pattern")
    possible = graph.join(prospects, "pattern").groupBy("pattern").agg(F.sum("n").alias("n"))
    totals = materialize(possible.join(followers(docs, possible), "pattern", "left").select("pattern", F.greatest("n", F.coalesce("total", F.lit(0))).alias("total")), "pii-totals")
    scores, accepted = None, -1
    while True:
        scored = graph.withColumn("score", F.col("seed").cast("double"))
        if scores is not None:
            scored = graph.join(scores, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("learned", F.lit(0.0))))
        sums = scored.groupBy("pattern").agg(F.sum("score").alias("support"), F.sum(F.col("score") * F.col("n")).alias("mass"))
        sure = sums.where(F.col("support") >= MIN_SUPPORT).join(totals, "pattern").withColumn("confidence", F.col("mass") / F.col("total"))
        sure = materialize(sure.where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "confidence"), "pii-patterns")
        before, accepted = accepted, sure.count()
        if accepted <= max(before, 0):  # scores only grow, so the accepted patterns do too
            return sure
        scores = graph.where("not seed").join(sure, "pattern").groupBy("instance").agg(F.max("confidence").alias("learned"))


def _discovered(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(key, extra): spans outside the base that follow an accepted pattern."""
    seen = scanned.select("key", F.explode("seen").alias("s")).select("key", "s.start", "s.end", "s.instance", "s.seed", "s.grade", F.explode("s.patterns").alias("pattern"))
    sure = accepted_patterns(docs, seen.select("pattern", "instance", "seed"))
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")
    enough = (F.col("grade") == FULL) | ((F.col("grade") == SHORT) & (F.col("confidence") >= SHORT_CONFIDENCE))
    return seen.join(sure, "pattern").where(enough).groupBy("key").agg(F.collect_set(span).alias("extra"))


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Null and empty texts have no spans (the digest of the empty string, an empty list). Repeated rows get equal
    spans. Columns beyond doc_id and text are not read.
    """
    scanned = materialize(scan(docs), "pii-scan")
    joined = scanned.join(_discovered(docs, scanned), "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{_SPAN}>"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return joined.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), "base_sha256", text.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every private span replaced by <KIND> (overlapping spans: one mark, of the first); all columns stay.

    A null text stays null, an empty one empty. Repeated rows come back as often as they stand, marked alike; an empty table
    gives an empty one. Columns keep their values, whatever their names.
    """
    scanned = materialize(scan(docs), "pii-scan")
    columns, at = docs.columns, docs.columns.index("text")
    more = unused(docs, "extra")
    keyed = docs.select(F.struct("*").alias("row"), row_key().alias("key"))

    def mask(text: str | None, extra: list[dict] | None) -> str | None:
        if text is None:
            return None
        spans = sorted(base_spans(text) + [(s["start"], s["kind"], s["end"]) for s in extra or []])
        out, end = [], 0
        for s, k, e in spans:
            if s >= end:
                out += [text[end:s], f"<{KINDS[k].upper()}>"]
            end = max(end, e)
        return "".join(out) + text[end:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            masked = pa.array([mask(t, x) for t, x in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else b.column(i) for i in range(len(columns))], columns)

    joined = keyed.join(_discovered(docs, scanned), "key", "left").select("row.*", F.col("extra").alias(more))
    return joined.mapInArrow(run, docs.schema)


def op7_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
