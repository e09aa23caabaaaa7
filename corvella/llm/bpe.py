"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The words a batch has not seen before are laid end to end in one flat symbol array. A round looks up the rank
of every adjacent pair by binary search over the sorted pair keys, takes each word's lowest rank, and merges
all its occurrences from the left, for all words at once. Rounds repeat until no word has a pair with a rank.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory, table, text_chunks, whole_text

# Fixed value: the splitting pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space as the vocabulary's own splitter sees it: U+001C to U+001F are not white space there.
_SPLIT = regex.compile(SPLIT.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
#: Before a space that stands alone between a word and a letter one match always ends and another begins.
_CUT = regex.compile(r"\P{White_Space} (?=\p{L})")
_NONE = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves, others follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes of text encoded together, and of words (with what Python adds to each) that a task remembers.
_CHUNK = 1 << 20
CACHE_BYTES = 24 << 20
_WORD_COST = 200


class BytePairCoder:
    """Vocabulary tables, which a Python worker keeps, plus a cache of words, bounded in bytes, which a task drops."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        stand_in = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces: dict[int, bytes] = {i: bytes(stand_in[c] for c in t) for t, i in vocab.items()}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(pieces) + 1
        ordered = [pieces.get(i, b"") for i in range(self.size)]
        self.piece_len = np.array([len(p) for p in ordered], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in stand_in.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged_by_rank = keys[order], order.astype(np.int64), merged
        self.cache: dict[str, int] = {}
        self.cache_bytes, self.cached = cache_bytes, 0
        self.forget()
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def forget(self) -> None:
        """Drop the cached words."""
        self.cache, self.cached = {}, 0
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for token, i in self.special.items():
            self.cache["\0special:" + token] = len(self.lens)
            self._append(np.array([i], np.int32), np.array([1], np.int64))

    def _append(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.concatenate([[0], np.cumsum(lens)])[:-1]]).astype(np.int64)
        self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has."""
        lens = np.array([len(w) for w in words], np.int64)
        done_ids: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        word = np.repeat(np.arange(len(words)), lens)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        while len(sym) > 1:
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(np.concatenate([rank, [_NONE]]), first)
            counts = np.diff(np.concatenate([first, [len(sym)]]))
            live = np.repeat(low != _NONE, counts)
            if not live.all():  # finished words leave the array
                done_ids.append(sym[~live])
                done_word.append(word[~live])
                if not live.any():
                    sym = sym[:0]
                    break
            hit = np.concatenate([rank, [_NONE]]) == np.repeat(low, counts)
            hit &= live
            # Of overlapping hits (a run such as a a a) every second one counts, from the left.
            runs = np.flatnonzero(hit)
            if len(runs) > 1:
                fresh = np.concatenate([[True], np.diff(runs) != 1])
                base = np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))
                odd = (np.arange(len(runs)) - base) % 2 == 1
                hit[runs[odd]] = False
                runs = runs[~odd]
            sym = sym.copy()
            sym[runs] = self.merged_by_rank[np.repeat(low, counts)[runs]]
            keep = live
            keep[runs + 1] = False
            sym, word = sym[keep], word[keep]
        done_ids.append(sym)
        done_word.append(word[: len(sym)])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _words(self, text: str) -> list[str]:
        if not self.splitter or not any(t in text for t in self.special):
            return _SPLIT.findall(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += _SPLIT.findall(text[at : m.start()])
            out.append("\0special:" + m[0])
            at = m.end()
        return out + _SPLIT.findall(text[at:])

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about _CHUNK characters, cut where no word or special token can span."""
        at = 0
        while len(text) - at > 2 * _CHUNK and (m := _CUT.search(text, at + _CHUNK)):
            yield text[at : m.end() - 1]
            at = m.end() - 1
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text (int32)."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for k, text in enumerate(texts):
            for piece in self._pieces(text):
                held.append((k, self._words(piece)))
                size += len(piece)
                if size >= _CHUNK:
                    self._encode_held(held, out)
                    held, size = [], 0
        self._encode_held(held, out)
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]

    def _encode_held(self, held: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        if self.cached > self.cache_bytes:
            self.forget()
        fresh = list({w for _, words in held for w in words}.difference(self.cache))
        for i in range(0, len(fresh), 32_768):
            part = fresh[i : i + 32_768]
            ids, lens = self.merge_words([w.encode("utf-8") for w in part])
            base = len(self.lens)
            self._append(ids, lens)
            self.cache.update(zip(part, range(base, base + len(part)), strict=True))
            self.cached += 5 * len(ids) + sum(map(len, part)) + _WORD_COST * len(part)
        get = self.cache.__getitem__
        for k, words in held:
            out[k].append(self._gather(np.fromiter(map(get, words), np.int64, len(words))))

    def _gather(self, index: np.ndarray) -> np.ndarray:
        return self.ids[_spread(self.starts[index], self.lens[index])]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.piece_bytes[_spread(self.piece_start[ids], self.piece_len[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), end to end."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


_CODERS: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """The worker's own coder. Without the file at hand the driver's copy is used (see vocabulary_source)."""
    if path not in _CODERS:
        _CODERS[path] = BytePairCoder(path)
    return _CODERS[path]


def _encoded(docs: DataFrame, path: str, keep: tuple[str, ...], columns: list[tuple[str, str]], fn) -> DataFrame:
    """The kept columns and what fn(coder, texts, ids) gives for ``columns`` (name, type), in bounded batches."""
    assert os.path.exists(path), path
    rows = docs.select(*keep, whole_text().alias("text"))
    schema = rows.select(*keep, *(F.lit(None).cast(kind).alias(c) for c, kind in columns)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in text_chunks(batches, _CHUNK):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *fn(own, texts, own.encode(texts))], [*keep, *(c for c, _ in columns)])
        own.forget()
        release_memory()

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """The kept columns of every row with ids (array<int>) and decoded (string), or else lossless: whether they decode to the text.

    Null and empty texts have no ids and decode to the empty text. Special tokens written out in a text become
    their ids, as the library does. Repeated rows are encoded each; an empty table gives an empty one. A column of the
    input named text, ids, lossless or decoded can't be kept; columns not kept are not read.
    """

    def fn(own: BytePairCoder, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))]
        if decoded:
            return [*out, pa.array([own.decode(x) for x in ids], pa.string())]
        return [*out, pa.array([own.decode_bytes(x) == t.encode("utf-8") for x, t in zip(ids, texts, strict=True)], pa.bool_())]

    last = ("decoded", "string") if decoded else ("lossless", "boolean")
    return _encoded(docs, vocabulary or default_vocabulary(), keep, [("ids", "array<int>"), last], fn)


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null text counts as empty: no tokens, both digests of nothing. Repeated rows give equal digests, an empty table an
    empty one. Only doc_id and text are read, so further columns of any name do no harm.
    """

    def fn(own: BytePairCoder, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
        ]

    return _encoded(docs, vocabulary or default_vocabulary(), ("doc_id",), [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], fn)


def op4_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
