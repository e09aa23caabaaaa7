"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of space marks and the word after it. No piece of the vocabulary goes on past a word into the next mark,
so every distinct chunk is segmented once and its ids are joined back at each of its positions. Fresh chunks of a batch
are segmented together: all symbols stand in one flat array, and a round merges in every chunk the best pair there is.
Where a chunk is long (a script without spaces) it is cut between characters that no piece spans.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _spread
from .common import release_memory, table, text_chunks, whole_text

MARK = "▁"
_CHUNKS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of text looked at together; chunks longer than LONG are cut where no piece spans.
SLICE, LONG = 1 << 20, 64
#: Bytes of chunks (with what Python adds to each) that a task remembers.
TABLE_BYTES, _CHUNK_COST = 96 << 20, 300
_NONE = np.iinfo(np.int64).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _member(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values would stand among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return at, keys[at] == found


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _joined(points: list[np.ndarray]) -> np.ndarray:
    """Neighbouring code points of equal length arrays as one key; 21 bits hold any."""
    key = points[0]
    for p in points[1:]:
        key = (key << 21) | p
    return key


class PieceCoder:
    """The model's tables, which a Python worker keeps, and a table of chunks, bounded in bytes, which a task drops."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        norm, trained = model.normalizer_spec, model.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not model.denormalizer_spec.precompiled_charsmap
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, a space put before the text and no normalization")
        ranked = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ranked):
            raise ValueError("a piece goes on past a word into the next space")
        self.size = len(model.pieces)
        self.unknown, self.control = trained.unk_id, {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.byte_ids = np.zeros(256, np.int64)
        said: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.is_byte[i] = i, True
                said.append(bytes([value]))
            else:
                said.append(trained.unk_surface.encode() if p.type == kinds.UNKNOWN else b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode())
        self.said_len = np.array([len(s) for s in said], np.int64)
        self.said_start = np.concatenate([[0], np.cumsum(self.said_len)])[:-1]
        self.said_bytes = np.frombuffer(b"".join(said), np.uint8)
        letters = sorted((ord(p), i) for p, (_, i) in ranked.items() if len(p) == 1)
        self.char_points, self.char_ids = (np.array(x, np.int64) for x in zip(*letters, strict=True))
        # Every way to put a piece together from two others; equal scores share a rank.
        scores = {s: r for r, s in enumerate(sorted({s for p, (s, _) in ranked.items() if len(p) > 1}, reverse=True))}
        pairs = [(ranked[p[:k]][1] * self.size + ranked[p[k:]][1], scores[s], i) for p, (s, i) in ranked.items() for k in range(1, len(p)) if p[:k] in ranked and p[k:] in ranked]
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        # Pieces that can start or end a pair with a better score than their own: few vocabularies have many.
        own = np.full(self.size, _NONE)
        own[self.merged] = self.ranks
        self.opens, self.closes = np.zeros(self.size, bool), np.zeros(self.size, bool)
        first, second = np.divmod(self.keys, self.size)
        self.opens[first[(self.ranks < own[first]) & (own[first] != _NONE)]] = True
        self.closes[second[(self.ranks < own[second]) & (own[second] != _NONE)]] = True
        self.bigrams = np.unique(np.array([_joined([*_points(p)]) for p in ranked if len(p) == 2], np.int64))
        self.trigrams = np.unique(np.array([_joined([*_points(p[k : k + 3])]) for p in ranked for k in range(len(p) - 2)], np.int64))
        self.table_bytes = table_bytes
        self.forget()

    def forget(self) -> None:
        """Drop the table of chunks."""
        self.index: dict[str, int] = {}
        self.held = 0
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id_texts: list[str] = []
        self.decoded: list[str] = []

    def uncrossed(self, text: str) -> np.ndarray:
        """Positions in the text (spaces as marks) between characters that no piece spans.

        A piece over both is the two characters, or has them and one character before or after.
        """
        p = _points(text)
        if len(p) < 2:
            return np.zeros(0, np.int64)
        crossed = _member(self.bigrams, _joined([p[:-1], p[1:]]))[1]
        if len(p) > 2:
            three = _member(self.trigrams, _joined([p[:-2], p[1:-1], p[2:]]))[1]
            crossed[:-1] |= three
            crossed[1:] |= three
        return np.flatnonzero(~crossed) + 1

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, and how many each has.

        The library merges the pair with the best score, the leftmost of equal ones, until there is none. A round does
        all merges of a chunk's best score from the left, up to the first that makes a pair with a better one.
        """
        points = _points("".join(chunks))
        at, known = _member(self.char_points, points)
        sym = np.where(known, self.char_ids[at], self.size + points)
        word = np.repeat(np.arange(len(chunks)), np.array([len(c) for c in chunks], np.int64))
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []

        def look(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            where, there = _member(self.keys, a * self.size + b)
            return where, np.where(there & same & (a < self.size) & (b < self.size), self.ranks[where], _NONE)

        while len(sym) > 1:
            where, rank = look(sym[:-1], sym[1:], word[:-1] == word[1:])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.concatenate([first, [len(sym)]]))
            rank = np.concatenate([rank, [_NONE]])
            low = np.repeat(np.minimum.reduceat(rank, first), counts)
            live = low != _NONE
            if not live.all():  # finished chunks leave the array
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                where = np.concatenate([where, [0]])[live]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == low)
            if len(hits) > 1:  # of overlapping ones every second counts, from the left
                fresh = np.concatenate([[True], np.diff(hits) != 1])
                base = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - base) % 2 == 0]
            made, owner = self.merged[where[hits]], word[hits]
            odd = np.flatnonzero(self.opens[made] | self.closes[made]) if len(hits) > 1 else hits[:0]
            if len(odd):
                own, place, best = made[odd], hits[odd], low[hits[odd]]
                before, after = np.maximum(place - 1, 0), np.minimum(place + 2, len(sym) - 1)
                beside = (odd > 0) & (place - hits[np.maximum(odd - 1, 0)] == 2)  # the merge before made the left neighbour
                left = np.where(beside, made[np.maximum(odd - 1, 0)], sym[before])
                better = look(left, own, (place > 0) & (word[before] == owner[odd]))[1] < best
                better |= look(own, sym[after], (place + 2 < len(sym)) & (word[after] == owner[odd]))[1] < best
                if better.any():
                    stop = np.zeros(len(hits), np.int64)
                    stop[odd[better]] = 1
                    so_far = np.cumsum(stop) - stop
                    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    base = np.repeat(so_far[start], np.diff(np.concatenate([start, [len(hits)]])))
                    hits, made = hits[so_far == base], made[so_far == base]
            sym = sym.copy()
            sym[hits] = made
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            sym, word = sym[keep], word[keep]
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], len(chunks))

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [chr(c).encode("utf-8") for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            at = np.concatenate([[0], np.cumsum(times)])[:-1]
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[_spread(at[odd], times[odd])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.int32), np.bincount(word, minlength=n).astype(np.int64)

    def _slices(self, text: str) -> Iterator[str]:
        """The text as the model sees it, in slices of about SLICE characters cut where no piece spans."""
        at, first = 0, MARK
        while at < len(text):
            end, near, width = len(text), at + SLICE, 4096
            while near < len(text):
                cuts = self.uncrossed(text[near - 2 : near + width].replace(" ", MARK))
                cuts = cuts[(cuts >= 2) & (near - 2 + cuts < min(len(text), near + width - 1))]  # those whose neighbours were seen
                if len(cuts):
                    end = near - 2 + int(cuts[0])
                    break
                near, width = near + width - 2, min(2 * width, SLICE)
            yield first + text[at:end].replace(" ", MARK)
            at, first = end, ""

    def rows(self, parts: list[str]) -> list[np.ndarray]:
        """The table's rows for the chunks of every slice, in order; new chunks are added to the table."""
        if self.held > self.table_bytes:
            self.forget()
        found = [_CHUNKS.findall(part) for part in parts]
        for k, chunks in enumerate(found):
            if max(map(len, chunks), default=0) > LONG:
                found[k] = [c for long in chunks for c in (self._parts(long) if len(long) > LONG else (long,))]
        fresh = list({c for chunks in found for c in chunks}.difference(self.index))
        for i in range(0, len(fresh), 32_768):
            some = fresh[i : i + 32_768]
            ids, lens = self.segment(some)
            base = len(self.lens)
            starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])
            self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
            self.index.update(zip(some, range(base, base + len(some)), strict=True))
            names, ends = ids.tolist(), (starts + lens).tolist()
            self.id_texts += [",".join(map(str, names[a:z])) for a, z in zip(starts.tolist(), ends, strict=True)]
            # A chunk that decodes to itself, as it should, is kept once: with its marks, which become spaces later.
            self.decoded += [c if c.replace(MARK, " ") == d else d for c, d in zip(some, self._plain_each(ids, lens), strict=True)]
            self.held += 20 * len(ids) + sum(map(len, some)) + _CHUNK_COST * len(some)
        get = self.index.__getitem__
        return [np.fromiter(map(get, chunks), np.int64, len(chunks)) for chunks in found]

    def _plain_each(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The decoded text of every chunk; chunks end where characters do."""
        sizes = np.concatenate([[0], np.cumsum(self.said_len[ids])])
        ends = sizes[np.cumsum(lens)].tolist()
        raw = self.said_bytes[_spread(self.said_start[ids], self.said_len[ids])].tobytes()
        return [raw[a:z].decode("utf-8") for a, z in zip([0, *ends[:-1]], ends, strict=True)]

    def _walk(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, table rows) of every slice, in order; slices of about SLICE characters are looked up together."""
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self._slices(text):
                held.append((k, part))
                size += len(part)
                if size >= SLICE:
                    yield from zip([k for k, _ in held], self.rows([p for _, p in held]), strict=True)
                    held, size = [], 0
        yield from zip([k for k, _ in held], self.rows([p for _, p in held]), strict=True)

    def _parts(self, chunk: str) -> list[str]:
        cuts = [0, *self.uncrossed(chunk).tolist(), len(chunk)]
        return [chunk[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text (int32)."""
        out = [[np.zeros(0, np.int32)] for _ in texts]
        for k, rows in self._walk(texts):
            out[k].append(self.ids[_spread(self.starts[rows], self.lens[rows])])
        return [np.concatenate(parts) for parts in out]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """How many ids each text has, the digest of their decimals joined by commas, and that of the decoded text."""
        counts = [0] * len(texts)
        ids, said = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for k, rows in self._walk(texts):
            listed, later = rows.tolist(), counts[k] > 0
            counts[k] += int(self.lens[rows].sum())
            ids[k].update(("," * later + ",".join([self.id_texts[r] for r in listed])).encode())
            said[k].update("".join([self.decoded[r] for r in listed]).replace(MARK, " ")[0 if later else 1 :].encode())
        return [(n, i.hexdigest(), s.hexdigest()) for n, i, s in zip(counts, ids, said, strict=True)]

    def _plain(self, ids: np.ndarray) -> str:
        if (self.said_len[ids] == 0).any():  # a control piece shows nothing, yet parts the bytes around it
            return self._mended(ids)
        try:
            return self.said_bytes[_spread(self.said_start[ids], self.said_len[ids])].tobytes().decode("utf-8")
        except UnicodeDecodeError:
            return self._mended(ids)

    def _mended(self, ids: np.ndarray) -> str:
        """Bytes that are no character become U+FFFD each; characters don't go on across other pieces."""
        out: list[str] = []
        edges = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        for run in np.split(ids, edges):
            raw = self.said_bytes[_spread(self.said_start[run], self.said_len[run])].tobytes()
            while raw:
                try:
                    out.append(raw.decode("utf-8"))
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode("utf-8") + "�")
                    raw = raw[e.start + 1 :]
        return "".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that was put before it."""
        ids = np.asarray(ids, np.int64)
        text = self._plain(ids)
        shown = np.flatnonzero(self.said_len[ids] > 0)
        drop = len(shown) and not self.is_byte[ids[shown[0]]] and ids[shown[0]] != self.unknown and text.startswith(" ")
        return text[1:] if drop else text


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """The worker's own coder."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def _encoded(docs: DataFrame, path: str, keep: tuple[str, ...], columns: list[tuple[str, str]], fn) -> DataFrame:
    """The kept columns and what fn(coder, texts) gives for ``columns`` (name, type), in bounded batches."""
    assert os.path.exists(path), path
    rows = docs.select(*keep, whole_text().alias("text"))
    schema = rows.select(*keep, *(F.lit(None).cast(kind).alias(c) for c, kind in columns)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in text_chunks(batches, SLICE):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *fn(own, batch.column("text").to_pylist())], [*keep, *(c for c, _ in columns)])
        own.forget()
        release_memory()

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with ids (array<int>) and decoded (string).

    Null and empty texts have no ids and decode to the empty text; names of control pieces written out in a text are
    ordinary text, as in the library. Repeated rows are encoded each; an empty table gives an empty one. A column of the
    input named text, ids or decoded can't be kept; columns not kept are not read.
    """

    def fn(own: PieceCoder, texts: list[str]) -> list[pa.Array]:
        ids = own.encode(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
        return [flat, pa.array([own.decode(x) for x in ids], pa.string())]

    return _encoded(docs, model or default_model(), keep, [("ids", "array<int>"), ("decoded", "string")], fn)


def encode_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, without any of its ids held together.

    A null text counts as empty: no tokens, both digests of nothing. Repeated rows give equal digests, an empty table an
    empty one. Only doc_id and text are read, so further columns of any name do no harm.
    """

    def fn(own: PieceCoder, texts: list[str]) -> list[pa.Array]:
        found = own.digests(texts)
        return [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _encoded(docs, model or default_model(), ("doc_id",), [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], fn)


def op11_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
