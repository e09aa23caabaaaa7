"""Media columns: content-addressed payloads in tar shards.

Every text's payload (its UTF-8 bytes, padded with spaces to a multiple of 192) is stored as a grey PNG, 192 samples
of 8 bits to the row, under its SHA-256. Tasks write shards side by side into the shared folder, each digest once
per task; an index row (digest, shard, offset, length) says where, and of a digest stored by several tasks the first
place counts. Payloads never move through a shuffle: only digests and index rows do. Readers fetch the ranges they
need: 33 bytes for the columns a header fills, or the whole member to check and measure the content.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, shuffle_width, table, text_chunks, whole_text

ROW = 192
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(raw: bytes) -> bytes:
    return raw + b" " * (ROW - len(raw) if not raw else -len(raw) % ROW)


def png_encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG without row filters; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits per sample) from a member's first 33 bytes."""
    if len(head) < HEADER_BYTES or head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", head[16:25])


def png_decode(data: bytes) -> bytes:
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any store Arrow knows by its URI (Hadoop's name for S3 included); a plain path is local."""
    folder = re.sub("^s3[an]://", "s3://", folder)
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class _ShardWriter:
    """Appends members to tar shards of about SHARD_BYTES; a name is never used twice, so a retried task is safe."""

    def __init__(self, folder: str):
        self.fs, self.root = _file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.at, self.name = None, 0, ""

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % tarfile.BLOCKSIZE
        return self.name, offset, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


_INDEX = "digest string, shard string, offset long, media_bytes long"


def store(texts: DataFrame, folder: str, remembered: int = 1_000_000) -> DataFrame:
    """Write the payloads of the column text and return the index (digest, shard, offset, media_bytes), a row a digest.

    A task that has stored ``remembered`` digests forgets them; what it then stores again is merely unused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known = _ShardWriter(folder), set()
        try:
            for batch in text_chunks(batches):
                rows = []
                for text in batch.column("text").to_pylist():
                    payload = pad(text.encode("utf-8"))
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if len(known) >= remembered:
                            known.clear()
                        known.add(digest)
                        rows.append((digest, *writer.add(digest, png_encode(payload))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["digest", "shard", "offset", "media_bytes"])
        finally:
            writer.close()

    # The index is written before it is used: a second evaluation would write the shards again.
    written = materialize(texts.select("text").mapInArrow(run, _INDEX), "media-index")
    first = F.min(F.struct("shard", "offset", "media_bytes")).alias("first")
    return written.groupBy("digest").agg(first).select("digest", "first.*")


def _ranges(index: DataFrame, folder: str, columns: str, read) -> DataFrame:
    """Rows of the index with columns that ``read(file, offset, length)`` fills, shard by shard in offset order."""
    width = shuffle_width(index.sparkSession)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        name, file = None, None
        for b in batches:
            found = []
            for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "media_bytes")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                found.append(read(file, offset, length))
            filled = [pa.array(c) for c in zip(*found, strict=True)] if found else [pa.nulls(0, pa.int64()) for _ in names]
            if found:
                yield pa.RecordBatch.from_arrays([*b.columns, *filled], [*b.schema.names, *names])
        if file is not None:
            file.close()

    return index.repartition(width, "shard").sortWithinPartitions("shard", "offset").mapInArrow(run, f"{_INDEX}, {columns}")


def with_headers(index: DataFrame, folder: str) -> DataFrame:
    """Add width, height and bits by header-only range reads: 33 bytes a member."""

    def read(file, offset: int, length: int) -> tuple[int, int, int]:
        file.seek(offset)
        return png_header(file.read(HEADER_BYTES))

    return _ranges(index, folder, "width long, height long, bits long", read)


def _feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and a 16-bin histogram of the samples, all in whole numbers."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    total, square = int(samples.sum()), int((samples * samples).sum())
    n = len(samples)
    bins = np.bincount(samples >> 4, minlength=16)
    return f"{width}x{height}:{1000 * total // n}:{1000 * (n * square - total * total) // (n * n)}:" + "-".join(map(str, bins.tolist()))


def with_contents(index: DataFrame, folder: str) -> DataFrame:
    """Add what the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""

    def read(file, offset: int, length: int) -> tuple:
        file.seek(offset)
        data = file.read(length)
        payload = png_decode(data)
        width, height, _ = png_header(data[:HEADER_BYTES])
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(data).hexdigest(), _feature(payload, width, height)

    return _ranges(index, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string", read)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset and what header and content give, for every row.

    A null or empty text is a payload of 192 spaces. Equal texts share a member, so repeated rows give equal values;
    so do texts that differ in spaces at the end only, where padding makes them one payload. Only doc_id and text
    are read; an empty table writes no shard.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "media")
    size = F.octet_length(whole_text())
    missing = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW)))
    keyed = docs.select("doc_id", size.cast("long").alias("n_bytes"), F.sha2(F.concat(F.encode(whole_text(), "UTF-8"), F.encode(F.repeat(F.lit(" "), missing), "UTF-8")), 256).alias("digest"))
    index = store(docs.select(whole_text().alias("text")), folder)
    headers = with_headers(index, folder).select("digest", "width", "height", "bits")
    contents = with_contents(index, folder).join(headers, "digest")
    return keyed.join(materialize(contents, "media-contents"), "digest")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset")
