import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest

from corvella.llm import media

from .conftest import SF, odd_rows


def _payload(text):
    raw = (text or "").encode()
    return raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))


def _unpng(data):
    """A plain reader of grey 8-bit images."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, kinds, packed, width = 8, [], b"", 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        kinds.append(kind)
        if kind == b"IHDR":
            width = int.from_bytes(body[:4], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        if kind == b"IDAT":
            packed += body
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:].tobytes()


def _check(rows, got):
    want = sorted((repr(i), len((t or "").encode()), len(_payload(t)), hashlib.sha256(_payload(t)).hexdigest(), zlib.crc32(_payload(t)[-16:])) for i, t, _ in rows)
    assert sorted((repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature, r.digest))
    assert all(len(x) == 1 for x in same.values())
    assert all(r.digest == r.payload_sha256 and r.width == 192 and r.height == r.payload_bytes // 192 for r in got)


def test_whole_table(spark, sf_docs):
    rows = [(r.doc_id, r.text, r.source) for r in sf_docs.collect()]
    _check(rows, media.op2_media_columns(spark, SF).collect())


def test_stored_members_are_whole_images_in_tar_files(odd_docs, tmp_path):
    got = media.media_columns(odd_docs, str(tmp_path)).collect()
    _check(odd_rows(), got)
    texts = {hashlib.sha256(_payload(t)).hexdigest(): t for _, t, _ in odd_rows()}
    found = set()
    for shard in tmp_path.glob("*.tar"):
        with tarfile.open(shard) as tar:
            for m in tar.getmembers():
                digest = m.name.removesuffix(".png")
                assert _unpng(tar.extractfile(m).read()) == _payload(texts[digest])
                found.add((shard.name, digest, m.offset_data, m.size))
    for r in got:
        assert (r.shard, r.digest, r.offset, r.media_bytes) in found
        with open(tmp_path / r.shard, "rb") as f:
            f.seek(r.offset)
            assert hashlib.sha256(f.read(r.media_bytes)).hexdigest() == r.media_sha256


def test_empty_table(no_docs, tmp_path):
    assert media.media_columns(no_docs, str(tmp_path)).count() == 0
    assert not list(tmp_path.glob("*.tar"))


def test_headers_are_read_alone():
    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            Counting.n += size
            return super().read(size)

    image = media.png_encode(_payload("x" * 5000))
    file = Counting(b"pad" + image)
    file.seek(3)
    assert media.png_header(file.read(media.HEADER_BYTES)) == (192, 27, 8) and Counting.n == 33
    with pytest.raises(ValueError):
        media.png_header(image[1:34])


def test_a_worker_that_forgets_digests_stores_again_but_returns_one_place(make_docs, tmp_path):
    rows = [(i, f"text {i % 5}", "a") for i in range(60)]
    index = media.store(make_docs(rows, parts=2), str(tmp_path), remembered=2).collect()
    assert len(index) == len({r.digest for r in index}) == 5


def test_features_are_whole_numbers():
    feature = media._feature(bytes(range(192)), 192, 1)
    total = sum(range(192))
    assert feature.split(":")[:2] == ["192x1", str(1000 * total // 192)]
    assert sum(map(int, feature.split(":")[3].split("-"))) == 192
