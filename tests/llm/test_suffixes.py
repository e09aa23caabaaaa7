import hashlib
import random
import time

import pytest

from corvella.llm import suffixes

from .conftest import odd_rows


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "abcdefgh"])
def test_suffix_array(alphabet):
    rng = random.Random(len(alphabet))
    for n in [0, 1, 2, 3, 10, 60, 400]:
        s = [ord(rng.choice(alphabet)) for _ in range(n)] + [0]
        assert list(suffixes.suffix_array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def _brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept sha256) of every text."""
    raws = [(t or "").encode() for t in texts]
    count = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _got(docs, **kw):
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.cut_repeats(docs, **kw).collect())


def _want(rows, length):
    return sorted((repr(i), *x) for (i, _, _), x in zip(rows, _brute([t for _, t, _ in rows], length), strict=True))


@pytest.mark.parametrize(("seed", "limit"), [(1, 1 << 20), (2, 200), (3, 40)])
def test_random_tables(make_docs, seed, limit):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(15, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if rng.random() < 0.2 and text:
            text = text[: rng.randrange(len(text))] + "Z" + text
        rows.append((i, text, "a"))
    rows += [(200, "ab" * 60, "a"), (201, "a" * 100, "a"), (202, "a" * 25, "a")]
    assert _got(make_docs(rows), length=20, gram=6, limit=limit) == _want(rows, 20)


def test_whole_table(spark, sf_docs):
    rows = [(r.doc_id, r.text, r.source) for r in sf_docs.collect()]
    want = _want(rows, 200)
    assert _got(sf_docs) == want
    assert any(w[2] for w in want)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op3_suffix_dedup(spark, "/root/testdata/sf0.001").collect()) == want


def test_odd_rows(odd_docs, no_docs):
    assert _got(odd_docs) == _want(odd_rows(), 200)
    assert suffixes.cut_repeats(no_docs).count() == 0


def test_long_texts_go_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 64)
    rng = random.Random(9)
    for _ in range(20):
        raw = bytes(rng.choice(b"abc") for _ in range(rng.randrange(20, 400)))
        places, _, lo, hi = suffixes.anchors(raw, 20, 6)
        covered = sorted(w for a, z in zip(lo.tolist(), hi.tolist(), strict=True) for w in range(a, z - 19))
        assert covered == list(range(len(raw) - 19))
        assert all(a <= p <= z - 6 for p, a, z in zip(places.tolist(), lo.tolist(), hi.tolist(), strict=True))


def test_rows_repeated_in_full_take_linear_time(make_docs):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ijkl") for _ in range(5600))
    rows = [(1, text, "a")] * 20_000 + [(k, text[:900] + f" own words of {k} " * 20, "a") for k in range(2, 12)]
    began = time.monotonic()
    got = _got(make_docs(rows))
    assert time.monotonic() - began < 60
    want = _brute([text, text, *(t for _, t, _ in rows[20_000:])], 200)
    assert got == sorted([("1", *want[0])] * 20_000 + [(repr(k), *w) for k, w in zip(range(2, 12), want[2:], strict=True)])
