import random
import re

import pytest
import xxhash

from corvella.llm import simhash

from .conftest import SF, odd_rows


def _fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    """doc_id of the least member, by comparing all pairs of different fingerprints."""
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints.items():
        root = find(f)
        least[root] = min(least.get(root, i), i)
    return {i: least[find(f)] for i, f in prints.items()}


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 2])
def test_whole_table_by_all_pairs(sf_docs, limit):
    prints = {r.doc_id: _fingerprint(r.text) for r in sf_docs.collect()}
    want = _components(prints)
    rows = simhash.near_duplicates(sf_docs, limit).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 40])
def test_links_among_crowded_fingerprints(spark, limit):
    """Clusters, chains and many fingerprints that share bit blocks, against all pairs."""
    rng = random.Random(limit)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(8):
            prints.add(f)
            f ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 0b111 << rng.randrange(60)
    base = rng.getrandbits(22) << 42
    prints |= {base | rng.getrandbits(42) for _ in range(300)} | {base | 1 << i for i in range(42)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), limit).collect()
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for e in edges:
        a, b = e.a % 2**64, e.b % 2**64
        parent[find(a)] = find(b)
    want = _components({f: f for f in prints})
    least = {}
    for f in prints:
        root = find(f)
        least[root] = min(least.get(root, f), f)
    assert {f: least[find(f)] for f in prints} == want


def test_pivots_discard_no_link():
    rng = random.Random(5)
    import numpy as np

    a = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    b = a ^ np.array([(1 << rng.randrange(64)) | (1 << rng.randrange(64)) for _ in a], np.uint64)
    assert (np.abs(simhash.pivot_distances(a) - simhash.pivot_distances(b)) <= 2).all()


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert sorted((repr(r.doc_id), r.fingerprint) for r in rows) == sorted((repr(i), f"{_fingerprint(t):016x}") for i, t, _ in odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values())
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_keeps_one_row_of_each_component(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    components = {r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert len(ids) == len(components) and set(ids) == components
    assert simhash.keep_one(no_docs).count() == 0


def test_query_returns_every_row(spark, sf_docs):
    assert simhash.op9_simhash_components(spark, SF).count() == sf_docs.count()


@pytest.mark.parametrize("n", [0, 1 << 10, 1 << 19, 1 << 21, 1 << 32, 1 << 36, 1 << 60])
def test_close_fingerprints_share_a_key_at_any_size(n):
    keys = simhash.block_keys(n)
    rng = random.Random(n)
    assert all(sum(bits for _, bits in key) >= min(n.bit_length() + 1, 42) for key in keys)
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(all((a >> low) % (1 << bits) == (b >> low) % (1 << bits) for low, bits in key) for key in keys)


@pytest.mark.parametrize("blocks", [(4,), (5,), (6,)])
def test_longer_keys_give_the_same_components(sf_docs, monkeypatch, blocks):
    want = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(sf_docs).collect())
    monkeypatch.setattr(simhash, "_BLOCKS", blocks)
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(sf_docs).collect()) == want
