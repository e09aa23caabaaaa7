import zlib
from collections import Counter

import xxhash

from corvella.llm import sharding

from .conftest import SF, odd_rows


def _jump(key, n):
    """The published loop, on Python integers."""
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def _hash(i):
    return xxhash.xxh64_intdigest((i % 2**64).to_bytes(8, "little"), 42)


def test_shards_follow_the_published_loop(spark, sf_docs):
    rows = sharding.op5_jump_shards(spark, SF).collect()
    texts = {r.doc_id: r.text for r in sf_docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert (r.shard, r.grown_shard) == (_jump(_hash(r.doc_id), 40), _jump(_hash(r.doc_id), 41))
        assert r.grown_shard in (r.shard, 40) and r.law == "key"


def test_slots_are_gapless_and_few_keys_move(spark, make_docs):
    rows = sharding.shard_rows(make_docs([(i, "t", "a") for i in range(4000)]), 12, buckets=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(12))
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert 200 < moved < 420  # a 13th of 4000 is 308
    assert max(Counter(r.shard for r in rows).values()) < 420


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_rows(odd_docs, 3).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(i) for i, _, _ in odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.shard_rows(no_docs, 3).count() == 0


def test_one_shard(odd_docs):
    assert {r.shard for r in sharding.shard_rows(odd_docs, 1).collect()} == {0}


def test_plan_is_native(spark):
    plan = sharding.op5_jump_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
