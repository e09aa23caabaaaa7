import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import mixing

from .conftest import SF, odd_rows


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _targets(sizes):
    """sizes by source in order; weights 1, 2, 3, 1, ...; shares are lowered to 3 sizes until none is above."""
    weights = {s: 1 + i % 3 for i, s in enumerate(sizes)}
    total, out, free = sum(sizes.values()), {s: 0.0 for s in sizes}, [s for s in sizes if sizes[s]]
    left = float(total)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if unit * weights[s] > 3 * sizes[s]]
        if not over:
            out |= {s: unit * weights[s] for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def _check(rows, got, block):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + _size(t)
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    want = _targets(sizes)
    assert Counter((repr(i), _size(t), sizes[s]) for i, t, s in rows) == Counter((repr(r.doc_id), r["size"], r.source_size) for r in got)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1.0, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * block + 0.005 * t, (s, taken[s], t)


def _rows(documents):
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken").collect()


def test_whole_table(spark, sf_docs):
    documents, _ = mixing.mix(sf_docs)
    rows = [(r.doc_id, r.text, r.source) for r in sf_docs.collect()]
    got = _rows(documents)
    _check(rows, got, mixing.BLOCK_WORDS)
    again = {r.doc_id: r.taken for r in mixing.op10_mixed_sources(spark, SF).collect()}
    other = {r.doc_id: r.taken for r in _rows(mixing.mix(sf_docs.repartition(9))[0])}
    assert again == other == {r.doc_id: r.taken for r in got}


def test_slots_take_blocks_of_the_planned_sources(sf_docs):
    """Every slot of a source is filled once, by one block; a pass takes a block at most once."""
    documents, pieces = mixing.mix(sf_docs, block_words=50, shards=7)
    plans = mixing.plan_sources(documents, 50).collect()
    found = pieces.select("source_no", "slot", "pass", "block", "shard").distinct().collect()
    by = Counter(r.source_no for r in found)
    assert all(by[p.source_no] == p.slots for p in plans)
    assert len({(r.source_no, r["pass"], r.block) for r in found}) == len(found)
    per_shard = Counter(r.shard for r in found)
    assert max(per_shard.values()) - min(per_shard.values()) <= 7
    for p in plans:
        assert all(r["pass"] < 3 and 0 <= r.block < p.blocks for r in found if r.source_no == p.source_no)


def test_odd_rows(odd_docs, no_docs):
    documents, _ = mixing.mix(odd_docs, block_words=4)
    _check(odd_rows(), _rows(documents), 4)
    assert mixing.mix(no_docs)[0].count() == 0
    assert mixing.keep_mixed(no_docs).count() == 0


def test_kept_rows_hold_the_words_taken(odd_docs):
    documents, _ = mixing.mix(odd_docs, block_words=4)
    kept = mixing.keep_mixed(odd_docs, block_words=4)
    assert kept.columns == odd_docs.columns
    words = Counter()
    texts = {(repr(i), s): t for i, t, s in odd_rows()}
    for r in kept.collect():
        words[repr(r.doc_id), r.source] += _size(r.text)
        whole = re.findall(r"[^\x20\x09-\x0D]+", texts[repr(r.doc_id), r.source])
        assert set(re.findall(r"[^\x20\x09-\x0D]+", r.text)) <= set(whole)
    taken = Counter()
    for r in _rows(documents):
        taken[repr(r.doc_id), r.source] += r.taken
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_repeated_rows_keep_their_own_columns(spark):
    rows = [(1, "a b c d", "s", i) for i in range(200)] + [(2, "x " * 50, "t", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_no long").repartition(5)
    kept = mixing.keep_mixed(docs, block_words=2)
    assert kept.columns == docs.columns
    taken = {r.row_no: r.n for r in kept.groupBy("row_no").agg(F.count("*").alias("n")).collect()}
    sizes = {r.source: r.target for r in mixing.mix(docs, block_words=2)[0].select("source", "target").distinct().collect()}
    words = Counter()
    for r in kept.collect():
        words[r.source] += _size(r.text)
    assert all(abs(words[s] - t) <= 4 for s, t in sizes.items()) and len(taken) > 150


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    for key in (0, 1, 99):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(out.tolist()) == list(range(n))


def _plan(spark, sizes):
    """Targets of sources of these sizes, in order; weights 1, 2, 3, 1, ..."""
    sized = spark.createDataFrame([(f"s{i:07d}", n) for i, n in enumerate(sizes)], "source string, size long")
    return mixing.plan_sources(sized, 1).orderBy("source_no")


def test_targets_stop_at_three_sizes(spark):
    assert [r.target for r in _plan(spark, [10, 1000]).collect()] == [30.0, 980.0]
    assert [r.target for r in _plan(spark, [0, 0]).collect()] == [0.0, 0.0]
    assert _plan(spark, []).count() == 0
    sizes = [3**i for i in range(12)]
    assert [r.target for r in _plan(spark, sizes).collect()] == pytest.approx(list(_targets(dict(enumerate(sizes))).values()))


def test_sources_without_bound(spark):
    """More sources than ever went through the driver: numbers without a gap, every slot dealt once, shards even."""
    n = 150_000
    sized = spark.range(n).select(F.format_string("s%07d", "id").alias("source"), (1 + F.col("id") % 5).alias("size"))
    plan = mixing.plan_sources(sized, 1)
    stats = plan.agg(F.min("source_no"), F.max("source_no"), F.count_distinct("source_no"), F.sum("source_size"), F.sum("target"), F.sum("slots")).first()
    assert tuple(stats)[:4] == (0, n - 1, n, 3 * n) and abs(stats[4] - 3 * n) < 1e-3
    assert plan.where(F.col("source") != F.format_string("s%07d", "source_no")).count() == 0
    dealt = mixing.dealt_slots(plan, 8, 17).withColumn("n", F.col("last") - F.col("first"))
    by_source = dealt.groupBy("source_no").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    assert by_source.join(plan, "source_no").where("n != slots or last != slots").count() == 0
    per_shard = [r.n for r in dealt.groupBy("shard").agg(F.sum("n").alias("n")).collect()]
    assert sum(per_shard) == stats[5] and len(per_shard) == 8 and max(per_shard) - min(per_shard) <= 1
