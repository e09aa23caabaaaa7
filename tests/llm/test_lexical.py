import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.llm import lexical

from .conftest import CLASHING, SF, odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    """The contract, document by document."""
    split = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_all = len(split), sum(n for _, _, n in split)
    df = Counter(w for _, c, _ in split for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, counts, n in split:
            m = 10 + (90 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * counts[w]) // (1000 * counts[w] + 8 * m)) for w in words if w in counts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@given(st.text(max_size=80))
def test_terms(text):
    text = text.encode("utf-8", "replace").decode()
    assert [w.decode() for part in lexical.terms_of(text) for w in part] == terms(text)


def test_terms_of_a_long_text_come_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 10)
    text = "one,TWO three-fOur " * 30 + "x" * 50 + " é"
    parts = list(lexical.terms_of(text))
    assert len(parts) > 20 and [w.decode() for p in parts for w in p] == terms(text)


@given(st.lists(st.integers(0, 2**50), max_size=60))
def test_radix_order_is_stable(keys):
    keys = np.array(keys, np.int64) % 2**40
    assert lexical.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def _corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "Ab", "aB", "日本", "the", "THE", "the"]
    docs = [(i - 40, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9, 60])))) for i in range(300)]
    docs += [(1000 + i, "Ab w1 w2, the end") for i in range(40)]  # copies: many equal scores
    docs += [(1000, "Ab w1 w2, the end")] * 3 + [(i, t) for i, t, _ in odd_rows()]
    items = [(1, "ab W1 w2"), (2, "the THE the É!"), (3, None), (3, "w5"), (3, "w5 w6"), (4, ""), (None, "w7 w8 日本"), (5, "nowhere_at_all"), (6, " ".join(words)), (6, " ".join(words)), (-7, "gamma text")]
    return docs, items


def _tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return d.select("*", *(F.lit("x").alias(c) for c in CLASHING)), i.select("*", F.lit("x").alias("item"), F.lit("y").alias("term"), F.lit(1).alias("n"))


@pytest.mark.parametrize("impacts,block", [(1 << 21, 64 << 20), (7, 600)])
def test_against_every_pair(spark, monkeypatch, impacts, block):
    """Also with tiny slices and several blocks of items."""
    monkeypatch.setattr(lexical, "IMPACTS", impacts)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    docs, items = _corpus()
    assert found(lexical.ranked_search(*_tables(spark, docs, items))) == plain(docs, items)
    if block < 1000:
        assert found(lexical.ranked_search(*_tables(spark, docs, items), top=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = _corpus()
    assert found(lexical.ranked_search(*_tables(spark, [], items))) == []
    assert found(lexical.ranked_search(*_tables(spark, docs, []))) == []
    assert found(lexical.ranked_search(*_tables(spark, [(1, None), (2, " ,")], items))) == []


def test_the_given_tables(spark):
    d, b = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda t, *c: [tuple(r) for r in t.select(*c).collect()]
    assert found(lexical.ranked_search(d, b)) == plain(rows(d, "doc_id", "text"), rows(b, "item_id", "text"))
