import random

import pytest

import corpus_pipeline as P
from corvella.llm import nearcopies, simhash

from .conftest import SF, odd_rows


def _shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    """Least id of every component, by the Jaccard similarity of all pairs."""
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


@pytest.mark.parametrize("crowd", [nearcopies.CROWD, 2])
def test_edited_copies_against_all_pairs(spark, make_docs, crowd):
    """Copies with words changed and cut, around the limit, long and short, with a line that all share."""
    rng = random.Random(crowd)
    line = " ".join(f"shared{k}" for k in range(12))
    texts = ["", " ", "one two", "One  two", "one two three", *(f"{line} tail{k}" for k in range(12))]
    for k in range(14):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((20, 60, 200, 900)))]
        for _ in range(8):
            edited = list(words)
            for _ in range(rng.randrange(1 + len(words) // 30)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join([*([line] if k % 2 else []), *edited[: rng.randrange(len(words) * 9 // 10, len(words) + 1)]]))
    rows = [(i, t) for i, t in enumerate(texts)]
    kept = nearcopies.keep_one(make_docs([(i, t, "a") for i, t in rows]), crowd=crowd).collect()
    assert sorted(r.doc_id for r in kept) == _kept(rows)
    assert len(kept) < len(rows) - 40


def test_stage_on_whole_table(spark, sf_docs):
    kept = P.near_duplicates(spark, sf_docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == _kept([(r.doc_id, r.text) for r in sf_docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    kept = nearcopies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 7, 8, 10]
    assert nearcopies.keep_one(no_docs).count() == 0 < len(odd_rows())


def test_fingerprints_link_first(make_docs, monkeypatch):
    """Links of fingerprints by pivots and bit blocks come before prefix filtering, which gets what they leave apart."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(4000)}" for _ in range(900)]
    copies = [" ".join([*words[:-k], f"end{k}"]) for k in range(1, 6)]
    far = " ".join(w if k % 150 else f"x{k}" for k, w in enumerate(words))
    rows = [*enumerate(copies), (9, "other words " * 30), (10, far)]
    link, between, linked, left = simhash.link_fingerprints, nearcopies._between, [], []
    monkeypatch.setattr(simhash, "link_fingerprints", lambda classes, *a: linked.append(classes.count()) or link(classes, *a))
    monkeypatch.setattr(nearcopies, "_between", lambda pairs, roots: left.append((pairs.count(), between(pairs, roots).count())) or between(pairs, roots))
    kept = nearcopies.keep_one(make_docs([(i, t, "a") for i, t in rows])).collect()
    assert sorted(r.doc_id for r in kept) == _kept(rows) == [0, 9]
    assert len(linked) == 1 and linked[0] > 1
    assert left[0][1] < left[0][0]
