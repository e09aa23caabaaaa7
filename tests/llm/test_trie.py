import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvella.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The contract, by brute force."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        yield p
        for k in kids[p]:
            yield from below(k)

    out = []
    for p, convs in members.items():
        subtree = list(below(p))
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(p))))
        out.append(
            (min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids[p]), sum(not kids[x] for x in subtree), sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, trie.turn_trie(df).select(*NAMES).collect()), key=repr)


def _rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), *range(-30, -20), -100, 10**12]:  # 200 and others are absent
        for t in range(rng.choice([0, 1, 2, 3, 6, 8, 11])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(["hi", "why?", "é\U0001f600", ""])))
    rows += [(3, None, "system", "first"), (3, None, None, "first"), (4, 2, "user", None), (4, 2, "user", None), (5, 1, "b", "tie"), (5, 1, "a", "tie"), (5, 1, "a", "sie"), (None, 0, "user", "nobody's"), (None, None, None, None), (77, 0, None, None)]
    rows += [(c, t, "user", "same words") for c in range(10_000, 10_090) for t in range(7)]  # copies
    rows += [(c, t, "user", f"step {t}" if t < c - 20_000 else "off") for c in range(20_001, 20_031) for t in range(c - 20_000 + 1)]  # a tall tree of chains
    rows += [(30_000, t, "user", f"{t % 7} {'x' * (t % 5)}") for t in range(900)]  # a hot conversation
    rng.shuffle(rows)
    return rows


def test_against_brute_force_with_odd_rows(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select("*", *(F.lit("x").alias(c) for c in ("conv", "depth", "key", "owner", "part", "n", "idx", "base", "up", "g0")))
    assert found(df) == plain(rows)


def test_hot_groups_split_over_ranges(spark, monkeypatch):
    """One node with most ends, joined piece by piece over several ranges."""
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(c, 0, "user", "all alike") for c in range(0, 900)] + [(c, t, "user", "x") for c in (5, 7) for t in (1, 2)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 0, "user", "gone")], [(300, None, None, None)]])
def test_small_tables(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_the_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
