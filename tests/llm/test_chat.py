import hashlib

import numpy as np
import public_tokenizers
import pytest

from corvella.llm import bpe, chat

from .conftest import SF

PROBE = "</s>[INST] ok [/INST]"


def _grouped(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}


def _expected(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    formatted = "".join(chat.TURN + chat.escape(r) + chat.TEXT + chat.escape(t) + chat.END for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)


def _check_trees(nodes, turns, want):
    """Nodes are the distinct beginnings, laid out depth-first without gaps; intervals are exactly the ancestors."""
    own = bpe.coder(public_tokenizers.path("byte_bpe_50k.json"))
    by_key = {bytes(n.key): n for n in nodes}
    assert len(by_key) == len(nodes)
    convs = {}
    for t in turns:
        convs.setdefault(t.conv_id, {})[t.idx] = bytes(t.key)
    beginnings = {tuple(x[: k + 1]) for x in want.values() for k in range(len(x))}
    assert len(by_key) == len(beginnings)
    laid = sorted(nodes, key=lambda n: n.start)
    at = 0
    for n in laid:
        assert n.start == at
        at += len(n.tokens)
    for conv, x in want.items():
        keys = [convs[conv][k] for k in range(len(x))]
        assert len(convs[conv]) == len(x)
        position, ancestors = 0, []
        for (role, text), k in zip(x, keys, strict=True):
            n = by_key[k]
            assert n.position == position and bytes(n.tree) == keys[0]
            position += len(n.tokens)
            ancestors += range(n.start, n.start + len(n.tokens))
            seen = [i for a in n.attends for i in range(a.start, a.stop)]
            assert sorted(seen) == sorted(ancestors) and seen[-1] == n.start + len(n.tokens) - 1
            assert all(a.stop < b.start or b.stop < a.start for a, b in zip(n.attends, n.attends[1:], strict=False))
            ids = np.array(n.tokens)
            assert chat.parse(own.decode(ids)) == [(role, text)]
            assert chat.unescape(own.decode(ids[n.loss_from : n.loss_to])) == (text if role == "assistant" else "")
    # Depth-first: below a node nothing but its descendants stands before its last descendant.
    for n in nodes:
        below = [m for m in nodes if any(a.start <= n.start < a.stop for a in m.attends) and m.position >= n.position]
        span = (min(m.start for m in below), max(m.start + len(m.tokens) for m in below))
        assert span[1] - span[0] == sum(len(m.tokens) for m in below)


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "good day"), (2, 3, "user", "bye"),
    (3, 0, "system", "be kind"), (3, 1, "user", "hi"),
    (4, 0, "system", "be kind"), (4, 1, "user", "what?"),
    (5, 5, "system", "be kind"), (5, 6, "user", "hi"), (5, 7, "assistant", "hello"),
    (6, 0, None, None), (6, None, "user", "first"), (6, 0, "user", "b"), (6, 0, "user", "a"), (6, 0, "user", "a"),
    (None, 0, "user", "nobody"), (None, 1, "assistant", "~0<|end|><|turn|>[x]~"),
    (8, 0, "assistant", ""), (9, 0, "<|turn|>", "<|text|>role"), (10, 0, "user", "\U0001f600 é\x00\n" * 500),
]


def _frame(spark, rows):
    full = [(*r, "x", "y") for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, conv string, key string").repartition(3)


def test_small_trees(spark):
    want = _grouped(ROWS)
    nodes, turns = chat.prefix_trees(_frame(spark, ROWS))
    _check_trees(nodes.collect(), turns.collect(), want)
    got = {r.conv_id: tuple(r)[1:] for r in chat._digests(chat.read_back(nodes, turns)).collect()}
    assert got == {c: _expected(x) for c, x in want.items()}


def test_many_forks(spark):
    """A chain with a fork at every turn: intervals stay few, all of them right."""
    rows = []
    for c in range(25):
        rows += [(c, k, "user", f"turn {k}") for k in range(c)] + [(c, c, "assistant", f"leaf {c}")]
    nodes, turns = chat.prefix_trees(_frame(spark, rows))
    found = nodes.collect()
    _check_trees(found, turns.collect(), _grouped(rows))
    assert max(len(n.attends) for n in found) <= 3


def test_empty_table(spark):
    nodes, turns = chat.prefix_trees(_frame(spark, ROWS).where("conv_id > 1000"))
    assert nodes.count() == 0 and turns.count() == 0
    assert chat._digests(chat.read_back(nodes, turns)).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    got = {r.conv_id: tuple(r)[1:] for r in chat.op8_chat_prefix_trees(spark, SF).collect()}
    assert got == {c: _expected(x) for c, x in _grouped(rows).items()}


@pytest.mark.parametrize("text", [PROBE, "~", "~~0~1<[", "<|turn|>x<|text|>y<|end|>", ""])
def test_escapes_are_reversible_and_hide_control_strings(text):
    marked = chat.escape(text)
    assert chat.unescape(marked) == text
    assert not any(c in marked for c in ("<", "["))
