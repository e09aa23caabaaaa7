import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvella.llm import pii

from .conftest import SF, odd_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _base(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if _good(kind, m[0])]
    return sorted(found)


def _expected(text):
    spans = _base(text or "")
    counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
    said = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)
    return (*counts, hashlib.sha256(said.encode()).hexdigest()), {f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans}


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a.@-+_% ()0123459é٣\n"), max_size=40))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == _base(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111 x 4111-1111-1111-1112", "000.255.256.1 1.2.3.4.5.6.7.8", "+49 (0)30 1234567 +1-2 +123456789012345678", "a@b a@b.c a@b.c@d.e ...@x.y", "1" * 5000, "a" * 5000 + "@", "+" * 4000])
def test_corner_texts(text):
    assert pii.base_spans(text) == _base(text)


def test_whole_table(spark, sf_docs):
    want = {r.doc_id: _expected(r.text) for r in sf_docs.collect()}
    rows = pii.op7_private_spans(spark, SF).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows} == {i: w for i, (w, _) in want.items()}
    for r in rows:
        spans = r.spans.split(",") if r.spans else []
        assert want[r.doc_id][1] <= set(spans) and len(set(spans)) == len(spans)
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find_private(odd_docs).collect()
    got = sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    assert got == sorted((repr(i), *_expected(t)[0]) for i, t, _ in odd_rows())
    assert pii.find_private(no_docs).count() == 0
    masked = pii.redact(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    texts = [r.text for r in masked.collect()]
    assert texts.count(None) == 2 and not any("mail@host" in (t or "") for t in texts)
    assert pii.redact(no_docs).count() == 0


def test_patterns_learned_from_seeds_find_what_the_base_misses(make_docs):
    """Seeds follow "account no." ; so does an identifier that no base pattern knows."""
    rows = [(i, f"Some words, account no. user{i}@host{i}.example.org and more", "a") for i in range(30)]
    rows += [(100, "again account no. ZX-9914-77182 stands here", "a"), (101, "the year code 20240101AB is none", "a")]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert found[100] == "context:18:31" and found[101] == ""
    masked = {r.doc_id: r.text for r in pii.redact(make_docs(rows)).collect()}
    assert masked[100] == "again account no. <CONTEXT> stands here" and masked[3] == "Some words, account no. <EMAIL> and more"


def test_an_unsure_pattern_finds_nothing(make_docs):
    rows = [(i, f"number user{i}@host.example.org here", "a") for i in range(10)] + [(50 + i, f"number A{i}12345678 here", "a") for i in range(40)]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert all(found[50 + i] == "" for i in range(40))


def test_common_words_are_no_patterns(make_docs):
    """Seeds often follow "the", but so does all else."""
    rows = [(i, f"write to the user{i}@host.example.org and wait", "a") for i in range(20)] + [(50 + i, "the cat and the dog saw the code AB12345678 on the wall", "a") for i in range(5)]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert all(found[50 + i] == "" for i in range(5))


def test_keys_glued_to_values(make_docs):
    """token=... is a pattern of its own; only values that could be identifiers are marked."""
    rows = [(i, f"see contact=user{i}@host.example.org", "a") for i in range(12)] + [(50, "see contact=QX-99812-77", "a"), (51, "see contact=none", "a")]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert found[50] == "context:12:23" and found[51] == ""


def test_follower_counts(spark, make_docs):
    rows = [(1, "Acc No. 1 acc no. 2 acc", "a"), (2, "no. acc no. k=v K=w k=", "a")]
    patterns = {p: pii._hash(p) for p in ("1 acc", "1 no.", "2 acc no.", "0 k=")}
    wanted = spark.createDataFrame([(h,) for h in patterns.values()], "pattern long")
    got = {r.pattern: r.total for r in pii.followers(make_docs(rows), wanted).collect()}
    assert {p: got.get(h) for p, h in patterns.items()} == {"1 acc": 3, "1 no.": 4, "2 acc no.": 3, "0 k=": 2}


def test_numbers_written_in_groups_and_short_ones(make_docs):
    rows = [(i, f"call the desk at user{i}@host{i}.example.org today", "a") for i in range(40)]
    rows += [(100, "the desk at (555) 123-4567 today", "a"), (101, "the desk at 4111 1111 1111 1112, then", "a"), (102, "the desk at DE89 3704 0044 0532 0130 00", "a"), (103, "the desk at AB12345 now", "a"), (104, "the desk at 12 now", "a")]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert [found[k] for k in range(100, 105)] == ["context:13:26", "context:12:31", "context:12:39", "context:12:19", ""]


def test_access_tokens_are_seeds(make_docs):
    rows = [(i, f'words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" words', "a") for i in range(20)]
    rows += [(50, 'more token = "abc-short-9911" words', "a"), (51, 'a digest ' + hashlib.sha1(b"x").hexdigest() + " of a file", "a"), (52, "the token is none", "a")]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert all(found[i] == "context:15:55" for i in range(20)) and found[50] == "context:14:28" and found[51] == found[52] == ""


def test_rounds_go_on_until_no_pattern_is_added(make_docs):
    """Each marker is learned from instances that the marker before it has made sure."""
    rows = [(i, f"key0 user{i}@host{i}.example.org", "a") for i in range(100)]
    for step in range(6):
        rows += [(1000 + 10 * step + k, f"key{step} ID{step}000{k}777" + f" and key{step + 1} ID{step}000{k}777" * 40, "a") for k in range(4)]
    found = {r.doc_id: r.spans for r in pii.find_private(make_docs(rows)).collect()}
    assert all(found[1000 + 10 * step + k].count("context") == 41 for step in range(6) for k in range(4))
