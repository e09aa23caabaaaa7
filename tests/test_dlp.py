"""Masking against a plain Python model of the rules."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.functions import dlp
from corvella.functions.dlp import Rule
from corvella.operators import dlp as masking

RULES = [Rule("formula", "RESTRICTED_FORMULA", "[BLOCK]", "high"), Rule("person", "a.b(c)", None, "medium"), Rule("odd", "x\\Ey", "[ODD]", "low"), Rule("off", "token", "[OFF]", "low", is_active=False)]


def _model(text, rules=RULES):
    found = []
    for place, d in enumerate(dlp.detectors(rules)):
        rule = next((r for r in rules if r.is_active and r.detector() == d), None)
        pattern = re.compile(re.escape(rule.value), re.I) if rule else dlp.python_pattern(d)
        found += [(m.start(), -len(m[0]), place, m.end(), d) for m in pattern.finditer(text)]
    kept, reach = [], 0
    for f in sorted(found, key=lambda f: f[:3]):
        if f[0] >= reach:
            kept.append(f)
            reach = f[3]
    out, at, names = [], 0, []
    for start, _, _, end, d in kept:
        put = d.replacement or {"redact": "[REDACTED]", "block": "[BLOCKED]"}.get(d.action, f"[{d.entity_type.upper()}]")
        out += [text[at:start], put]
        names.append((d.entity_type, put))
        at = end
    risk = max((f[4].risk_level for f in kept), key=dlp.RISKS.index, default="low")
    return "".join(out) + text[at:], names, risk, any(f[4].action == "block" for f in kept)


def _check(spark, texts, rules=RULES):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = masking.scan_and_mask(df, "t", "query", rules).orderBy("i").collect()
    got = [(r.masked_text, [(e.entity_type, e.masked_value) for e in r.masked_entities], r.risk_level, r.blocked) for r in rows]
    assert got == [_model(t, rules) for t in texts]


TEXTS = [
    "token=secret-value and user@example.com", "", "nothing here", "call +1 (323) 555-9830 or 5559830, 10.0.0.1 and 999.1.1.1", "sk-abcdefghijklmnop123 pk-short",
    "see https://x.example/a?b=c and C:\\temp\\f.txt or /usr/bin", "lot: ABCD-12 batch_9999 machine A12 tool-xyz model which", "temperature: -3.5 C rpm=900", "customer acme1 product P-77",
    "name: Ann Lee Smith owner=Bob Ray", "Acme Widgets Inc and Foo Bar Baz Qux Ltd", "restricted_formula A.B(C) x\\Ey", "password: x token:y secret = z", "\U0001f600 user@example.com \U0001f600 10.0.0.1", "é@b.co Ünal@firma.de",
]


def test_fixed_texts(spark):
    _check(spark, TEXTS)
    _check(spark, TEXTS, [])


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    _check(spark, texts)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "@", ".", "co", "1", "23", "4567", "-", "/", "lot", "token", "=", ":", " ", "é", "\U0001f600", "Inc", "Ab", "RESTRICTED_FORMULA", "\n"]), max_size=14).map("".join), min_size=40, max_size=80))
def test_random_texts(spark, texts):
    _check(spark, texts)


def test_null_text(spark):
    row = masking.scan_and_mask(spark.createDataFrame([(None,)], "t string"), "t", "query", []).first()
    assert row.masked_text is None and row.findings == [] and row.risk_level == "low" and not row.blocked


def test_offsets_count_code_points(spark):
    row = masking.scan_and_mask(spark.createDataFrame([("\U0001f600 10.0.0.1",)], "t string"), "t", "query", []).first()
    assert [(f.start, f.end, f.value) for f in row.findings] == [(2, 10, "10.0.0.1")]


def test_events_hide_values(spark):
    scanned = masking.scan_and_mask(spark.createDataFrame([(7, TEXTS[0])], "m long, t string"), "t", "query")
    rows = masking.masking_events(scanned, "m").orderBy("nth").collect()
    assert [(r.message_id, r.entity_type, r.original_value, r.masked_value, r.masking_method, r.location) for r in rows] == [(7, "secret", None, "[REDACTED]", "redact", "query"), (7, "email", None, "[EMAIL]", "mask", "query")]


def _dictionary(spark):
    rows = [("a", "v", "[V]", "low", True, dt.datetime(2024, 1, 1)), ("a", "w", None, "high", True, dt.datetime(2024, 1, 2)), ("b", "off", None, "low", False, dt.datetime(2024, 1, 3))]
    return spark.createDataFrame(rows, "entity_type string, value string, replacement string, risk_level string, is_active boolean, created_at timestamp_ntz")


def test_rules_are_active_newest_first(spark):
    assert [r.value for r in masking.active_rules(_dictionary(spark))] == ["w", "v"]


def test_rule_upserts_are_keyed_by_type_and_value(spark):
    changes = spark.createDataFrame([("a", "v", "[NEW]", "high", False), ("a", "V", None, "low", True)], "entity_type string, value string, replacement string, risk_level string, is_active boolean").withColumn("created_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    rows = {(r.entity_type, r.value): (r.replacement, r.is_active, r.created_at.year) for r in masking.upsert_rules(_dictionary(spark), changes).collect()}
    assert len(rows) == 4 and rows["a", "v"] == ("[NEW]", False, 2024) and rows["a", "V"] == (None, True, 2025)


def test_templates_come_back_inactive(spark):
    once = masking.install_templates(_dictionary(spark), dt.datetime(2024, 5, 1))
    on = masking.toggle_rule(once, "machine_name", "Machine-A12", True)
    again = masking.install_templates(on, dt.datetime(2024, 6, 1)).where("value = 'Machine-A12'").collect()
    assert [r.is_active for r in again] == [False] and on.where("is_active and value = 'Machine-A12'").count() == 1


def _table(spark, rules):
    """Rules as a dictionary table, the first the newest."""
    rows = [(r.entity_type, r.value, r.replacement, r.risk_level, r.is_active, dt.datetime(2024, 1, 1) - dt.timedelta(hours=i)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "entity_type string, value string, replacement string, risk_level string, is_active boolean, created_at timestamp_ntz")


def _by_table(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    rows = masking.scan_with_dictionary(df, "t", "query", _table(spark, rules)).orderBy("i").collect()
    assert len(rows) == len(texts)
    return [(r.masked_text, [(e.entity_type, e.masked_value) for e in r.masked_entities], r.risk_level, r.blocked) for r in rows]


def test_dictionary_table_equals_rules(spark):
    texts = TEXTS + ["a.b(c) restricted_formula", "a.b(c)", "x" * 126 + "A.B(C)" + "y" * 300 + "Restricted_Formula", "a.b(c)", "x\\ey\nX\\EY"]
    assert _by_table(spark, texts, RULES) == [_model(t, RULES) for t in texts]
    assert _by_table(spark, texts, []) == [_model(t, []) for t in texts]
    (null,) = masking.scan_with_dictionary(spark.createDataFrame([(None,)], "t string"), "t", "query", _table(spark, RULES)).collect()
    assert null.masked_text is None and null.findings == []


def test_dictionary_beyond_the_list(spark, monkeypatch):
    """More rules than a list may hold: shared beginnings, terms in terms, ties by age, one longer than a piece."""
    rules = [Rule("code", f"Unit-{i}", f"[U{i}]", "low") for i in range(700)] + [Rule("long", "lang" * 60, "[LONG]", "high"), Rule("short", "q", None, "low"), Rule("twice", "unit-7", "[LATER]", "high")]
    texts = ["unit-7 and UNIT-77, unit-699unit-700", "a" * 100 + "LANG" * 60 + "lang", "Q unit- 1", "none", ""]
    got = _by_table(spark, texts, rules)
    monkeypatch.setattr(dlp, "MAX_RULES", 10_000)
    assert got == [_model(t, rules) for t in texts]


def test_case_folding_misses_no_rule(spark):
    """What the rules' patterns match in another case is found by the table as well."""
    pairs = [("straße", "STRA\u1e9eE"), ("kelvin", "\u212aELVIN"), ("ilk", "İLK"), ("ılk", "ILK"), ("σας", "ΣΑΣ"), ("miſt", "MIST"), ("\u00b5m", "\u03bcM"), ("é", "É")]
    rules = [Rule("r", a, None, "low") for a, _ in pairs]
    texts = [f"<{b}> {a}" for a, b in pairs]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    listed = masking.scan_and_mask(df, "t", "query", rules).orderBy("i").collect()
    assert _by_table(spark, texts, rules) == [(r.masked_text, [(e.entity_type, e.masked_value) for e in r.masked_entities], r.risk_level, r.blocked) for r in listed]


def test_dictionary_in_many_parts(spark, monkeypatch):
    """Terms dealt by first characters, a crowded first character by hash; the longest has 3,000 characters."""
    monkeypatch.setattr(masking, "PART_CHARS", 60)
    rules = [Rule("code", f"Unit-{i}", None, "low") for i in range(40)] + [Rule("long", "lang" * 750, None, "high"), Rule("z", "zeta", None, "low"), Rule("e", "eta", "[ETA]", "low"), Rule("off", "off", None, "low", is_active=False)]
    assert len(masking._parts(_table(spark, rules).withColumn("term", dlp.folded(F.col("value"))))) > 8
    texts = ["unit-7 UNIT-39", "x" * 50 + "LANG" * 750, "Zeta off", "none", ""]
    assert _by_table(spark, texts, rules) == [_model(t, rules) for t in texts]


def test_values_of_a_dictionary_in_each_text(spark, monkeypatch):
    """Values by row, in order and once each, in any case; ß is not ss; short ones few and many; one part and several alike."""
    values = ["e", "st", "ss", "esst", "Esst", "a b", "lang" * 30, "zeta", "eta", "straße", "é"]
    rules = [Rule(kind, v, None, "low") for v in values for kind in ("x", "y")] + [Rule("x", "off", None, "low", is_active=False)]
    texts = ["Zeta A B", "eßt STRAẞE", "ESST", "a  b off", "LANG" * 30, "É", "", None, "ZETA a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    want = {i: sorted(v for v in values if v.lower() in t.lower()) for i, t in enumerate(texts) if t}
    for part, short in ((1 << 21, 128), (1 << 21, 1), (60, 128)):
        monkeypatch.setattr(masking, "PART_CHARS", part)
        monkeypatch.setattr(masking, "_SHORT_TERMS", short)
        found = masking.dictionary_values(df, "i", "t", _table(spark, rules))
        assert {r.i: r.found for r in found.collect()} == {i: v for i, v in want.items() if v}
        if part > 60:  # what a dictionary of one part finds is neither grouped nor joined
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Aggregate" not in plan and "Join" not in plan


def test_scanner_reads_patterns_of_rules_literally():
    rule = Rule("odd", "a.b\\Ec", None, "low").detector()
    assert [m[0] for m in dlp.python_pattern(rule).finditer("A.B\\EC axb\\Ec")] == ["A.B\\EC"]
    scanner = dlp.Scanner([*dlp.BUILT_IN, rule])
    assert [(a, z, d.entity_type) for a, z, d, _ in scanner.spans("token=a.b\\Ec a.b\\Ec")] == [(0, 12, "secret"), (13, 19, "odd")]
