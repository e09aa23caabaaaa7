import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import quality

from .conftest import SF, odd_rows


def _measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 800 else _marked(windows)
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(marked), failed


def _marked(windows):
    from collections import Counter

    n = Counter(windows)
    return {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}


@pytest.fixture(scope="module")
def model(spark, sf_docs):
    return quality.train(sf_docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_measures_on_the_whole_table(spark, sf_docs):
    want = {r.doc_id: _measures(r.text) for r in sf_docs.collect()}
    rows = quality.op6_quality_rules(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
    assert not any(r.kept and r.base_failed for r in rows)


def test_odd_rows(model, odd_docs, no_docs):
    rows = quality.judge(odd_docs, model).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((repr(i), *_measures(t)) for i, t, _ in odd_rows())
    assert quality.judge(no_docs, model).count() == 0
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in rows if r.kept)
    assert quality.keep_good(no_docs, model).count() == 0


def test_verdicts_do_not_depend_on_batches(model, sf_docs):
    one = {r.doc_id: (r.kept, round(r.probability, 9)) for r in quality.judge(sf_docs.coalesce(1), model).collect()}
    many = {r.doc_id: (r.kept, round(r.probability, 9)) for r in quality.judge(sf_docs.repartition(7), model).collect()}
    assert one == many


def test_labels_with_nulls_repeats_and_none(spark, sf_docs, odd_docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(odd_docs, labels).weights is None  # one class only
    none = quality.train(odd_docs, labels.where(F.lit(False)))
    assert none.weights is None and all(r.probability == 1.0 for r in quality.judge(odd_docs, none).collect())


def test_calibration_follows_the_share_of_good_rows():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * logits - 1)))).astype(float)
    slope, shift = quality.calibrate(logits, y)
    assert abs(slope - 0.5) < 0.08 and abs(shift + 1) < 0.15
    assert quality.calibrate(logits, np.ones(4000)) == (1.0, 0.0)


def test_held_out_accuracy(spark):
    """Documents whose labels the model never saw."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    judged = quality.judge(docs.join(labels.where(held), "doc_id").select(docs["*"]), model).where("not base_failed").join(labels, "doc_id").select("quality", "kept", "probability").collect()
    good = [r for r in judged if r.quality == 1]
    bad = [r for r in judged if r.quality == 0]
    assert len(good) > 100 and len(bad) > 20
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_long_texts_go_in_pieces(model, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "é", "文字文", "a\n", "#x", " ", "word", "\U0001f600", "same same same same"]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 4000)) + " ab"
    whole = model.measure([text])
    features = quality._features(_batch(text))
    monkeypatch.setattr(quality, "_CHUNK", 50)
    assert len(list(quality._pieces(text.encode()))) > 100
    pieces = model.measure([text])
    assert {k: v.tolist() for k, v in whole.items()} == {k: v.tolist() for k, v in pieces.items()}
    assert quality._features(_batch(text)).equals(features)


def _batch(text):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": [1], "label": [1], "text": [text]})


def test_rows_with_one_id_and_features_are_bounded(spark, monkeypatch):
    rows = [(1, "good words " * 30 + str(k % 3)) for k in range(300)] + [(k, f"bad {k} text " * 40) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    once = docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    a, b = quality.train(docs, labels), quality.train(once, labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    monkeypatch.setattr(quality, "MAX_FEATURES", 7)
    assert len(quality._features(_batch("many different words stand in this text")).column("idx")[0]) == 7
