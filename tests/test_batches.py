"""Batches of bounded size: what Python holds follows from bytes, not from rows."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from corvella.functions import batches, dlp
from corvella.operators import dlp as masking
from corvella.sources import office


def test_slices_cover_all_values_and_keep_large_ones_whole():
    values = pa.array(["a" * n for n in (3, 0, 9, 30, 1)] + [None, "b" * 10, "c"])
    assert list(batches.slices(values, 10)) == [(0, 2), (2, 1), (3, 1), (4, 2), (6, 1), (7, 1)]
    assert list(batches.slices(values.slice(8), 10)) == []
    whole = pa.RecordBatch.from_arrays([values], ["t"])
    assert [t for b in batches.bounded(iter([whole]), "t", 10) for t in b.column("t").to_pylist()] == values.to_pylist()


def test_masking_scans_a_few_texts_at_a_time(spark, monkeypatch):
    """A batch of many texts is scanned in parts of bounded bytes, with the same findings in the same order."""
    scanned, scan, chosen = [], dlp.scan_texts, {}
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: chosen.setdefault("scan", f) and (lambda c: F.lit(None).cast(kind)))
    masking.scan_and_mask(spark.createDataFrame([("x",)], "t string"), "t", "query")
    monkeypatch.setattr(dlp, "scan_texts", lambda s, texts, *a: scanned.append(sum(len(t or "") for t in texts)) or scan(s, texts, *a))
    texts = [None if k % 50 == 9 else f"mail a{k}@b.example " + "word " * 10_000 for k in range(100)]
    out = chosen["scan"](pa.array(texts))
    assert len(out) == 100 and [r["masked_text"] and r["masked_text"][:12] for r in out.to_pylist()] == [t and "mail [EMAIL]" for t in texts]
    assert max(scanned) <= batches.BATCH_BYTES < sum(scanned)
    assert len(chosen["scan"](pa.array([], pa.string()))) == 0


class _Held:
    """Stands for a table: keeps the function that goes through its batches."""

    def where(self, *_):
        return self

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        raise StopIteration


def test_files_are_opened_a_few_at_a_time(spark):
    """A batch of many files doesn't become Python objects as a whole."""
    held = _Held()
    try:
        office.parse_office(held)
    except StopIteration:
        pass
    n = 64
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(n))), pa.array(["docx"] * n), pa.array([b"x" * (1 << 20)] * n)], ["path", "file_type", "content"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in held.run(iter([batch]))) == n
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
