"""Uploads as a stream into four tables: outcomes, killed and resumed runs, repeated uploads, any split into batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvella.streaming import ingest
from corvella.streaming.ingest import SINKS, UPLOAD

T0 = dt.datetime(2024, 3, 1)


def upload(d, text=None, images=(), kind="pdf", error=None, at=0, pages=None):
    pictures = [(d * 10 + i, 1, i + 1, f"p{i}.png", caption, ocr) for i, (caption, ocr) in enumerate(images)]
    return (d, "kb", "public", f"f{d}.{kind}", kind, pages if pages is not None else [(1, text)] if text is not None else None, pictures, error, T0 + dt.timedelta(seconds=at))


class Landing:
    def __init__(self, spark, path):
        self.spark, self.source, self.root, self.n = spark, str(path / "in"), str(path / "out"), 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), UPLOAD).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, files=1):
        stream = self.spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files).parquet(self.source)
        ingest.run_ingestion(stream, self.root, size=5, overlap=1).awaitTermination()

    def table(self, sink):
        return sorted((repr(r) for r in ingest.current(self.spark, self.root, sink).collect()))

    def tables(self):
        return {sink: self.table(sink) for sink in SINKS}


@pytest.fixture
def landing(spark, tmp_path):
    made = iter("abcd")
    return lambda: Landing(spark, tmp_path / next(made))


ROWS = (
    upload(1, "one two three four five six seven", [("a curve", None)]),
    upload(2, "word", kind="docx", pages=[(1, "up"), (2, "down")]),
    upload(3, "  "),
    upload(4, images=[("scan", "read from it")], kind="png"),
    upload(5, images=[("scan", " ")], kind="png"),
    upload(6, "lost", error="bad zip"),
    upload(7, images=[("only a picture", None)]),
    upload(None, "nobody's"),
)


def test_outcomes(spark, landing):
    one = landing()
    one.put(*ROWS)
    one.run()
    docs = {r.document_id: (r.status, r.error_message, r.page_count, r.chunk_count) for r in ingest.current(spark, one.root, "documents").collect()}
    assert docs == {1: ("ready", None, 1, 3), 2: ("ready", None, 2, 1), 3: ("failed", ingest.NO_TEXT, 1, 0), 4: ("ready", None, 0, 2), 5: ("failed", "OCR produced no text.", 0, 0), 6: ("failed", "bad zip", 1, 0), 7: ("ready", None, 0, 1)}
    chunks = [(r.document_id, r.chunk_index, r.metadata.source_type) for r in ingest.current(spark, one.root, "chunks").orderBy("document_id", "chunk_index").collect()]
    assert chunks == [(1, 0, "pdf_text"), (1, 1, "pdf_text"), (1, 2, "pdf_image"), (2, 0, "docx_text"), (4, 0, "image_ocr"), (4, 1, "pdf_image"), (7, 0, "pdf_image")]
    linked = {r.image_id: r.chunk_id is not None for r in ingest.current(spark, one.root, "images").collect()}
    assert linked == {10: True, 40: True, 70: True}
    events = ingest.current(spark, one.root, "events").groupBy("event_type").count()
    assert {tuple(r) for r in events.collect()} == {("document_uploaded", 7), ("upload_rejected", 1), ("document_ready", 4), ("document_failed", 3)}
    assert {(r.batch, r.sink): r.n_rows for r in ingest.ledger(spark, one.root).collect()} == {(0, "documents"): 7, (0, "chunks"): 7, (0, "images"): 3, (0, "events"): 15}


@pytest.mark.parametrize("sink", ("chunks", "events"))
def test_a_killed_run_resumes_to_the_same_tables(spark, landing, monkeypatch, sink):
    whole, broken = landing(), landing()
    for one in (whole, broken):
        for k in (0, 4):
            one.put(*ROWS[k : k + 4])
    whole.run()
    write, calls = ingest._write_sink, []

    def dies(rows, root, name, number):
        if name == sink and number == 1:
            calls.append(number)
            rows.limit(1).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")  # half a table is there
            raise RuntimeError("killed")
        return write(rows, root, name, number)

    monkeypatch.setattr(ingest, "_write_sink", dies)
    with pytest.raises(Exception, match="killed"):
        broken.run()
    assert calls == [1] and {r.batch for r in ingest.ledger(spark, broken.root).collect()} == {0}
    seen = ingest.committed(spark, broken.root, "documents").select("batch").distinct().collect()
    assert [r.batch for r in seen] == [0]
    monkeypatch.setattr(ingest, "_write_sink", write)
    broken.run()
    assert broken.tables() == whole.tables()
    broken.run()
    assert broken.tables() == whole.tables()


def test_a_batch_in_the_ledger_is_not_done_twice(spark, landing):
    one = landing()
    one.put(*ROWS)
    one.run()
    before = one.tables()
    ingest.ingest_batch(spark.createDataFrame([upload(1, "changed")], UPLOAD), 0, one.root)
    assert one.tables() == before


def test_later_uploads_replace_a_document_whatever_the_split(spark, landing):
    rows = [upload(1, "old words", at=0), upload(1, "a b c d e f g h i j", at=5, images=[("c", "o")]), upload(2, "gone", at=1), upload(2, error="bad zip", at=9), upload(1, "new", at=3), upload(2, "gone", at=1)]
    together, apart, backwards = landing(), landing(), landing()
    together.put(*rows)
    for k in range(0, 6, 2):
        apart.put(*rows[k : k + 2])
    for k in (3, 0):
        backwards.put(*rows[k : k + 3])
    for one in (together, apart, backwards):
        one.run()
    docs = [(r.document_id, r.status, r.chunk_count) for r in ingest.current(spark, apart.root, "documents").orderBy("document_id").collect()]
    assert docs == [(1, "ready", 4), (2, "failed", 0)]
    assert {r.document_id for r in ingest.current(spark, apart.root, "chunks").collect()} == {1}
    for sink in ("documents", "chunks", "images"):
        assert together.table(sink) == apart.table(sink) == backwards.table(sink)
    uploaded = lambda one: ingest.current(spark, one.root, "events").where(F.col("event_type") == "document_uploaded").count()
    assert uploaded(together) == uploaded(apart) == uploaded(backwards) == 6


def test_an_empty_batch(spark, landing):
    one = landing()
    one.put()
    one.put(ROWS[0])
    one.run()
    assert len(one.table("documents")) == 1
