"""Chunking, layout, Office files and ingestion against plain Python statements and inline fixtures."""

import io
import random
import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvella.operators import chunking, ingestion, layout
from corvella.sources import adapters, files, office


def _chunks(words, size, overlap):
    out, stride = [], max(size - overlap, 1)
    start = 0
    while start < len(words):
        out.append(" ".join(words[start : start + size]))
        if start + size >= len(words):
            break
        start += stride
    return out


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (5, 0), (3, 2), (2, 5), (7, 7)])
def test_chunks_of_texts(spark, size, overlap):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = {}
    for r in chunking.chunk_text(df, "d", "t", size, overlap).orderBy("d", "chunk_index").collect():
        got.setdefault(r.d, []).append(r.content)
        assert r.token_count == len(r.content.split()) and r.chunk_index == len(got[r.d]) - 1
    assert got == {i: c for i, t in enumerate(texts) if (c := _chunks(t.split(), size, overlap))}


def _page_chunks(pages, size, overlap):
    """Words flow from page to page through a buffer."""
    buffer, out = [], []
    for number, text in pages:
        for w in (text or "").split():
            buffer.append((w, number))
            if len(buffer) == size:
                out.append(list(buffer))
                buffer = buffer[size - overlap :]
    if buffer:
        out.append(list(buffer))
    return [(" ".join(w for w, _ in c), min(n for _, n in c), max(n for _, n in c)) for c in out]


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (5, 0), (3, 2)])
def test_chunks_of_pages(spark, size, overlap):
    rng = random.Random(size)
    docs = {d: [(p, rng.choice([None, "", " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(9)))])) for p in range(1, rng.randrange(2, 7))] for d in range(40)}
    df = spark.createDataFrame([(d, p, t) for d, x in docs.items() for p, t in x], "d int, page_number int, text string").repartition(5)
    got = {}
    for r in chunking.chunk_pages(df, "d", size, overlap).orderBy("d", "chunk_index").collect():
        got.setdefault(r.d, []).append((r.content, r.page_start, r.page_end))
    assert got == {d: c for d, x in docs.items() if (c := _page_chunks(x, size, overlap))}
    with pytest.raises(ValueError):
        chunking.chunk_pages(df, "d", 3, 3)


def test_chunks_span_every_page_they_have_words_of(spark):
    """Pages without words between, gaps in the numbering, a tail of overlap and one more word."""
    pages = [(9, 2, "kiwi"), (9, 3, " \n"), (9, 4, None), (9, 7, "plum fig pear\tlime"), (9, 12, "date"), (8, 1, ""), (7, 30, "nut")]
    df = spark.createDataFrame(pages, "d int, page_number int, text string")
    rows = chunking.chunk_pages(df, "d", 5, 2).orderBy("d", "chunk_index").collect()
    assert [(r.d, r.content, r.page_start, r.page_end) for r in rows] == [(7, "nut", 30, 30), (9, "kiwi plum fig pear lime", 2, 7), (9, "pear lime date", 7, 12)]


def test_ocr_words(spark):
    """Blocks, paragraphs and lines in order however the words come; what is blank or without confidence counts in no mean."""
    words = [
        (4, "47", "60", "2", "1", "1", "90", 0), (4, "Total", "80", "2", "1", "1", "12", 1), (4, "Receipt", "40", "1", "2", "3", "0", 2), (4, "?", "-1", "2", "2", "1", "3", 3),
        (4, "\t", "99", "1", "2", "3", "7", 4), (4, "No.", "20", "1", "1", "9", "5", 5), (5, "stamp", "n/a", "1", "1", "1", "", 0), (6, " ", "50", "1", "1", "1", "1", 0),
    ]
    df = spark.createDataFrame(words, "d int, text string, conf string, block_num string, par_num string, line_num string, left string, word_no int")
    got = {r.d: (r.text, r.confidence) for r in layout.ocr_text(df, ["d"]).collect()}
    assert got[4][0] == "No.\nReceipt\nTotal 47\n?" and abs(got[4][1] - 0.5) < 1e-9 and got[5] == ("stamp", None)
    assert got.get(6, ("", None)) == ("", None)


def test_positioned_boxes(spark):
    boxes = [(1, 10.0, 50.0, "b", 0), (1, 11.0, 5.0, "a", 1), (1, 40.0, 0.0, "c", 2), (1, 47.0, 9.0, "d", 3), (2, 1.0, 1.0, "only", 0)]
    df = spark.createDataFrame(boxes, "d int, y double, x double, text string, box_no int")
    assert {r.d: r.text for r in layout.positioned_text(df, ["d"]).collect()} == {1: "a b\nc d", 2: "only"}
    assert layout.line_height([1.0]) == 12.0 and layout.line_height([0.0, 1.0]) == 8.0 and layout.line_height([0.0, 50.0, 100.0]) == 30.0
    centers = spark.createDataFrame([([[0.0, 0.0], [4.0, 2.0]],), ([[1.0]],), ([],), (None,)], "b array<array<double>>").select(layout.box_center(F.col("b")).alias("c")).collect()
    assert [tuple(r.c) for r in centers] == [(1.0, 2.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_positioned_boxes_page_by_page():
    """A batch of many pages never becomes Python objects as a whole, and lines are those of a plain loop."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 2_000, 200)
    total = int(sizes.sum())
    y, x = rng.integers(0, 900, total) * 1.5, rng.integers(0, 40, total) * 5.0
    items = pa.StructArray.from_arrays([pa.array(y), pa.array(x), pa.array(rng.integers(0, 9, total)), pa.array([f"w{k}" for k in range(total)])], ["y", "x", "n", "text"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items)], ["key", "items"])
    tracemalloc.start()
    got = [r["text"] for b in layout._joined(iter([batch])) for r in b.to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 60 * total  # some 300 bytes a box as a list of dicts
    tracemalloc.stop()
    for k, boxes in enumerate(batch.column("items").to_pylist()):
        height, lines, top = layout.line_height([b["y"] for b in boxes]) if boxes else 0, [], float("nan")
        for b in sorted(boxes, key=lambda b: (b["y"], b["x"], b["n"])):
            if not abs(b["y"] - top) <= height:
                lines.append([])
                top = b["y"]
            lines[-1].append(b)
        assert got[k] == "\n".join(" ".join(b["text"] for b in sorted(line, key=lambda b: b["x"])) for line in lines)


def _zip(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(data.getvalue())


W, S, A = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
WORD = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First </w:t><w:t>part</w:t></w:r></w:p><w:p/><w:p><w:r><w:t> Second </w:t></w:r></w:p></w:body></w:document>"})
SHEET = _zip({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Stock 2" r:id="rId1"/><sheet name="" r:id="rId2"/><sheet name="Lost" r:id="rId9"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/none.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Bin</t></si><si><r><t>Cou</t></r><r><t>nt</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>A-7</t></is></c><c><v>3</v></c><c t="s"><v>99</v></c></row><row><c><v></v></c></row></sheetData></worksheet>',
})
SLIDES = _zip({f"ppt/slides/slide{n}.xml": f"<p {A}><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p/></p>" for n, t in ((10, "ten"), (2, "two"), (3, ""))})


def test_office_files(spark):
    rows = [("w", "docx", WORD), ("s", "xlsx", SHEET), ("p", "pptx", SLIDES), ("bad", "docx", bytearray(b"no zip")), ("part", "docx", SHEET), ("xml", "docx", _zip({"word/document.xml": "<w"})), ("none", "pptx", _zip({"x": "y"})), ("pdf", "pdf", bytearray(b"x"))]
    got = {r.path: r for r in office.parse_office(spark.createDataFrame(rows, "path string, file_type string, content binary")).collect()}
    pages = {k: [tuple(p) for p in r.pages] for k, r in got.items()}
    assert pages["w"] == [(1, "First part\nSecond")] and got["w"].error is None and got["w"].page_count == 1
    assert pages["s"] == [(1, "[Sheet: Stock 2]\nBin\tCount\nA-7\t3"), (2, "[Sheet: Sheet 2]")]
    assert pages["p"] == [(1, "two"), (2, "ten")]
    assert got["bad"].error == "Office document is not a valid OpenXML file." and got["part"].error == "Office document is missing word/document.xml."
    assert got["xml"].error == "Office document contains invalid XML." and got["none"].error == "Office document did not contain extractable text."
    assert "pdf" not in got


def test_folder_scan(spark, tmp_path):
    for name in ("a.PDF", "b.docx", "c.tif", "d.txt", ".pdf", "noext", "e.tar.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.pdf").write_bytes(b"x")
    rows = files.scan_folder(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["name"], r.file_type) for r in rows] == [("a.PDF", "pdf"), ("b.docx", "docx"), ("e.tar.png", "png")]
    assert all(r.content == b"x" and r.error is None for r in rows)


def test_tables_are_created_read_and_appended(spark, tmp_path):
    docs = spark.createDataFrame([(1, "kb"), (2, "kb2")], "document_id long, knowledge_base_id string")
    files.append_table(docs, str(tmp_path), "docs", ("knowledge_base_id",))
    files.append_table(docs.where("document_id = 2"), str(tmp_path), "docs", ("knowledge_base_id",))
    stored = files.read_table(spark, str(tmp_path), "docs")
    assert stored.count() == 3 and files.point_get(stored, "document_id", 1).count() == 1
    assert files.missing_tables(spark, ("no_such_table",)) == ["no_such_table"]
    assert len(files.TABLES) == 18 and all(spark.createDataFrame([], t).columns for t in files.TABLES.values())
    assert files.replace_snapshot(docs, str(tmp_path), "snap", 2).endswith("version=2")


def _documents(spark, ids=(1, 2, 3)):
    rows = [(i, "kb", f"f{i}", "internal", "parsing", None, 0, 0) for i in ids]
    return spark.createDataFrame(rows, "document_id long, knowledge_base_id string, original_filename string, confidential_level string, status string, error_message string, page_count int, chunk_count int")


def test_page_ingestion(spark):
    pages = spark.createDataFrame([(1, 1, "one\x00 two three"), (1, 2, "四"), (2, 1, " ")], "document_id long, page_number int, text string")
    images = spark.createDataFrame([(7, 1, 2, 1, "p.png", "Figure 1", None)], "image_id long, document_id long, page_number int, image_index int, image_path string, caption string, ocr_text string").withColumn("chunk_id", F.lit(None).cast("long"))
    text = {r.document_id: (r.text, r.ocr_required) for r in ingestion.document_text(pages).collect()}
    assert text == {1: ("one\x00 two three\n\n四", False), 2: ("", True)}
    stored, linked = ingestion.ingest_pages(_documents(spark), pages, images, size=3, overlap=1)
    rows = stored.orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content, r.language, r.metadata.source_type) for r in rows] == [(0, "one two three", "zh", "pdf_text"), (1, "three 四", "zh", "pdf_text"), (2, "Image on page 2.\nImage path: p.png\nCaption: Figure 1", "zh", "pdf_image")]
    assert [r.chunk_id for r in linked.collect()] == [rows[2].chunk_id]
    errors = spark.createDataFrame([(2, "no text")], "document_id long, error_message string")
    done = {r.document_id: (r.status, r.error_message, r.chunk_count) for r in ingestion.finish_documents(_documents(spark), stored, errors).collect()}
    assert done == {1: ("ready", None, 3), 2: ("failed", "no text", 0), 3: ("parsing", None, 0)}
    docs, left, pictures = ingestion.reset(_documents(spark), stored, linked, _documents(spark, (1,)))
    assert docs.count() == 3 and left.count() == 0 and pictures.count() == 0


def test_image_ingestion(spark):
    images = spark.createDataFrame([(7, 1, 1, 1, "p.png", None, "seen words here"), (8, 2, 1, 1, "q.png", None, " ")], "image_id long, document_id long, page_number int, image_index int, image_path string, caption string, ocr_text string").withColumn("chunk_id", F.lit(None).cast("long"))
    stored, linked, failed = ingestion.ingest_images(_documents(spark, (1, 2)), images)
    assert [(r.chunk_index, r.metadata.source_type) for r in stored.orderBy("chunk_index").collect()] == [(0, "image_ocr"), (1, "pdf_image")]
    assert [r.document_id for r in failed.collect()] == [2] and linked.count() == 1
    reasons = spark.createDataFrame([("archived", True), ("ready", None), ("ready", True)], "s string, f boolean").select(ingestion.reindex_error(F.col("s"), F.col("f"))).collect()
    assert [r[0] for r in reasons] == ["Archived documents cannot be reindexed.", "Document file is missing.", None]


def test_adapters(spark):
    class Reader:
        def read(self, content, file_type):
            if content == b"bad":
                raise OSError("broken")
            return [{"page_number": 1, "text": content.decode()}, {"page_number": 2, "text": file_type}]

    class Model:
        def complete(self, system, prompt):
            if "fail" in prompt:
                raise TimeoutError("late")
            return {"answer": prompt.upper(), "prompt_tokens": 3, "completion_tokens": 1}

    found = spark.createDataFrame([("a", "pdf", bytearray(b"hi")), ("b", "pdf", bytearray(b"bad"))], "path string, file_type string, content binary")
    rows = adapters.read_pages(found, Reader(), "page_number int, text string").orderBy("path", "page_number").collect()
    assert [(r.path, r.page_number, r.text, r.error) for r in rows] == [("a", 1, "hi", None), ("a", 2, "pdf", None), ("b", None, None, "OSError: broken")]
    texts = spark.createDataFrame([(1, "ok"), (2, "fail"), (3, None)], "i int, t string")
    said = {r.i: r for r in adapters.complete_column(texts.where("t is not null"), "s", "t", Model()).collect()}
    assert (said[1].answer, said[1].status) == ("OK", "success") and (said[2].status, said[2].error_message) == ("failed", "late")
    vectors = {r.i: r.embedding for r in adapters.embed_column(texts, "t", adapters.HashEmbedder(16)).collect()}
    assert len(vectors[1]) == 16 and abs(sum(x * x for x in vectors[1]) - 1) < 1e-6 and sum(vectors[3]) == 0


def test_embedding_answers_are_ordered_and_complete():
    reply = {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}
    client = adapters.HttpEmbedder("http://x", "m", 1, post=lambda *_: reply)
    assert client.embed(["a", "b"]) == [[1.0], [2.0]] and client.embed([]) == []
    with pytest.raises(ValueError):
        client.embed(["a"])


def test_stream_lines():
    lines = ['data: {"choices":[{"delta":{"content":"hello"}}]}', ": ping", "data: {bad", 'data: {"choices":[{"message":{"content":" world"}}]}', 'data: {"choices":[{"delta":{}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    assert adapters.stream_deltas(lines) == ["hello", " world"]
    assert adapters.data_url("image/png", b"x") == "data:image/png;base64,eA==" and adapters.runtime_available("json", "no_such") == {"json": True, "no_such": False}


def test_long_texts_are_split_once(spark):
    """A text of 320,000 words is cut in about the time that splitting it takes."""
    import time

    from corvella.operators import chunking

    docs = spark.createDataFrame([(1, "word " * 320_000)], "document_id long, text string")
    chunking.chunk_text(docs.limit(0), "document_id", "text").collect()
    began = time.monotonic()
    rows = chunking.chunk_text(docs, "document_id", "text").agg({"token_count": "sum", "chunk_index": "max"}).collect()
    assert time.monotonic() - began < 8
    assert rows[0]["max(chunk_index)"] == -(-(320_000 - 700) // 580)


def test_words_of_scans_are_trimmed_and_sorted_without_patterns_or_lambdas(spark):
    """Every character at both ends as the pattern of white space takes it; numbers with white space; no regex or lambda a word."""
    from corvella.functions import text

    df = spark.createDataFrame([(i, f"{chr(i)}{chr(i)}7{chr(i)}") for i in range(0x3100)], "c int, s string")
    old = F.regexp_replace("s", "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    number = F.coalesce(old.try_cast("int"), F.lit(0))
    assert df.where(~text.strip(F.col("s")).eqNullSafe(old) | (text.safe_int(F.col("s")) != number)).count() == 0
    words = spark.createDataFrame([(1, "a", "1", "1", "1", "1", "1", 0)], "d int, text string, conf string, block_num string, par_num string, line_num string, left string, word_no int")
    plan = layout.ocr_text(words, ["d"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_replace") <= 1  # the control characters of whole texts
