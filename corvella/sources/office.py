"""Word, Excel and PowerPoint files to pages. Spark lists and distributes the files; a task opens one at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.text import clean_db_text, strip
from .files import OFFICE_TYPES

# XML namespaces of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _said(element: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter(tag)).strip()


def _paragraphs(root: ElementTree.Element, space: str) -> str:
    return "\n".join(filter(None, (_said(p, space + "t") for p in root.iter(space + "p"))))


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _word(archive: zipfile.ZipFile) -> Iterator[str]:
    yield _paragraphs(_part(archive, "word/document.xml"), _W)


def _slides(archive: zipfile.ZipFile) -> Iterator[str]:
    numbered = {int(m[1]): n for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
    for k in sorted(numbered):
        yield _paragraphs(_part(archive, numbered[k]), _A)


def _sheets(archive: zipfile.ZipFile) -> Iterator[str]:
    there = set(archive.namelist())
    shared = [_said(si, _S + "t") for si in _part(archive, "xl/sharedStrings.xml").iter(_S + "si")] if "xl/sharedStrings.xml" in there else []
    rels = _part(archive, "xl/_rels/workbook.xml.rels").iter(_REL + "Relationship") if "xl/_rels/workbook.xml.rels" in there else ()
    targets = {r.get("Id"): "xl/" + r.get("Target", "").lstrip("/").removeprefix("xl/") for r in rels if r.get("Id") and r.get("Target")}

    def shown(cell: ElementTree.Element) -> str:
        if cell.get("t") == "inlineStr":
            return _said(cell, _S + "t")
        raw = cell.findtext(_S + "v") or ""
        if cell.get("t") != "s":
            return raw
        try:
            return shared[int(raw)]
        except (ValueError, IndexError):
            return ""

    for nth, sheet in enumerate(_part(archive, "xl/workbook.xml").iter(_S + "sheet"), 1):
        if (path := targets.get(sheet.get(_R + "id"))) is None:
            continue
        rows = _part(archive, path).iter(_S + "row") if path in there else ()
        lines = ["\t".join(filter(None, map(shown, row.findall(_S + "c")))) for row in rows]
        yield "\n".join([f"[Sheet: {sheet.get('name') or f'Sheet {nth}'}]", *filter(None, lines)])


_READERS = {"docx": _word, "xlsx": _sheets, "pptx": _slides}


def _open(content: bytes | None, kind: str) -> tuple[list[str], str | None]:
    """(pages, error) of one file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            return list(_READERS[kind](archive)), None
    except zipfile.BadZipFile:
        return [], "Office document is not a valid OpenXML file."
    except KeyError as e:
        return [], f"Office document is missing {re.search(r"'([^']+)'", str(e))[1] if "'" in str(e) else e}."
    except ElementTree.ParseError:
        return [], "Office document contains invalid XML."


def parse_office(files: DataFrame) -> DataFrame:
    """(path, file_type, pages, page_count, error) of files (path, file_type, content).

    pages: array of (page_number, text). Blank pages go and the rest is numbered anew; a Word file is one page. A file
    that can't be read, or has no text, has an error and no pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "content"):
            for path, kind, content in zip(*(b.column(c).to_pylist() for c in ("path", "file_type", "content")), strict=True):
                texts, error = _open(content, kind)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([texts], pa.list_(pa.string())), pa.array([error], pa.string())], ["path", "file_type", "texts", "error"])

    wanted = files.where(F.col("file_type").isin(*OFFICE_TYPES)).select("path", "file_type", "content")
    raw = wanted.mapInArrow(run, "path string, file_type string, texts array<string>, error string")
    cleaned = F.filter(F.transform("texts", clean_db_text), lambda t: strip(t) != "")
    pages = F.transform(cleaned, lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")))
    empty = F.when(F.size("pages") == 0, "Office document did not contain extractable text.")
    return raw.withColumn("pages", pages).select("path", "file_type", "pages", F.size("pages").alias("page_count"), F.coalesce("error", empty).alias("error"))
