"""Workbooks and slides as relations: parts of files are shredded to rows, and what refers to what is resolved by joins.

``office.parse_office`` reads a file in one call. Here a task shreds the XML of its files into rows in bounded batches, a
line of cells or a run of shared strings each; shared strings and sheet targets are joined, and a sheet comes together again
once, beside its workbook's strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.text import clean_db_text, strip

# XML namespaces of the formats, and the names of their parts.
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
WORKBOOK, RELATIONS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"

#: A row of a part. ``nth`` and ``sub`` say where it stands, ``name`` and ``value`` what it says. Of a line of cells ``said`` has
#: the values, ``refs`` the numbers of those that are shared strings, else null; of a run of shared strings ``said`` has these.
ROWS = "path string, part string, kind string, nth long, sub long, name string, value string, said array<string>, refs array<long>"
_BATCH_ROWS, _BATCH_VALUES, _RUN = 8192, 1 << 16, 1024
#: A number that no shared string has.
_NOWHERE = -(1 << 62)
#: Parts of so many bytes at most are parsed in one call.
_SMALL = 4 << 20


def _elements(archive: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a part with a tag; of a large part as they end, and then cleared, so that it is never whole in memory."""
    if archive.getinfo(part).file_size <= _SMALL:
        yield from ElementTree.fromstring(archive.read(part)).iter(tag)
        return
    with archive.open(part) as stream:
        held: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                held.append(element)
                continue
            held.pop()
            if element.tag == tag:
                yield element
                element.clear()
                if held:
                    held[-1].remove(element)


def _said(element: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter(tag)).strip()


def _number(raw: str) -> int:
    """The number a cell gives for a shared string; _NOWHERE if it is no 64-bit integer."""
    try:
        n = int(raw)
    except ValueError:
        return _NOWHERE
    return n if abs(n) < 1 << 62 else _NOWHERE


def _line(row: ElementTree.Element) -> tuple[list[str], list[int | None]]:
    said, refs = [], []
    for cell in row.findall(_S + "c"):
        kind, ref = cell.get("t"), None
        if kind == "inlineStr":
            value = _said(cell, _S + "t")
        else:
            value = cell.findtext(_S + "v") or ""
            if kind == "s":
                value, ref = "", _number(value)
        said.append(value)
        refs.append(ref)
    return said, refs


def _workbook_rows(archive: zipfile.ZipFile) -> Iterator[tuple]:
    there = set(archive.namelist())
    if STRINGS in there:
        strings = (_said(si, _S + "t") for si in _elements(archive, STRINGS, _S + "si"))
        for nth, run in enumerate(iter(lambda: list(islice(strings, _RUN)), [])):
            yield STRINGS, "strings", nth, 0, None, None, run, None
    ids = set()
    for i, sheet in enumerate(_elements(archive, WORKBOOK, _S + "sheet"), 1):
        ids.add(sheet.get(_R + "id"))
        yield WORKBOOK, "sheet", i, 0, sheet.get(_R + "id"), sheet.get("name") or f"Sheet {i}", None, None
    named = set()
    for i, r in enumerate(_elements(archive, RELATIONS, _REL + "Relationship") if RELATIONS in there else ()):
        if r.get("Id") in ids and r.get("Target"):
            named.add(target_of(r.get("Target")))
            yield RELATIONS, "target", i, 0, r.get("Id"), r.get("Target"), None, None
    for part in sorted(named & there):
        for i, row in enumerate(_elements(archive, part, _S + "row")):
            yield part, "line", i, 0, None, None, *_line(row)


def _slide_rows(archive: zipfile.ZipFile) -> Iterator[tuple]:
    numbered = {int(m[1]): part for part in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", part))}
    for nth, part in numbered.items():
        for j, p in enumerate(_elements(archive, part, _A + "p")):
            yield part, "paragraph", nth, j, None, _said(p, _A + "t"), None, None


def target_of(target: str) -> str:
    """Where a relation's target lies in the archive."""
    return "xl/" + target.lstrip("/").removeprefix("xl/")


_SHREDDERS = {"xlsx": _workbook_rows, "pptx": _slide_rows}


def _safe_rows(content: bytes | None, kind: str) -> Iterator[tuple]:
    """The rows of a file, then one of kind ``error`` if it can't be read to the end."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            yield from _SHREDDERS[kind](archive)
    except zipfile.BadZipFile:
        yield "", "error", 0, 0, None, "Office document is not a valid OpenXML file.", None, None
    except KeyError as e:
        yield "", "error", 0, 0, None, f"Office document is missing {re.search(r"'([^']+)'", str(e))[1] if "'" in str(e) else e}.", None, None
    except ElementTree.ParseError:
        yield "", "error", 0, 0, None, "Office document contains invalid XML.", None, None


def part_rows(files: DataFrame) -> DataFrame:
    """ROWS of the workbooks and slides among files (path, file_type, content), in batches of bounded size.

    Paths must be unique. Null content is a file that can't be read. What several steps read should be written first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        names = [c.split()[0] for c in ROWS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows: list[tuple] = []
        values = 0
        for b in bounded(batches, "content"):
            for path, kind, content in zip(*(b.column(c).to_pylist() for c in ("path", "file_type", "content")), strict=True):
                for row in _safe_rows(content, kind):
                    rows.append((path, *row))
                    values += len(row[-2] or ())
                    if len(rows) == _BATCH_ROWS or values >= _BATCH_VALUES:
                        yield batch(rows)
                        rows, values = [], 0
        if rows:
            yield batch(rows)

    return files.where(F.col("file_type").isin(*_SHREDDERS)).select("path", "file_type", "content").mapInArrow(run, ROWS)


def errors(rows: DataFrame) -> DataFrame:
    """(path, error) of files that can't be read."""
    return rows.where("kind = 'error'").select("path", F.col("value").alias("error"))


def _readable(some: DataFrame, rows: DataFrame) -> DataFrame:
    return some.join(errors(rows).select("path"), "path", "left_anti")


def _target(c: Column) -> Column:
    return F.concat(F.lit("xl/"), F.regexp_replace(F.regexp_replace(c, "^/+", ""), "^xl/", ""))


def sheets(rows: DataFrame) -> DataFrame:
    """(path, sheet, name, part) of workbooks: sheets in their order from 1, without those whose relation is missing.

    Of relations with one id the last counts.
    """
    said = rows.where("kind = 'sheet'").select("path", F.col("nth").alias("sheet"), F.col("value").alias("name"), F.col("name").alias("_id"))
    targets = rows.where("kind = 'target'").groupBy("path", F.col("name").alias("_id")).agg(_target(F.max_by("value", "nth")).alias("part"))
    return said.join(targets, ["path", "_id"]).select("path", "sheet", "name", "part")


def _bodies(rows: DataFrame) -> DataFrame:
    """(path, part, lines) of all sheets' parts: their lines in order, each (row, cells), with shared strings by number."""
    in_order = lambda *columns: F.array_sort(F.collect_list(F.struct("nth", *columns)))
    strings = rows.where("kind = 'strings'").groupBy("path").agg(F.flatten(F.transform(in_order("said"), lambda s: s["said"])).alias("strings"))
    parts = rows.where("kind = 'line'").groupBy("path", "part").agg(in_order("said", "refs").alias("lines")).join(strings, "path", "left")
    total = F.coalesce(F.size("strings"), F.lit(0))

    def shared(ref: Column) -> Column:
        place = F.when(ref < 0, ref + total).otherwise(ref)
        return F.coalesce(F.get("strings", F.when((place >= 0) & (place < total), place).cast("int")), F.lit(""))

    cells_of = lambda line: F.zip_with(line["said"], line["refs"], lambda v, ref: F.when(ref.isNull(), v).otherwise(shared(ref)))
    return parts.select("path", "part", F.transform("lines", lambda line: F.struct(line["nth"].alias("row"), cells_of(line).alias("cells"))).alias("lines"))


def cells(rows: DataFrame) -> DataFrame:
    """(path, sheet, name, row, cell, value) of all cells; positions count from 0.

    Shared strings are found by number; negative numbers count from the end, bad ones give the empty text.
    """
    lines = _bodies(rows).select("path", "part", F.inline("lines"))
    each = lines.select("path", "part", "row", F.posexplode("cells").alias("cell", "value")).withColumn("cell", F.col("cell").cast("long"))
    return each.join(sheets(rows), ["path", "part"]).select("path", "sheet", "name", "row", "cell", "value")


def _joined(value: str, order: str, between: str) -> Column:
    """Non-empty values in their order; equal positions don't occur."""
    kept = F.array_sort(F.collect_list(F.when(F.col(value) != "", F.struct(order, value))))
    return F.array_join(F.transform(kept, lambda s: s[value]), between)


def _numbered(texts: DataFrame) -> DataFrame:
    """(path, page_number, text) of (path, nth, text): cleaned, blank ones gone, the rest numbered anew."""
    clean = texts.withColumn("text", clean_db_text(F.col("text"))).where(strip(F.col("text")) != "")
    return clean.withColumn("page_number", F.row_number().over(Window.partitionBy("path").orderBy("nth"))).select("path", "page_number", "text")


def workbook_pages(rows: DataFrame) -> DataFrame:
    """(path, page_number, text): a page a sheet, under a line that names it, a line a row, tabs between non-empty cells."""
    text = lambda line: F.array_join(F.filter(line["cells"], lambda v: v != ""), "\t")
    bodies = _bodies(rows).select("path", "part", F.array_join(F.filter(F.transform("lines", text), lambda t: t != ""), "\n").alias("body"))
    named = _readable(sheets(rows), rows).join(bodies, ["path", "part"], "left")
    head = F.concat(F.lit("[Sheet: "), "name", F.lit("]"))
    return _numbered(named.select("path", F.col("sheet").alias("nth"), F.concat_ws("\n", head, F.nullif("body", F.lit(""))).alias("text")))


def slide_pages(rows: DataFrame) -> DataFrame:
    """(path, page_number, text): a page a slide by number, a line a paragraph; blank slides go."""
    said = rows.where("kind = 'paragraph'").groupBy("path", "nth").agg(_joined("value", "sub", "\n").alias("text"))
    return _numbered(_readable(said, rows))
