"""Workbooks and slides as relations against the reader that takes a file in one call, and against written-out cases."""

import io
import random
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pytest
from pyspark.sql import functions as F

from corvella.sources import office, sheets

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def archive(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return data.getvalue()


def workbook(pages, strings=(), extra=None, relations=None):
    """pages: (name, rows of cells (type, text))."""
    members = {"xl/workbook.xml": f"<workbook {_NS}><sheets>" + "".join(f"<sheet name={quoteattr(n)} r:id='r{i}'/>" for i, (n, _) in enumerate(pages)) + "</sheets></workbook>"}
    targets = relations or {f"r{i}": f"worksheets/sheet{i}.xml" for i in range(len(pages))}
    members["xl/_rels/workbook.xml.rels"] = "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{k}' Target='{t}'/>" for k, t in targets.items()) + "</Relationships>"
    if strings:
        members["xl/sharedStrings.xml"] = f"<sst {_NS}>" + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t xml:space='preserve'>{escape(s[2:])}</t></r></si>" for s in strings) + "</sst>"
    for i, (_, rows) in enumerate(pages):
        body = ""
        for row in rows:
            body += "<row>" + "".join(f"<c t='inlineStr'><is><t>{escape(v)}</t></is></c>" if t == "inlineStr" else f"<c t='{t}'><v>{escape(v)}</v></c>" for t, v in row) + "</row>"
        members[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>"
    return archive(members | (extra or {}))


def slides(by_number):
    return archive({f"ppt/slides/slide{n}.xml": f"<p:sld {_A} xmlns:p='x'>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in said) + "</p:sld>" for n, said in by_number})


@pytest.fixture
def pages_of(spark):
    def run(*files):
        given = spark.createDataFrame([(f"f{i}", kind, content) for i, (kind, content) in enumerate(files)], "path string, file_type string, content binary").repartition(3)
        rows = sheets.part_rows(given).cache()
        got = sheets.workbook_pages(rows).unionByName(sheets.slide_pages(rows))
        want = office.parse_office(given).select("path", F.inline("pages"))
        found = sorted(tuple(r) for r in got.collect())
        assert found == sorted(tuple(r) for r in want.collect())
        said = {r.path: r.error for r in sheets.errors(rows).collect()}
        return [(int(p[1:]), n, t) for p, n, t in found], said

    return run


def test_shared_strings_from_both_ends_and_bad_numbers(pages_of):
    book = workbook([("Terms & more", [[("s", "0"), ("s", "-1"), ("s", "7"), ("s", "-9"), ("s", "x"), ("n", "4.5"), ("inlineStr", " tail ")], [("s", "99999999999999999999")], [("b", "1")]])], ["heat < cold", "  last  "])
    found, _ = pages_of(("xlsx", book))
    assert found == [(0, 1, "[Sheet: Terms & more]\nheat < cold\tlast\t4.5\ttail\n1")]


def test_sheets_keep_their_order_and_dangling_ones_go(pages_of):
    book = workbook([(f"Sheet no. {i}", [[("n", str(i))]]) for i in range(12)], relations={f"r{i}": ("/xl/" if i % 2 else "") + f"worksheets/sheet{11 - i}.xml" for i in range(12) if i != 4} | {"r7": "worksheets/nowhere.xml", "other": "theme/broken.xml"}, extra={"xl/theme/broken.xml": "<not xml"})
    found, said = pages_of(("xlsx", book))
    assert [t for _, _, t in found] == [f"[Sheet: Sheet no. {i}]" + (f"\n{11 - i}" if i != 7 else "") for i in range(12) if i != 4] and not said
    assert [n for _, n, _ in found] == list(range(1, 12))


def test_slides_by_number_and_blank_ones(pages_of):
    found, _ = pages_of(("pptx", slides([(10, ["ten"]), (9, ["nine", "", " again "]), (2, ["", "  "]), (1, ["one\x7f"])])))
    assert found == [(0, 1, "one\x7f"), (0, 2, "nine\nagain"), (0, 3, "ten")]


def test_files_that_cannot_be_read(pages_of):
    good = workbook([("a", [[("n", "1")]])])
    broken = workbook([("a", [[("n", "1")]])], extra={"xl/sharedStrings.xml": "<sst><si>"})
    found, said = pages_of(("xlsx", b"plain"), ("xlsx", archive({"x": "y"})), ("xlsx", broken), ("xlsx", None), ("xlsx", good), ("pptx", archive({"x": "y"})))
    assert found == [(4, 1, "[Sheet: a]\n1")]
    assert set(said) == {"f0", "f1", "f2", "f3"} and said["f1"] == "Office document is missing xl/workbook.xml." and "invalid XML" in said["f2"]


def test_no_files(spark):
    rows = sheets.part_rows(spark.createDataFrame([], "path string, file_type string, content binary"))
    assert sheets.workbook_pages(rows).count() == sheets.slide_pages(rows).count() == sheets.errors(rows).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_random_workbooks(pages_of, seed):
    rnd = random.Random(seed)
    files = []
    for _ in range(12):
        strings = ["".join(rnd.choice("ab <&é \t") for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(5))]
        cell = lambda: rnd.choice([("s", str(rnd.randrange(-6, 6))), ("n", str(rnd.random())), ("inlineStr", rnd.choice(["", "q", " w "])), ("str", "f")])  # noqa: E731,B023
        pages = [(rnd.choice(["", "n", "two words"]), [[cell() for _ in range(rnd.randrange(4))] for _ in range(rnd.randrange(4))]) for _ in range(rnd.randrange(1, 5))]
        files.append(("xlsx", workbook(pages, strings)))
    files += [("pptx", slides([(rnd.randrange(20), ["x" * rnd.randrange(3) for _ in range(rnd.randrange(4))]) for _ in range(5)])) for _ in range(4)]
    pages_of(*files)


def test_a_large_sheet_comes_in_bounded_batches(spark):
    book = workbook([("big", [[("s", str(i % 3)), ("n", str(i))] for i in range(30_000)])], ["aa", "bb", "cc"])
    rows = sheets.part_rows(spark.createDataFrame([("f", "xlsx", book)], "path string, file_type string, content binary"))
    assert sheets.cells(rows).where("name = 'big' and sheet = 1 and cell = 1 and value = cast(row as string)").count() == 30_000
    text = sheets.workbook_pages(rows).first().text.split("\n")
    assert text == ["[Sheet: big]", *(f"{('aa', 'bb', 'cc')[i % 3]}\t{i}" for i in range(30_000))]


def test_a_line_of_cells_is_one_row(spark):
    """Cells travel as arrays: rows grow with the lines of a workbook, not with its cells."""
    book = workbook([("wide", [[("s", str(i % 3000 - 1)) for i in range(5_000)]] * 3)], [f"t{i}" for i in range(3_000)])
    rows = sheets.part_rows(spark.createDataFrame([("f", "xlsx", book)], "path string, file_type string, content binary")).cache()
    assert rows.where("kind = 'line'").count() == 3 and rows.count() < 10
    line = "\t".join(f"t{(i % 3000 - 1) % 3000}" for i in range(5_000))
    assert sheets.workbook_pages(rows).first().text == "\n".join(["[Sheet: wide]", *[line] * 3])
