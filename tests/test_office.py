"""Office archives made in the test, uploads and deliveries."""

from __future__ import annotations

import zipfile

from docloom.sources import office

W, S = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_word(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>é</w:t></w:r></w:p><w:p/><w:p><w:r><w:tab/><w:t>two</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="x" xmlns:d="y"><d:title>T</d:title><d:creator/></c:coreProperties>')


def write_sheet(path, rows):
    shared = sorted({c for row in rows for c in row if isinstance(c, str)})
    cells = lambda n, row: "".join("" if c is None else f'<c r="{chr(65 + i)}{n}" t="s"><v>{shared.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + i)}{n}"><v>{c}</v></c>' for i, c in enumerate(row))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Export" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{S}"><sheetData>' + "".join(f"<row>{cells(n, row)}</row>" for n, row in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_word_files(spark, tmp_path):
    write_word(tmp_path / "a.docx")
    (tmp_path / "b.docx").write_bytes(b"no archive")
    out = {r.path.rsplit("/", 1)[1]: r for r in office.read_word_files(spark, str(tmp_path)).collect()}
    assert out["a.docx"].text == "One é\n\n\ttwo" and out["a.docx"].properties == {"title": "T"}
    assert out["b.docx"].text == "" and out["b.docx"].properties == {}


def test_sheets_and_deliveries(spark, tmp_path):
    write_sheet(tmp_path / "d.xlsx", [["Plan ID", "Lives", "Name"], ["p1", 12, "a"], [None, 1, "x"], ["p2", 3.5], ["No filters applied"]])
    (tmp_path / "e.xlsx").write_bytes(b"none")
    rows = office.read_sheets(spark, str(tmp_path))
    assert [r.cells for r in rows.orderBy("row").collect()][1:4] == [["p1", "12", "a"], [None, "1", "x"], ["p2", "3.5"]]
    out = office.by_header(rows, {"Plan ID": "plan", "Name": "name", "Other": "other"}).orderBy("plan").collect()
    assert [(r.plan, r.name, r.other) for r in out] == [("p1", "a", None), ("p2", None, None)]
    assert office.sheet_text(rows).first().text.split("\n")[1] == "p1 12 a"


def test_uploads(spark, tmp_path):
    lines = ["n1\thttp://a.b|ftp://x|https://c.d/e\tt1, t2\t\tk\t", "n2\t\t\tpdf,doc\t\tMANUAL"]
    (tmp_path / "u.tsv").write_text("\n".join(lines))
    expected = {"n1": (["http://a.b", "https://c.d/e"], ["t1", "t2"], ["pdf"], ["k"], "AUTOMATED"), "n2": ([], [], ["pdf", "doc"], [], "MANUAL")}
    write_sheet(tmp_path / "u.xlsx", [[c or None for c in line.split("\t")] for line in lines])
    (tmp_path / "u.json").write_text('{"name": "n1", "base_urls": ["http://a.b"]}')
    for name in ("u.tsv", "u.xlsx"):
        out = {r.name: (r.base_urls, r.tags, r.doc_exts, r.url_keywords, r.collection_method) for r in office.read_upload(spark, str(tmp_path / name)).collect()}
        assert out == expected
    assert office.read_upload(spark, str(tmp_path / "u.json")).first().base_urls == ["http://a.b"]
