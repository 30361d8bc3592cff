import io
import json
import zipfile

from tidemark.sources import packaged

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
SHEET = f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>City</t></is></c></row><row r="3"><c r="A3"><v>5.0</v></c><c r="B3"><v>x</v></c></row><row r="4"/></sheetData><mergeCells><mergeCell ref="B3:B4"/></mergeCells></worksheet>'


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def xlsx():
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped({
        "xl/workbook.xml": f'<workbook {NS} xmlns:r="{r}"><sheets><sheet name="Hidden" state="hidden" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><r><t>Na</t></r><r><t>me</t></r></si></sst>", "xl/worksheets/sheet1.xml": SHEET})


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    return zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>"})


def test_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.json").write_text(json.dumps({"n": 1, "items": [{"a": {"b": 1}, "c": ["x", "y"]}, {"d": None}]}))
    (tmp_path / "d.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    (tmp_path / "e.xlsx").write_bytes(b"broken")
    got = {}
    for r in packaged.read_packaged(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["part"], r["row"], r["cells"], r["problem"]))
    assert got["a.xlsx"] == [("Hidden", 1, ["Name", "", "City"], None), ("Hidden", 3, ["5", "x"], None), ("Hidden", 4, ["", "x"], None)]
    assert got["b.docx"] == [("text", 1, ["Intro"], None), ("table 1", 1, ["a", "b"], None)]
    assert got["c.json"] == [("objects", 0, ["a.b", "c", "d"], None), ("objects", 1, ["1", "x; y", ""], None), ("objects", 2, ["", "", ""], None)]
    assert ("bad line", 2, ["not json"], None) in got["d.jsonl"] and ("objects", 3, ["2"], None) in got["d.jsonl"]
    assert got["e.xlsx"][0][3].startswith("BadZipFile")


def test_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"x.txt": b"1", "../up.txt": b"2", "in.zip": zipped({"y.txt": b"3", "in.zip": zipped({"in.zip": zipped({"z": b"4"})})})}))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {(r["path"].rsplit("/", 1)[-1], r["member"]): (r["content"] and bytes(r["content"]), r["problem"]) for r in packaged.read_archives(spark, str(tmp_path)).collect()}
    assert got["a.zip", "x.txt"] == (b"1", None) and got["a.zip", "in.zip/y.txt"] == (b"3", None)
    assert got["a.zip", "../up.txt"] == (None, "unsafe path") and got["a.zip", "in.zip/in.zip/in.zip"] == (None, "nested too deeply")
    assert got["b.zip", None][1].startswith("unreadable")
