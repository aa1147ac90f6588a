import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerloom.plans.sources import SPEC
from ledgerloom.sources import files as R
from ledgerloom.sources import segment as G
from ledgerloom.sources import store as S


def test_segments_of_a_specification():
    n = G.segment(SPEC)
    assert [x["heading"] for x in n] == ["DIVISION 01 – GENERAL REQUIREMENTS", "SECTION 01-45-00: Quality Control", "PART 1 - GENERAL", "1.1 Owner QC", "1.2 Contractor QC", "019100 General Commissioning Requirements"]
    assert [x["level"] for x in n] == [1, 2, 3, 4, 4, 2]
    assert [x["parent"] for x in n] == [None, 0, 1, 2, 2, 0]
    assert [x["number"] for x in n] == ["", "01 45 00", "01 45 00", "01 45 00", "01 45 00", "01 91 00"]
    assert [x["page_start"] for x in n] == [10, 10, 10, 10, 10, 11]
    assert n[3]["text"].startswith("Owner shall inspect") and n[3]["path"][-2:] == ["PART 1 - GENERAL", "1.1 Owner QC"]


def test_flat_empty_and_null_documents():
    assert G.segment(None) == [] == G.segment("")
    assert [(x["heading"], x["text"]) for x in G.segment("just some words\nmore of them.")] == [("Document beginning", "just some words\nmore of them.")]


def test_headings_below_the_beginning_of_a_document():
    n = G.segment("just some words\n1.2.3 Deep Point\nmore\n#### Deeper")
    assert [(x["heading"], x["level"], x["parent"]) for x in n] == [("Document beginning", 4, None), ("1.2.3 Deep Point", 5, 0), ("Deeper", 6, 1)]


def test_long_sections_are_cut_at_blank_lines(spark):
    text = "PART 1 GENERAL\n" + "\n\n".join("word " * 300 for _ in range(12))
    p = G.parts("\n\n".join("x" * 3000 for _ in range(5)))
    assert [len(x) for x in p] == [6002, 6002, 3000] and G.parts("y" * 9000) == ["y" * 9000]
    rows = G.sections(spark.createDataFrame([("d", text), ("e", None)], "id string, text string")).orderBy("ord").collect()
    assert len(rows) > 1 and rows[0]["section_id"] == "d#0" and rows[1]["parent_id"] == "d#0" and rows[1]["heading"].endswith("— Part 2")


def test_line_kind_equals_segmenter(spark):
    lines = [*SPEC.split("\n"), "# Title", "### x", "APPENDIX B", "ALL CAPS LINE", "A B", "a sentence of words.", "x" * 181, "1.2.3) Deep Point", "Page 9", "  "]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", G.line_kind("l").alias("k")).collect()
    assert all(r["k"] == G._kind(" ".join(r["l"].split())) for r in got)


def docx(text):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in text)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return b.getvalue()


def xlsx(rows):
    b, ns = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Log" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Submittal No</t></si></sst>')
        cell = lambda c, r, v: f'<c r="{c}{r}" t="s"><v>0</v></c>' if v == "Submittal No" else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        body = "".join(f'<row r="{r}">' + "".join(cell("ABC"[i], r, v) for i, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return b.getvalue()


PDF = b"%PDF-1.4\n1 0 obj <</Length 60>> stream\nBT 1 0 0 1 72 700 Tm (Sheet \\(A\\)) Tj 50 0 Td [(A-1) -20 (01)] TJ ET\nendstream endobj\n2 0 obj <</Length 9>> stream\nBT 10 20 Td (Two) Tj T* (x) Tj ET\nendstream endobj"


def test_office_and_pdf_readers_report_errors_by_file(spark, tmp_path):
    for sub, good in (("d", docx(["One", "Two"])), ("x", xlsx([["Report", "", ""], ["Submittal No", "Status", "Due Date"], ["1", "Open", "09/08/26"], ["", "", ""], ["2", "", "x"]])), ("p", PDF)):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "good").write_bytes(good)
        (tmp_path / sub / "bad").write_bytes(b"nothing")
    d = R.read_docx(spark, str(tmp_path / "d")).collect()
    assert sorted((r["text"], bool(r["error"])) for r in d if r["text"]) == [("One\nTwo", False)] and sum(bool(r["error"]) for r in d) == 1
    x = R.read_workbooks(spark, str(tmp_path / "x")).where("error is null").orderBy("row_number").collect()
    assert [(r["sheet"], r["row_number"], r["fields"]) for r in x] == [("Log", 3, {"Submittal No": "1", "Status": "Open", "Due Date": "09/08/26"}), ("Log", 5, {"Submittal No": "2", "Due Date": "x"})]
    p = R.read_pdf(spark, str(tmp_path / "p"))
    assert [(r["page"], r["text"], r["x"], r["y"]) for r in p.where("error is null").orderBy("item").collect()] == [(1, "Sheet (A)", 72.0, 700.0), (1, "A-101", 122.0, 700.0), (2, "Two", 10.0, 20.0), (2, "x", 10.0, 20.0)]
    assert p.where("error is not null").count() == 1
    lines = R.lines_of(p.where("error is null"), ["path", "page"], 1.0).orderBy("page").collect()
    assert [r["text"] for r in lines] == ["Sheet (A) A-101", "Two x"]


def test_text_delimited_and_catalog_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.MD").write_text("# x\ny")
    r = R.read_texts(spark, str(tmp_path / "t")).first()
    assert (r["name"], r["extension"], r["text"]) == ("a.MD", "md", "# x\ny")
    (tmp_path / "c.csv").write_text('Submittal No,,Note\n1,a,"x, ""y""\nz"\n2,b\n')
    c = R.read_delimited(spark, str(tmp_path / "c.csv"))
    assert c.columns == ["Submittal No", "Column 2", "Note", "_corrupt"] and c.first()["Note"] == 'x, "y"\nz' and c.first()["_corrupt"] is None
    assert [(r["Column 2"], r["Note"], r["_corrupt"]) for r in c.where("`Submittal No` = '2'").collect()] == [("b", None, "2,b")]
    (tmp_path / "k.json").write_text(json.dumps({"drawingSetId": "s", "buildingId": "b", "sheets": [{"sheetNumber": "A-1", "pdfPageNumber": 3}, {"sheetNumber": "A-2", "pdfPageNumber": 4}]}))
    assert [(r["drawingSetId"], r["sheetNumber"]) for r in R.read_catalogs(spark, str(tmp_path / "k.json")).orderBy("sheetNumber").collect()] == [("s", "A-1"), ("s", "A-2")]


def test_store_put_replace_and_cascade(spark, tmp_path):
    st = S.Store(spark, str(tmp_path / "store"))
    docs = lambda rows: spark.createDataFrame(rows, "id string, project_id string, name string")
    st.put("documents", docs([("d1", "p", "a"), ("d2", "p", "b"), ("d3", "q", "c")]))
    st.put("documents", docs([("d2", "p", "new"), ("d4", "q", "d")]))
    assert sorted((r["id"], r["name"]) for r in st.read("documents").collect()) == [("d1", "a"), ("d2", "new"), ("d3", "c"), ("d4", "d")]
    st.put("sections", spark.createDataFrame([("s1", "p", "d1"), ("s2", "p", "d2")], "id string, project_id string, document_id string"))
    st.remove_documents(docs([("d2", "p", "")]))
    assert {r["id"] for r in st.read("documents", "p").collect()} == {"d1"} and {r["id"] for r in st.read("sections").collect()} == {"s1"}
    assert st.read("records") is None


def test_import_checks_and_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "p"), ("d1", "p"), ("d2", "x")], "id string, project_id string")
    secs = spark.createDataFrame([("s1", "p", "d1"), ("s2", "p", "zz")], "id string, project_id string, document_id string")
    got = {(r["table"], r["issue"]): r["n"] for r in S.import_issues({"documents": docs, "sections": secs}, "p").collect()}
    assert got == {("documents", "repeated-id"): 1, ("documents", "foreign-project"): 1, ("sections", "repeated-id"): 0, ("sections", "foreign-project"): 0, ("sections", "unknown-document"): 1}
    S.export_json({"sections": secs}, str(tmp_path / "x"))
    assert sorted(S.import_json(spark, str(tmp_path / "x"), {"sections": secs.schema})["sections"].collect()) == sorted(secs.collect())
    f = S.with_fingerprint(spark.createDataFrame([(bytearray(b"a"),)], "content binary"))
    assert f.first()["fingerprint"].startswith("ca978112") and f.where(F.length("fingerprint") == 64).count() == 1
