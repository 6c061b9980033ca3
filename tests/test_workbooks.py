"""Workbooks with merged ranges, shared texts, dates and odd parts, written ones read back, and code told from its tree."""

import io
import zipfile

from pyspark.sql import functions as F

from trailgrid.functions.code import presented, presentation
from trailgrid.sinks.workbooks import workbooks
from trailgrid.sources.tables import folder_totals
from trailgrid.sources.workbooks import read_workbooks, workbook_cells, workbook_lines

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def made():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = (
            '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"/></row>'
            '<row r="3"><c r="A3" s="1"><v>45000</v></c><c r="B3" s="2"><v>45000.5</v></c><c r="C3" s="3"><v>1.50</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" t="e"><v>#REF!</v></c></row>'
            '<row><c t="inlineStr"><is><t> </t></is></c><c><v>7</v></c></row>'
        )
        z.writestr("xl/worksheets/one.xml", f'<worksheet {MAIN}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="B1:C2"/></mergeCells></worksheet>')
    return out.getvalue()


def test_cells_and_lines(spark):
    files = spark.createDataFrame([("d/b.xlsx", made()), ("d/no.xlsx", b"text"), ("d/null.xlsx", None)], "path string, content binary")
    got = {(r.row_no, r.col_no): r.value for r in workbook_cells(files).collect()}
    assert got == {(1, 1): "plain", **{(i, j): "rich" for i in (1, 2) for j in (2, 3)}, (3, 1): "2023-03-15", (3, 2): "2023-03-15 12:00:00", (3, 3): "1.5", (3, 4): "True", (3, 5): "#REF!", (4, 1): " ", (4, 2): "7"}
    rows = [(r.table, r.line_no, r.content) for r in workbook_lines(files).orderBy("line_no").collect()]
    assert rows == [("b.xlsx", 1, "plain,rich,rich,,"), ("b.xlsx", 2, ",rich,rich,,"), ("b.xlsx", 3, "2023-03-15,2023-03-15 12:00:00,1.5,True,#REF!"), ("b.xlsx", 4, ",7,,,")]
    assert workbook_lines(files.limit(0)).count() == 0


def test_written_files_are_read_from_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([("b", "s1", 2, ["<&>", None, "a\x01b"]), ("b", "s1", 1, [" x ", "多"]), ("b", 's"2', 1, ["1"]), ("b", None, 1, ["lost"])], "path string, sheet string, row_no int, cells array<string>")
    (tmp_path / "b.xlsx").write_bytes(bytes(workbooks(rows).first().content))
    got = sorted((r.sheet, r.row_no, r.col_no, r.value) for r in workbook_cells(read_workbooks(spark, str(tmp_path))).collect())
    assert got == sorted([("s1", 1, 1, " x "), ("s1", 1, 2, "多"), ("s1", 2, 1, "<&>"), ("s1", 2, 3, "ab"), ('s"2', 1, 1, "1")])


def test_folders(spark):
    files = spark.createDataFrame([("file:/r/a.csv", 1), ("file:/r/x/b.csv", 2), ("file:/r/x/y/c.csv", 4), ("file:/q/z.csv", 8)], "path string, size long")
    assert sorted(map(tuple, folder_totals(files, "/r").collect())) == [(".", 0, 3, 7, 1), ("x", 1, 2, 6, 1), ("x/y", 2, 1, 4, 1)]


def test_code(spark):
    say = 'import json\nprint(json.dumps({"answer": "a", "data_source": []}))'
    assert presented(say) == (True, {"answer": "a", "data_source": []})
    assert presented('print(\'{"answer": 3}\')') == (True, {"answer": 3})
    assert presented('import json\nr = {"answer": None}\nprint(json.dumps(r))') == (True, None)
    assert presented('import json\nr = {"answer": 1}\nprint(json.dumps("done"))') == (True, {"answer": 1}) and presented('import json\nprint(json.dumps({"other": 1}))') == (True, None)
    for code in (None, "", "print(1)", "print(json.dumps(", "import json\nx = load()\nprint(json.dumps(x))", "import json\nfor i in []:\n print(json.dumps(i))", 'import json\nprint(json.dumps({"answer": -1}))', "import json\nx = y\nprint(json.dumps(x))", "import json\nx = {[]: 1}\nprint(json.dumps(x))", "import json\x00print"):
        assert presented(code) == (False, None), code
    rows = spark.createDataFrame([(say,), (None,)], "c string").select(presentation(F.col("c")).alias("p")).collect()
    assert [(r.p.only_presents, r.p.answer) for r in rows] == [(True, '{"answer": "a", "data_source": []}'), (False, None)]
