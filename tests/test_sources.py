import io
import json
import zipfile

import numpy as np
import pytest

from quadrille.sources import files, workbooks

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>44197</v></c><c r="C1" t="b"><v>1</v></c></row>
<row r="2"><c r="A2"><v>3.5</v></c><c r="B2" t="e"><v>#REF!</v></c><c r="C2" t="str"><f>1+1</f><v>two</v></c></row>
<row r="300"><c r="A300" t="inlineStr"><is><t>late</t></is></c></row></sheetData>
<mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>"""
STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts><font/><font><b/></font></fonts>
<fills><fill/><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill></fills><borders><border/><border><top style="thin"/></border></borders>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14" fontId="1" fillId="1" borderId="1"/></cellXfs></styleSheet>"""


def xlsx(styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" r:id="x1"/><sheet name="Sheet 1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", SHEET)
        z.writestr("xl/sharedStrings.xml", "<sst><si><r><t>he</t></r><r><t>ad</t></r></si></sst>")
        if styles:
            z.writestr("xl/styles.xml", styles)
    return out.getvalue()


def ods():
    content = """<office:d xmlns:office="o" xmlns:table="t" xmlns:text="x"><table:table table:name="T"><table:table-row>
    <table:table-cell table:number-columns-spanned="2" office:value-type="string"><text:p>a<text:s text:c="2"/>b</text:p></table:table-cell><table:covered-table-cell/>
    <table:table-cell office:value-type="float" office:value="5"><text:p>5.0</text:p></table:table-cell></table:table-row>
    <table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="date" office:date-value="2020-01-02T00:00"><text:p>2 Jan</text:p></table:table-cell></table:table-row>
    <table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="1024"/></table:table-row></table:table></office:d>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", content)
    return out.getvalue()


def plain(sheet):
    return {k: x.v for k, x in sheet.cells.items() if x.v is not None}


def test_xlsx_profiles():
    one = workbooks.read("a.xlsx", xlsx())
    assert plain(one) == {(0, 0): "head", (0, 1): "2021-01-01 00:00:00", (0, 2): "True", (1, 0): "3.5", (2, 0): "3.5", (1, 2): "two"}
    other = workbooks.read("a.xlsx", xlsx(), profile="encoder")
    assert plain(other)[1, 1] == "#REF!" and plain(other)[299, 0] == "late" and (2, 0) not in plain(other)
    assert (other.cells[0, 1].nf, other.cells[0, 1].attrs, other.merges) == ("mm-dd-yy", ["FontBold", "TopBorder", "FillColor"], [(1, 0, 2, 0)])
    assert plain(workbooks.read("a.xlsx", xlsx(None)))[0, 1] == "44197"
    assert workbooks.read("a.xlsx", xlsx(), "Sheet1").name == "Sheet 1"
    with pytest.raises(ValueError):
        workbooks.read("a.xlsx", xlsx(), "None such")


def test_ods_profiles():
    one = workbooks.read("a.ods", ods())
    assert plain(one) == {(0, 0): "a  b", (0, 1): "a  b", (0, 2): "5.0", (1, 2): "2 Jan", (2, 2): "2 Jan"} and one.merges == [(0, 0, 0, 1)]
    other = workbooks.read("a.ods", ods(), profile="encoder")
    assert plain(other) == {(0, 0): "a  b", (0, 1): "5", (1, 2): "2020-01-02", (2, 2): "2020-01-02"}


def test_csv_and_formats():
    assert plain(workbooks.read("a.csv", "x;y\n1;\n2;é\n".encode())) == {(0, 0): "x", (0, 1): "y", (1, 0): "1", (2, 0): "2", (2, 1): "é"}
    assert plain(workbooks.read("a.csv", b"x;y\n", profile="encoder")) == {(0, 0): "x;y"}
    assert plain(workbooks.read("a.tsv", b"x\ty\n")) == {(0, 0): "x", (0, 1): "y"}
    assert plain(workbooks.read("a.csv", "﻿x,é".encode("utf-16-le")))[0, 1] == "é" and plain(workbooks.read("a.csv", b"\xe9,1"))[0, 0] == "é"
    d = workbooks.detect_format
    assert (d("a.bin", ods()), d("a.bin", xlsx()), d("a", b"\xd0\xcf\x11\xe0xx"), d("a.x", b"q", "text/csv; charset=x"), d("a.asp", b"q", profile="encoder"), d("a", ods(), profile="encoder"), d("a.ods", ods(), profile="encoder")) == ("ods", "xlsx", "xls", "csv", "csv", "xlsx", "ods")
    with pytest.raises(ValueError):
        d("a.txt", b"q")


def test_wide_merges_and_gaps():
    cells = {(r, 0): workbooks.Cell("x") for r in (0, 5, 206)}
    assert set(workbooks.until_gap(cells)) == {(0, 0), (5, 0)}
    sheet = workbooks.Sheet("s", {(0, 0): workbooks.Cell("title"), (1, 3): workbooks.Cell("v")}, [(0, 0, 0, 16383)])
    assert max(c for _, c in workbooks._as_classifier(sheet).cells) == 3


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "b.ods").write_bytes(ods())
    (tmp_path / "c.xls").write_bytes(b"\xd0\xcf\x11\xe0 broken")
    read = files.sheets(spark, str(tmp_path))
    cells, areas, failed = files.split_cells(read)
    assert cells.count() == 11 and areas.count() == 2 and [r.file_path.endswith("c.xls") for r in failed.collect()] == [True]
    assert {r.file_path[-4:]: r.format for r in files.formats(spark, str(tmp_path)).collect()} == {"xlsx": "xlsx", ".ods": "ods", ".xls": "xls"}
    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n/annotations_q.npz", labels=np.array([[1, 2], [0, 2]]), anchor_labels=np.array([3, 1]), ranges=np.array(["A1:B2"]), ranges_original=np.array([b"B4:C5"]))
    path = str(tmp_path / "n/annotations_q.npz")
    assert [(r.range, tuple(r.box)) for r in files.ground_truth(spark, path).collect()] == [("B4:C5", (3, 1, 4, 2))]
    assert files.ground_truth(spark, path, original=False).first().range == "A1:B2"
    assert sorted((r.r, r.c, r.label) for r in files.label_grids(spark, path).collect()) == [(3, 1, 1), (3, 2, 2), (4, 1, 0), (4, 2, 2)]


def test_manifest_and_results(spark, tmp_path):
    (tmp_path / "m.csv").write_text("source,file_path,sheet_name,mime_type,labels_path,uuid,url\ns,/x/EQ08__13.xls,,,/y/annotations_u.npz,u,\ns,/x/b.xls,S,,/y/annotations_v.npz,v,\n")
    assert [r.sheet_file for r in files.manifest(spark, str(tmp_path / "m.csv"), "EQ08__13").collect()] == ["v.csv"]
    fold = tmp_path / "r" / "fold_3"
    fold.mkdir(parents=True)
    (fold / "a.json").write_text(json.dumps({"file_path": "f", "gt_ranges": ["A1:B2"], "metrics": {"tp": 1}, "metrics_iou": {"tp@0.5": 1.0}}, indent=1))
    (fold / "inference_timing.json").write_text(json.dumps({"fold": 3, "n_ok": 1}))
    assert [(r.file_path, r.fold, r.metrics.tp) for r in files.results(spark, str(tmp_path / "r")).collect()] == [("f", 3, 1)]
    (fold / "metrics.json").write_text(json.dumps({"per_file": [{"file": "q", "predicted_ranges": ["A1"], "gt_ranges": []}]}))
    assert files.per_file_metrics(spark, str(fold / "metrics.json")).first().file == "q"
