import datetime
import io
import zipfile
from decimal import Decimal
from email.message import EmailMessage

from pyspark.sql import functions as F

from girder.functions import text as X
from girder.operators import documents, drawing, layout_text
from girder.operators.checkpoints import checkpointed
from girder.sources import files, office
from girder.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs):
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_clauses_of_text_files(spark, tmp_path):
    told = [("", "preface"), ("H1", "2 Pipes"), ("", "general words"), ("", "2.1 Material is steel"), ("", "50 mm pipes are threaded"), ("", "2.2 Joints"), ("", "9.9 parts a day"), ("H1", "no number"), ("H1", "3. Pumps")]
    (tmp_path / "a.docx").write_bytes(docx(told))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    paragraphs = office.read_paragraphs(spark, str(tmp_path / "*.docx"))
    assert [r.problem for r in paragraphs.filter("text IS NULL").collect()] == ["unreadable: BadZipFile"]
    out = documents.numbered_clauses(paragraphs, "path", "paragraph", "style", "text")
    assert [tuple(r)[1:] for r in out.orderBy("ordinal").collect()] == [
        (0, "2", "Pipes", "general words"),
        (1, "2.1", "", "Material is steel 50 mm pipes are threaded"),
        (2, "2.2", "", "Joints 9.9 parts a day no number"),
        (3, "3", "Pumps", ""),
    ]
    assert office.openings(paragraphs, lines=2).first().text == "preface\n2 Pipes"


def test_quotations_of_mails_and_workbooks(spark, tmp_path):
    book = tmp_path / "q.xlsx"
    files.write_workbook([["Quotation No", "Q-1"], ["", ""], ["Currency", "SGD"]], str(book))
    mail = EmailMessage()
    mail["From"], mail["Subject"] = "a@example.com", "offer"
    mail.set_content("Validity\t30 days\n\nDelivery   CIF\nExclusions:\n")
    mail.add_attachment(book.read_bytes(), maintype="application", subtype="octet-stream", filename="q.xlsx")
    (tmp_path / "m.eml").write_bytes(mail.as_bytes())
    lines = office.read_quotations(spark, str(tmp_path / "*"))
    got = [(r.part, r.row, r.cells) for r in lines.filter("path LIKE '%eml'").collect()]
    assert got == [
        ("headers", 1, ["From:", "a@example.com"]), ("headers", 2, ["Subject:", "offer"]),
        ("body", 1, ["Validity", "30 days"]), ("body", 3, ["Delivery", "CIF"]), ("body", 4, ["Exclusions:"]),
        ("q.xlsx", 1, ["Quotation No", "Q-1"]), ("q.xlsx", 3, ["Currency", "SGD"]),
    ]
    first = layout_text.quotation_fields(lines.filter("path LIKE '%xlsx'"), "path", "row", "cells").first()
    assert (first.reference, first.currency) == ("Q-1", "SGD")


def test_erp_export(spark, tmp_path):
    rows = [["Project", "Date", "Item_Key", "Unit", "Unit_Price_SGD"], ["p", "2024-03-01", "pipe|50", "m", "1,250.50"], ["", "", "", "", ""], ["q", "March", "pipe|50", "", "0"]]
    files.write_workbook(rows, str(tmp_path / "e.xlsx"), "HistoricalCosts")
    cells = files.read_workbooks(spark, str(tmp_path / "e.xlsx"))
    out = {r.row: r for r in office.erp_sheet(cells, "HistoricalCosts").collect()}
    assert out[2].date == datetime.date(2024, 3, 1) and out[2].problems == []
    assert out[4].problems == ["date: not a date", "unit: blank", "unit_price_sgd: not a price above zero"]
    assert [tuple(r) for r in office.past_prices(cells).collect()] == [("project", "p", datetime.date(2024, 3, 1), "pipe|50", "m", Decimal("1250.5000"))]


def test_file_revisions_and_duties(spark):
    names = ["FP-L05-201-R03.pdf", "FP_L05_201_RevC.pdf", "FP-L05-201 (C1).pdf", "FP-L05-201[T2].dwg", "FP-L05-201.pdf", "FP-L05-2010-A.pdf", "FP-L05-201-B.pdf", "FP-L05-201-AB.pdf", "FP-L05-201 (AB).pdf", "other.pdf", "FP-L05-201 Rev B.pdf", "FP-L05-201_REVISION-2 final.pdf", "FP.L05.201-REVIEW.pdf", "A-FP-L05-201-T2A.pdf", "A-FP-L05-201-T21-x.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(X.file_revision(F.col("n"), F.lit("FP-L05-201")).alias("r"))
    assert [r.r for r in df.collect()] == ["R03", "C", "C1", "T2", None, None, "B", None, "AB", None, "B", "2", None, None, "T21"]
    told = [("A flow test header shall be provided.", True), ("The contractor shall provide a brass test header", True), ("Power supply to the test header shall be provided by others.", False), (None, None), ("", False),
            ("Each test header must also be fitted with a drain.", True), ("The test header will be painted red.", False), ("The contractor shall supply and install one brass test header.", True),
            ("The contractor shall provide a pipe to the test header.", False), ("Drawings shall show the test header.", False)]
    got = spark.createDataFrame(told, "s string, ok boolean").select("ok", X.requires(F.col("s"), "test header").alias("r")).collect()
    assert all(r.ok == r.r for r in got)


def test_rooms_are_what_walls_enclose(spark):
    box = lambda s, x0, y0, x1, y1: [(s, x0, y0, x1, y0), (s, x1, y0, x1, y1), (s, x1, y1, x0, y1), (s, x0, y1, x0, y0)]
    walls = box("a", 2.0, 2.0, 8.0, 7.0) + [("a", 5.0, 2.0, 5.0, 7.0)] + box("b", 2.0, 2.0, 8.0, 7.0)[:3]
    sheets = [(s, 0.0, 0.0, 12.0, 12.0) for s in "abc"]
    five = "sheet string, x0 double, y0 double, x1 double, y1 double"
    out = drawing.rooms(spark.createDataFrame(walls, five), spark.createDataFrame(sheets, "sheet string, minx double, miny double, maxx double, maxy double"), "sheet", 1.0, checkpointed)
    assert sorted(tuple(r)[2:] for r in out.collect()) == [(8, 3, 3, 4, 6), (8, 6, 3, 7, 6)]
    # a brute-force fill of slanted walls
    slanted = [("a", 1.0, 6.0, 6.0, 1.0), ("a", 6.0, 1.0, 11.0, 6.0), ("a", 11.0, 6.0, 6.0, 11.0), ("a", 6.0, 11.0, 1.0, 6.0)]
    got = drawing.rooms(spark.createDataFrame(slanted, five), spark.createDataFrame(sheets[:1], "sheet string, minx double, miny double, maxx double, maxy double"), "sheet", 1.0, checkpointed)
    blocked = {(int(x0 + (x1 - x0) * k / 100), int(y0 + (y1 - y0) * k / 100)) for _, x0, y0, x1, y1 in slanted for k in range(101)}
    seen, stack = set(), [(6, 6)]
    while stack:
        c = stack.pop()
        if c not in seen and c not in blocked:
            seen.add(c)
            stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
    assert [r["cells"] for r in got.collect()] == [len(seen)]


def test_scope_and_criteria(spark):
    points = spark.createDataFrame([("s", 1.0, 1.0), ("s", 1.0, 9.0), ("t", 1.0, 9.0)], "sheet string, x double, y double")
    lines = spark.createDataFrame([("s", 0.0, 5.0, 10.0, 5.0, -1)], "sheet string, ax double, ay double, bx double, by double, side int")
    assert sorted(map(tuple, drawing.in_scope(points, lines, "sheet").collect())) == [("s", 1.0, 1.0), ("t", 1.0, 9.0)]
    notes = ["DESIGN CRITERIA FOR OFFICES:", "MAX SPACING: 3.0 m x 4.6 m", "MAXIMUM AREA OF COVERAGE PER SPRINKLER: 12 m2", "EXPOSED LAYER", "MAX SPACING 2m x 2m"]
    found = drawing.note_criteria(spark.createDataFrame([("s", i, t) for i, t in enumerate(notes)], "sheet string, n int, t string"), "sheet", "n", "t")
    assert [tuple(r) for r in found.collect()] == [("s", "DESIGN CRITERIA FOR OFFICES", 4600, 3000, 12.0)]


def test_jobs_are_queued_once(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "job int, lock string")
    queued = spark.createDataFrame([("b", "todo"), ("a", "done")], "lock string, status string")
    assert sorted(r.job for r in events.queued_once(jobs, queued, "lock", "job").collect()) == [1, 4, 5]
