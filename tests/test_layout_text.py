import datetime

from girder.operators import layout_text as L


def test_title_block(spark):
    spans = [("s", "Drawing No.", 10.0, 10.0), ("s", "FP-101", 30.0, 10.5), ("s", "far away", 300.0, 10.0), ("s", "Rev", 10.0, 20.0), ("s", "P3", 11.0, 25.0), ("t", "Rev", 0.0, 0.0)]
    out = L.labelled_values(spark.createDataFrame(spans, "sheet string, text string, x double, y double"), "sheet", {"number": r"drawing no", "revision": r"^rev"})
    assert sorted(map(tuple, out.collect())) == [("s", "number", "FP-101"), ("s", "revision", "P3")]


def test_tags_and_schedules(spark):
    symbols = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 5.0, 0.0)], "sheet string, id int, x double, y double")
    spans = spark.createDataFrame([("s", 1, "FHR-1", 2.0, 0.0), ("s", 2, "FHR-2", 2.5, 0.0), ("s", 3, "note", 0.0, 0.0)], "sheet string, id int, text string, x double, y double")
    assert sorted((r.a, r.b) for r in L.tagged(symbols, spans, "sheet", r"^FHR-\d+$", 10.0).collect()) == [(1, 1), (2, 2)]
    lines = [("s", 1, ["title"]), ("s", 2, ["Tag", "Size"]), ("s", 3, ["P-1", "50"]), ("s", 4, ["P-2", "65"]), ("s", 5, ["notes"]), ("s", 6, ["P-9", "80"]), ("s", 7, ["TAG"]), ("s", 8, ["P-3"])]
    rows = L.schedule_rows(spark.createDataFrame(lines, "sheet string, n int, cells array<string>"), "sheet", "n", "cells", r"^tag$", r"^P-\d+$")
    assert [r.cells[0] for r in rows.orderBy("n").collect()] == ["P-1", "P-2", "P-3"]


def test_quotation(spark):
    lines = [("q", i, c) for i, c in enumerate([["Quotation No: Q-77"], ["Date", "05/03/2024"], ["Currency", "SGD"], ["Validity", "60 days"], ["Delivery terms", "cif"], ["Exclusions"], ["Testing"], ["Painting"], ["Notes:"], ["none"]])]
    r = L.quotation_fields(spark.createDataFrame([*lines, ("empty", 0, ["x"])], "doc string, n int, cells array<string>"), "doc", "n", "cells")
    got = {x.doc: tuple(x)[1:] for x in r.collect()}
    assert got["q"] == ("Q-77", datetime.date(2024, 3, 5), 60, "SGD", "CIF", ["Testing", "Painting"])
    assert got["empty"] == (None, None, None, None, None, [])
