import io
import zipfile

import pytest
from pyspark.sql import functions as F

from girder.sources import files, tables


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    inner = zipped([("deep.txt", b"deep")])
    rows = [("a.zip", zipped([("x.txt", b"x"), ("in.zip", inner), ("bomb", b"0" * 1_000_000)])), ("b.zip", b"no archive")]
    out = {r.path: (r.depth, bytes(r.content) if r.content else None, r.problem) for r in files.expand_archives(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["a.zip/x.txt"] == (1, b"x", None) and out["a.zip/in.zip/deep.txt"] == (2, b"deep", None)
    assert out["a.zip/bomb"][2] == "too large" and out["b.zip"][2] == "not an archive"


def test_kinds_and_pages(spark):
    df = spark.createDataFrame([("a.pdf", b"%PDF-1.7"), ("b.xlsx", b"PK\x03\x04.."), ("c.zip", b"PK\x03\x04.."), ("d.pdf", b"\x89PNG...."), ("e.dxf", b"0\nSECTION"), ("f", b"?")], "name string, content binary")
    assert [r.k for r in df.select(files.file_kind(F.col("content"), F.col("name")).alias("k")).collect()] == ["pdf", "xlsx", "zip", "png", "dxf", "unknown"]
    pages = spark.createDataFrame([(5, 1, 0, 0.0), (0, 0, 1, 0.9), (3, 0, 1, 0.9), (0, 0, 0, 0.0), (3, 0, 1, 0.1)], "p int, t int, i int, c double")
    assert [r.k for r in pages.select(files.page_class(F.col("p"), F.col("t"), F.col("i"), F.col("c")).alias("k")).collect()] == ["vector", "raster", "mixed", "empty", "vector"]


def test_workbook_round_trip_and_header(spark, tmp_path):
    rows = [["Project", "x"], ["Item", "Description", "Unit", "Qty"], ["A1", "pipe & fitting", "m", "12.5"]]
    files.write_workbook(rows, str(tmp_path / "b.xlsx"))
    cells = files.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert [r.cells for r in cells.orderBy("row").collect()] == rows
    head = files.header_rows(cells, {"description": "desc", "unit": "^unit", "quantity": "qty|quantity"}, "path", "sheet").first()
    assert head.row == 2 and head.header == {"description": 1, "unit": 2, "quantity": 3}


def test_primitives_are_pruned_by_folder(spark, tmp_path):
    path = str(tmp_path / "p")
    names = [f.split()[0].strip("`") for f in tables.PRIMITIVES.replace("\n", " ").split(", ")]
    row = {n: None for n in names} | {"kind": "line", "points": [0.0, 0.0, 1.0, 1.0]}
    df = spark.createDataFrame([row | {"bid_id": b, "sheet_id": s} for b in "xy" for s in "12"], tables.PRIMITIVES + ", bid_id string, sheet_id string")
    tables.write_primitives(df, path)
    back = tables.read_primitives(spark, path).filter("bid_id = 'x' AND sheet_id = '2'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(bid_id" in back._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="already exists"):
        tables.write_primitives(df, path)


def test_exports_and_stage_cache(spark, sf_dir, tmp_path):
    e = tables.table(spark, sf_dir, "events")
    tables.write_months(e, "ts", str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == e.count()
    tables.write_csv_page(e, [F.desc("ts"), "event_id"], 10, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 10
    done = e.filter("event_id < 5").select("event_id")
    assert tables.unseen(e, done, "event_id").count() == e.count() - 5
