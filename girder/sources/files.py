"""Files as tables: kinds by their first bytes, archives as rows, workbooks by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of the kinds that are told apart.
MAGIC = (("pdf", b"%PDF-"), ("zip", b"PK\x03\x04"), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"), ("tiff", b"II*\x00"), ("dwg", b"AC10"), ("ole", b"\xd0\xcf\x11\xe0"))
#: Among archives the name breaks the tie.
OFFICE = (("xlsx", r"\.xlsx$"), ("docx", r"\.docx$"))


def file_kind(content: Column, name: Column) -> Column:
    """The kind of a file: its first bytes decide, and its name only where they fit several kinds."""
    kind = F.when(F.lower(name).rlike(r"\.dxf$"), "dxf").when(F.lower(name).rlike(r"\.csv$"), "csv").otherwise("unknown")
    for label, first in reversed(MAGIC):
        found = F.lit(label)
        if label == "zip":
            for office, pattern in OFFICE:
                found = F.when(F.lower(name).rlike(pattern), office).otherwise(found)
        kind = F.when(F.substring(content, 1, len(first)) == F.lit(bytearray(first)), found).otherwise(kind)
    return kind


def page_class(paths: Column, texts: Column, images: Column, image_cover: Column, raster_cover: float = 0.5) -> Column:
    """vector, raster, mixed or empty, by what a page holds and how much of it images cover."""
    drawn = (paths + texts) > 0
    return F.when(~drawn & (images == 0), "empty").when((images > 0) & (image_cover >= raster_cover), F.when(drawn, "mixed").otherwise("raster")).otherwise(F.when(drawn, "vector").otherwise("raster"))


def page_content(paths: Column, texts: Column, images: Column, image_cover: Column, scan: float, plain: float, least: int) -> Column:
    """vector, raster, mixed or empty.  Images that cover the share `scan` of a page make it a raster whatever is drawn on
    it; those that cover less than `plain` don't count, and then `least` objects make it a drawing."""
    drawn = paths + texts
    bare = (images == 0) | (image_cover < plain)
    return F.when((images == 0) & (drawn == 0), "empty").when(image_cover >= scan, "raster").when(~bare, "mixed").when(drawn >= least, "vector").otherwise("empty")


def _entries(name: str, payload: bytes, depth: int, most: int, total: int, ratio: int, deepest: int) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(payload))
        infos = [i for i in archive.infolist() if not i.is_dir()]
    except zipfile.BadZipFile:
        yield name, depth, None, "not an archive"
        return
    if len(infos) > most:
        yield name, depth, None, "too many entries"
        return
    size = 0
    for info in infos:
        path = f"{name}/{info.filename}"
        if info.file_size > total - size or info.file_size > ratio * max(1, info.compress_size):
            yield path, depth, None, "too large"
            continue
        with archive.open(info) as f:
            data = f.read(info.file_size + 1)
        size += len(data)
        if len(data) > info.file_size:
            yield path, depth, None, "larger than declared"
        elif data[:4] == b"PK\x03\x04" and not re.search(r"\.(xlsx|docx)$", path.lower()):
            if depth >= deepest:
                yield path, depth, None, "too deep"
            else:
                yield from _entries(path, data, depth + 1, most, total, ratio, deepest)
        else:
            yield path, depth, data, None


def expand_archives(files: DataFrame, most: int = 2000, total: int = 1 << 30, ratio: int = 200, deepest: int = 3) -> DataFrame:
    """(path, depth, content, problem): the files within archives (columns path and content), those of inner
    archives too.  What exceeds a limit has a problem and no content, so nothing is lost silently."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, payload in zip(batch["path"], batch["content"]):
                for row in _entries(name, payload, 1, most, total, ratio, deepest):
                    yield pd.DataFrame([row], columns=["path", "depth", "content", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, depth int, content binary, problem string")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(payload: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """Number and title of the sheet, row and cells of a workbook."""
    with zipfile.ZipFile(io.BytesIO(payload)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        titles = _titles(book)
        for number, sheet in enumerate(sheets, 1):
            for row in ElementTree.fromstring(book.read(sheet)).iter(f"{{{_NS['m']}}}row"):
                cells: list[str] = []
                for cell in row.findall("m:c", _NS):
                    letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                    column = 0
                    for c in letters:
                        column = column * 26 + ord(c) - 64
                    value = cell.find("m:v", _NS)
                    text = "" if value is None else value.text or ""
                    if cell.get("t") == "s":
                        text = shared[int(text)]
                    elif cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                    cells += [""] * (column - len(cells))
                    cells[column - 1] = text
                yield number, titles.get(sheet, ""), int(row.get("r", "0")), cells


def _titles(book: zipfile.ZipFile) -> dict[str, str]:
    """Titles of sheets by their file."""
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        return {}
    files = {r.get("Id"): r.get("Target", "").removeprefix("/xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    place = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    return {f"xl/{files[s.get(place)]}": s.get("name", "") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet") if s.get(place) in files}


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, title, row, cells) of the workbooks under a path."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, payload in zip(batch["path"], batch["content"]):
                rows = [(name, *row) for row in sheet_rows(payload)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "title", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet int, title string, row int, cells array<string>")


def write_workbook(rows: list[list], path: str, title: str = "Sheet1") -> None:
    """A one-sheet workbook of text cells, for registers of a page or so."""
    from xml.sax.saxutils import escape

    def letters(n: int) -> str:
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(65 + rest) + out
        return out

    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{letters(j)}{i}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for j, v in enumerate(row, 1)) + "</row>" for i, row in enumerate(rows, 1))
    main = _NS["m"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(title, {chr(34): '&quot;'})}" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def header_rows(cells: DataFrame, fields: dict[str, str], *sheet: str) -> DataFrame:
    """The header of each sheet: the row that names the most fields, the first of equals.

    cells: row and cells (an array of strings) beside the sheet's columns; fields: a
    pattern for each field.  Adds named, the number of fields, and header, a map from
    field to column (from 0).  Rows that name fewer than two fields are no headers.
    """
    from pyspark.sql import Window

    places = {name: _first_like("cells", pattern) for name, pattern in fields.items()}
    found = cells.withColumn("header", F.map_filter(F.create_map(*[x for n, p in places.items() for x in (F.lit(n), p)]), lambda k, v: v.isNotNull()))
    found = found.withColumn("named", F.size("header")).filter("named >= 2")
    order = Window.partitionBy(*sheet).orderBy(F.desc("named"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def _first_like(cells: str, pattern: str) -> Column:
    flags = F.transform(F.col(cells), lambda c: F.lower(c).rlike(pattern))
    at = F.array_position(flags, True)
    return F.when(at > 0, at.cast("int") - 1)
