"""Office files and mails as rows: paragraphs of texts, lines of quotations, openings, and sheets with named columns."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.documents import validated
from girder.sources.files import sheet_rows

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraphs(payload: bytes) -> Iterator[tuple[int, str, str]]:
    """Place, name of the style and text of the paragraphs that are not blank; tables are passed over."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = "" if name is None else name.get(f"{_W}val", "")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for i, p in enumerate(body.findall(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        text = " ".join("".join(n.text or "" if n.tag == f"{_W}t" else " " for n in p.iter() if n.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).split())
        if text:
            yield i, "" if style is None else names.get(style.get(f"{_W}val"), ""), text


def _mail_lines(payload: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """Part, sheet, row and cells: the headers, the lines of the plain body, the rows of attached workbooks."""
    mail = email.message_from_bytes(payload, policy=email.policy.default)
    for row, name in enumerate(("From", "Subject", "Date"), 1):
        if mail[name]:
            yield "headers", 0, row, [f"{name}:", str(mail[name])]
    body = mail.get_body(preferencelist=("plain",))
    for row, line in enumerate(str(body.get_content()).splitlines() if body is not None else [], 1):
        # cells typed into a mail stand apart by tabs, bars or three blanks
        cells = [c for c in (x.strip() for x in re.split(r"[\t|]" if re.search(r"[\t|]", line) else r"\s{3,}", line.strip())) if c]
        if cells:
            yield "body", 0, row, cells
    for part in mail.iter_attachments():
        content = part.get_payload(decode=True)
        if isinstance(content, bytes) and _is_workbook(content):
            for sheet, _, row, cells in sheet_rows(content):
                if any(cells):
                    yield part.get_filename() or "attachment", sheet, row, cells


def _is_workbook(payload: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as z:
            return "xl/workbook.xml" in z.namelist()
    except zipfile.BadZipFile:
        return False


def _quotation_lines(payload: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    if _is_workbook(payload):
        return (("document", sheet, row, cells) for sheet, _, row, cells in sheet_rows(payload) if any(cells))
    return _mail_lines(payload)


def _per_file(spark: SparkSession, path: str, read: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """path, the columns of read's rows, and problem.  A file that can't be read is one row that says so."""
    columns = ["path", *[c.split()[0] for c in schema.split(", ")], "problem"]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, payload in zip(batch["path"], batch["content"]):
                try:
                    rows = [(name, *row, None) for row in read(payload)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeError, LookupError) as e:
                    rows = [(name, *[None] * (len(columns) - 2), f"unreadable: {type(e).__name__}")]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}, problem string")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph, style, text, problem) of the text files (DOCX) under a path."""
    return _per_file(spark, path, _paragraphs, "paragraph int, style string, text string")


def read_quotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, sheet, row, cells, problem): lines of cells of the workbooks and mails under a path, as
    `quotation_fields` takes them."""
    return _per_file(spark, path, _quotation_lines, "part string, sheet int, row int, cells array<string>")


def openings(paragraphs: DataFrame, lines: int = 300, characters: int = 8000) -> DataFrame:
    """(path, text): the first paragraphs of each file, to classify it by; the two limits are the feature."""
    first = paragraphs.filter((F.col("paragraph") < lines) & F.col("problem").isNull())
    parts = F.array_sort(F.collect_list(F.struct("paragraph", "text")))
    return first.groupBy("path").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, characters).alias("text"))


def named_columns(cells: DataFrame, title: str, columns: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the sheets of a title, by the names in their first row, with every problem that they have.

    cells: path, title, row, cells.  columns: the kind of each column: text, date (ISO)
    or price (above zero).  A column that the sheet lacks is null and, unless optional, a
    problem of each row; so is a blank.  Blank rows are passed over.
    """
    sheet = cells.filter(F.col("title") == title)
    heads = sheet.filter("row = 1").select("path", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("head"))
    rows = sheet.filter("row > 1").filter(F.exists("cells", lambda c: F.trim(c) != "")).join(heads, "path", "left")
    raw = {n: F.nullif(F.trim(F.try_element_at("cells", F.nullif(F.array_position("head", n).cast("int"), F.lit(0)))), F.lit("")) for n in columns}
    typed, checks = {}, {}
    for name, kind in columns.items():
        if kind == "date":
            typed[name] = F.try_to_timestamp(F.substring(raw[name], 1, 10), F.lit("yyyy-MM-dd")).cast("date")
        elif kind == "price":
            number = F.regexp_replace(raw[name], ",", "").try_cast("decimal(14,4)")
            typed[name] = F.when(number > 0, number)
        else:
            typed[name] = raw[name]
        message = {"date": "not a date", "price": "not a price above zero"}.get(kind, "blank")
        fine = typed[name].isNotNull()
        checks[f"{name}: {message}"] = fine | raw[name].isNull() if name in optional else fine
    return validated(rows, checks).select("path", "row", *[c.alias(n) for n, c in typed.items()], "problems")


#: Sheets of an ERP export and their columns, and those that may be blank.
ERP_SHEETS = {
    "Items": {"code": "text", "description": "text", "unit": "text", "item_key": "text"},
    "PurchaseOrders": {"po_number": "text", "date": "date", "item_key": "text", "description": "text", "unit": "text", "unit_price_sgd": "price", "supplier": "text"},
    "HistoricalCosts": {"project": "text", "date": "date", "item_key": "text", "unit": "text", "unit_price_sgd": "price"},
}
ERP_OPTIONAL = {"Items": ("item_key",), "PurchaseOrders": ("description", "supplier"), "HistoricalCosts": ()}


def erp_sheet(cells: DataFrame, title: str) -> DataFrame:
    """Rows of one sheet of ERP exports."""
    return named_columns(cells, title, ERP_SHEETS[title], ERP_OPTIONAL[title])


def past_prices(cells: DataFrame) -> DataFrame:
    """Sound prices of purchase orders and of past projects, of which the rate library takes its history."""
    parts = []
    for title, kind, reference in (("PurchaseOrders", "purchase_order", "po_number"), ("HistoricalCosts", "project", "project")):
        rows = erp_sheet(cells, title).filter(F.size("problems") == 0)
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(reference).alias("reference"), F.col("date").alias("on"), "item_key", "unit", F.col("unit_price_sgd").alias("unit_price")))
    return parts[0].unionByName(parts[1])
