"""Reading by position: labelled values of title blocks, tags of symbols, and lines of quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import text as X
from girder.operators.checkpoints import checkpointed
from girder.operators.lookup import greedy_matches


def labelled_values(spans: DataFrame, sheet: str, fields: dict[str, str], row_gap: float = 2.0, column_gap: float = 5.0, reach: float = 60.0) -> DataFrame:
    """(sheet, field, value): for each field of a title block the value beside its label, else below it.

    spans: sheet, text, x, y (top left, y down).  A label fits its field's pattern; a
    value is the nearest span that is no label, on the label's line to its right or in
    its column beneath it, within reach.  Of several labels the one with the nearest
    value decides; ties go by text.
    """
    field = F.lit(None).cast("string")
    for name, pattern in reversed(list(fields.items())):
        field = F.when(F.lower("text").rlike(pattern), name).otherwise(field)
    marked = spans.withColumn("field", field)
    labels = marked.filter("field IS NOT NULL").select(sheet, "field", F.col("x").alias("lx"), F.col("y").alias("ly"))
    values = marked.filter("field IS NULL").select(sheet, "text", "x", "y")
    right = (F.abs(F.col("y") - F.col("ly")) <= row_gap) & (F.col("x") > F.col("lx"))
    below = (F.abs(F.col("x") - F.col("lx")) <= column_gap) & (F.col("y") > F.col("ly"))
    gap = F.when(right, F.col("x") - F.col("lx")).when(below, reach / 2 + F.col("y") - F.col("ly"))
    near = labels.join(values, sheet).withColumn("gap", gap).filter(F.col("gap") <= reach)
    best = near.groupBy(sheet, "field").agg(F.min(F.struct("gap", "text")).alias("m"))
    return best.select(sheet, "field", F.col("m.text").alias("value"))


def tagged(symbols: DataFrame, spans: DataFrame, sheet: str, pattern: str, reach: float) -> DataFrame:
    """(sheet, a, b, distance): symbols (id, x, y) and the tags (id, text, x, y) that are theirs, one to one by ascending distance."""
    a = symbols.select(sheet, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = spans.filter(F.col("text").rlike(pattern)).select(sheet, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = a.join(b, sheet).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).filter(F.col("distance") <= reach)
    return greedy_matches(near.select(sheet, "a", "b", "distance"), sheet, checkpointed)


def schedule_rows(lines: DataFrame, sheet: str, order: str, cells: str, header: str, tag: str) -> DataFrame:
    """Rows of schedules: lines after a header line up to the first that has no tag in its first cell."""
    w = Window.partitionBy(sheet).orderBy(order)
    first = F.try_element_at(F.col(cells), F.lit(1))
    is_header = F.coalesce(F.lower(first).rlike(header), F.lit(False))
    rows = lines.withColumn("__block", F.count_if(is_header).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__broken", ~is_header & ~F.coalesce(first.rlike(tag), F.lit(False)))
    block = Window.partitionBy(sheet, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__gone", F.max("__broken").over(block))
    return rows.filter((F.col("__block") > 0) & ~is_header & ~F.col("__gone")).drop("__block", "__broken", "__gone")


#: Labels of a quotation's fields.
QUOTATION = {
    "reference": r"(?:quotation|quote|our)\s*(?:no|ref)",
    "date": r"^date",
    "validity": r"valid",
    "currency": r"currency",
    "terms": r"(?:delivery|incoterm)",
}


def quotation_fields(lines: DataFrame, document: str, order: str, cells: str) -> DataFrame:
    """One row a quotation: reference, date, validity in days, currency, terms and exclusions.

    A field's value is the cell after its label, or what follows a colon in the label's
    own cell; the first line that has one decides.  Lines after "Exclusions" up to the
    next heading (a cell that ends with a colon) are exclusions.
    """
    label = F.lower(F.coalesce(F.try_element_at(F.col(cells), F.lit(1)), F.lit("")))
    own = F.nullif(F.trim(F.regexp_extract(F.try_element_at(F.col(cells), F.lit(1)), r":\s*(.+)$", 1)), F.lit(""))
    value = F.coalesce(F.nullif(F.trim(F.try_element_at(F.col(cells), F.lit(2))), F.lit("")), own)
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(label.rlike(r"^exclusions?\b"), "exclusions").when(label.rlike(r":\s*$") | (value.isNotNull() & label.rlike("|".join(QUOTATION.values()))), "other")
    rows = lines.withColumn("__label", label).withColumn("__value", value).withColumn("__heading", heading)
    rows = rows.withColumn("__part", F.last("__heading", ignorenulls=True).over(w))
    first = lambda pattern: F.min(F.when(F.col("__label").rlike(pattern) & F.col("__value").isNotNull(), F.struct(F.col(order).alias("o"), F.col("__value").alias("v"))))["v"]
    excluded = F.when((F.col("__part") == "exclusions") & F.col("__heading").isNull(), F.struct(F.col(order).alias("o"), F.try_element_at(F.col(cells), F.lit(1)).alias("v")))
    found = rows.groupBy(document).agg(*[first(p).alias(n) for n, p in QUOTATION.items()], F.transform(F.array_sort(F.collect_list(excluded)), lambda x: x["v"]).alias("exclusions"))
    days = F.nullif(F.regexp_extract("validity", r"(\d+)\s*days?", 1), F.lit("")).cast("int")
    dated = X.date_in(F.col("date"), "yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy")
    return found.select(document, "reference", dated.alias("date"), days.alias("validity_days"), X.currency_in(F.col("currency")).alias("currency"), F.upper(F.col("terms")).alias("terms"), "exclusions")
