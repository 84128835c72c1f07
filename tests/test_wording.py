import pytest
from pyspark.sql import functions as F

from girder.functions import wording as W
from girder.operators import documents, drawing, quantity


def told(spark, texts, of):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r.v for r in df.select("i", of(F.col("s")).alias("v")).orderBy("i").collect()]


SIZES = [
    ("Pipes up to and including DN 50 shall be threaded.", None, 50),
    ("pipes of sizes 50 mm and smaller are threaded", None, 50),
    ("DN65 and above: grooved", 65, None),
    ("Sizes not exceeding 100mm", None, 100),
    ("not larger than DN 40", None, None),
    ("larger than DN 40", 40, None),
    ("DN 15 to DN 50 in copper", 15, 50),
    ("from 65 mm to 150 mm", 65, 150),
    ("up to 50 in copper, 65 and above in steel", None, None),
    ("≤ 80", None, 80), ("<= 80", None, 80), (">= DN 100", 100, None), ("≥ 100 mm", 100, None),
    ("Minimum DN 25 for drops", 25, None),
    ("50 mm pipes", None, None), ("see clause 12 and above all", 12, None),
    ("up to 5 mm", None, None), ("", None, None), (None, None, None),
]


def test_size_limits(spark):
    texts = [s for s, _, _ in SIZES]
    low, high = (told(spark, texts, lambda c, k=k: W.size_limits(c)[k]) for k in (0, 1))
    assert list(zip(texts, low, high)) == SIZES


def test_amounts(spark):
    want = {
        "pays S$ 1,200.50 and 7.25 for 12": "pays [amount] and [amount] for 12",
        "US$5 or SGD 6,000 or $ 7": "[amount] or [amount] or [amount]",
        "v1.25 has 3.50m of 2.5 and 10.000": "v1.25 has 3.50m of 2.5 and 10.000",
        "SGD only, $ none": "SGD only, $ none",
        "(12.00)": "([amount])", "": "", "sgd 5": "[amount]",
    }
    assert told(spark, [*want, None], W.without_amounts) == [*want.values(), None]


def test_clause_numbers(spark):
    lines = ["2 Pipes", " 2.1.3.  Joints of steel", "1.2.3.4.5.6 deep", "1.2.3.4.5.6.7 too deep", "1234 a", "2.x y", "2.", "2..1 a", "a 2", "", None, "10\tTab"]
    assert told(spark, lines, lambda c: W.clause_number(c)[0]) == ["2", "2.1.3", "1.2.3.4.5.6"] + [None] * 8 + ["10"]
    assert told(spark, lines[:2], lambda c: W.clause_number(c)[1]) == ["Pipes", "Joints of steel"]


def test_notes(spark):
    notes = [
        "Maximum distance 9 m x 9 m", "OFFICES", "Heads at max. spacing (3.0m × 4.6m).", "Max coverage per head 12 sq m", "max spacing 1 m x 1 m",
        "Store rooms:", "spacing 3 m x 3 m", "max area per sprinkler: 9 m2", "PLANT ROOM", "sprinklers not exceeding 2400 mm by 3000 mm apart", "area: maximum 7.5 sqm for a head",
        "X-1:", "max area per head 8 m",
    ]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(notes)] + [("t", 0, None)], "sheet string, n int, t string")
    got = sorted(map(tuple, drawing.note_criteria(df, "sheet", "n", "t").collect()))
    assert got == [("s", "OFFICES", 4600, 3000, 12.0), ("s", "PLANT ROOM", 3000, 2400, 7.5)]


@pytest.mark.parametrize("n", [30, 800])
def test_bill_letters_beyond_z(spark, n):
    found = spark.range(n).select(F.format_string("%04d", "id").alias("section"), F.lit("x").alias("d"), F.lit(1).alias("q"), F.lit(5).alias("a"))
    got = [r.item for r in quantity.bill_lines(found, "section", ["d"], "q", "a").orderBy("section").collect()]

    def letters(i):
        return letters((i - 1) // 26) + chr(65 + (i - 1) % 26) if i else ""

    assert got == [letters(i) + "1" for i in range(1, n + 1)]


def test_clauses_keep_quantities(spark):
    rows = [(1, "Heading 1", "1 General"), (2, "", "1.1 Scope of works"), (3, "", "20 mm pipes"), (4, "", "7.5 parts"), (5, "", "1.2 Standards")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, n int, style string, t string")
    got = documents.numbered_clauses(df, "doc", "n", "style", "t").orderBy("ordinal").collect()
    assert [(r.number, r.heading, r.text) for r in got] == [("1", "General", ""), ("1.1", "", "Scope of works 20 mm pipes 7.5 parts"), ("1.2", "", "Standards")]


def test_views(spark):
    want = {
        "ENLARGED PUMP ROOM PLAN": ("enlarged plan", None), "Key plan": ("key plan", None), "SECTION A-A": ("section", None), "LEVEL 5 SPRINKLER LAYOUT": ("plan", "5"),
        "10th Storey Plan": ("plan", "10"), "LVL B2 - PLAN": ("plan", "B2"), "Level Roof plan": ("plan", "ROOF"), "Wet riser diagram": ("schematic", None), "TYPICAL DETAILS": ("detail", None),
        "PLANT ROOM": (None, None), "1. The layout is indicative": (None, None), "(2) details": (None, None), "See plan. Pipes are black": (None, None),
        "the schematic layouts, equipment sizes and all other things of the works": (None, None), " ".join(["plan"] * 15): (None, None), "3RD FLOOR ELEVATION": ("elevation", "3"), "": (None, None),
    }
    kinds, levels = (told(spark, [*want, None], lambda c, k=k: W.view_of(c)[k]) for k in (0, 1))
    assert list(zip(kinds, levels)) == [*want.values(), (None, None)]
