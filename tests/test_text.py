import datetime

from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first().o


def many(spark, cases, column):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string").select("i", column(F.col("v")).alias("o")).orderBy("i").collect()
    assert [r.o for r in rows] == [w for _, w in cases]


def test_parts_and_sizes(spark):
    many(spark, [("  Black  STEEL ", "black steel"), ("Not specified", ""), (None, ""), ("n/a", "")], X.part)
    many(spark, [("DN 50 / 25", "50x25"), ("none", ""), (None, ""), ("2.5 in", "2.5")], X.size)
    many(spark, [("a|b|c", "c"), ("a", ""), (None, "")], lambda c: X.key_part(c, 3))


def test_pipe_sizes(spark):
    many(spark, [("DN50", 50), ("Ø 65 pipe", 65), ("100 mm", 100), ('2" pipe', 50), ('1 1/2"', 40), ("pipe", None), (None, None)], X.pipe_size)


def test_ranges_and_spacings(spark):
    many(spark, [("pipes up to DN 50 threaded", 50), ("DN 65 and above grooved", None), ("none", None)], lambda c: X.size_range(c)[1])
    many(spark, [("DN 65 and above grooved", 65), ("up to 50 and DN65 and above", None)], lambda c: X.size_range(c)[0])
    many(spark, [("at 3.5 m centres", 3500), ("every 2400 mm", 2400), ("gap of 20 mm", None), ("x", None)], X.spacing_mm)


def test_money_dates_currency(spark):
    many(spark, [("S$ 1,234.50 only", "1234.50"), ("-5", "5.00"), ("none", None)], lambda c: X.money_in(c).cast("string"))
    many(spark, [("SGD 5", "SGD"), ("US$5", "USD"), ("S$ 5", "SGD"), ("€5", "EUR"), ("5", None)], X.currency_in)
    many(spark, [("2024-03-05", datetime.date(2024, 3, 5)), ("05/03/2024", datetime.date(2024, 3, 5)), ("5th", None)], lambda c: X.date_in(c, "yyyy-MM-dd", "dd/MM/yyyy"))


def test_revisions_views_scales(spark):
    many(spark, [("Rev P3", "P"), ("B", ""), ("2", ""), ("?", None)], lambda c: X.revision(c)[0])
    many(spark, [("Rev P3", 3), ("B", 2), ("AA", 27), ("02", 2), ("?", None)], lambda c: X.revision(c)[1])
    many(spark, [("Level 5 PLAN", "plan"), ("Section A-A", "section"), ("Riser diagram", "schematic"), ("x", None)], X.view_kind)
    many(spark, [("SCALE 1:100", 100), ("N.T.S. 1:50", None), ("1 / 50", 50), ("", None)], X.stated_scale)


def test_citations_and_scrubbing(spark):
    many(spark, [("Pipes shall be black steel", True), ("copper", False), (None, False)], lambda c: X.cites(c, F.lit("Black steel")))
    got = spark.sql("SELECT map('note', 'pays $1,200.50 now', 'secret', 'x') AS m").select(X.scrubbed(F.col("m"), ["note"]).alias("m")).first().m
    assert got == {"note": "pays [amount] now", "secret": "[hidden] (1 characters)"}
    many(spark, [("7.25 of 12 and v1.25.3", "[amount] of 12 and v1.25.3"), ("SGD 5 and S$6", "[amount] and [amount]")], lambda c: X.scrubbed(F.create_map(F.lit("a"), c), ["a"])["a"])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab cd e".split()), max_size=8), st.lists(st.sampled_from("ab cd f".split()), max_size=8)), min_size=1, max_size=20))
def test_edit_ratio(spark, pairs):
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", X.edit_ratio(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got):
        assert abs(r.r - (distance(a, b) / max(len(a), len(b)) if a or b else 0.0)) < 1e-12


def test_edit_ratio_of_long_texts(spark):
    words = [f"w{i}" for i in range(40_000)]
    assert X.word_distance(words, words[:100] + ["x"] + words[101:]) == 1
    assert X.word_distance(words[:3000], words[3000:6000]) == 3000
    assert X.word_distance(words, []) == 40_000
    changed = [w if i % 50 else f"y{i}" for i, w in enumerate(words[:10_000])]
    df = spark.createDataFrame([(1, " ".join(words[:10_000]), " ".join(changed)), (2, None, None), (3, None, "a b")], "i int, a string, b string")
    assert [r.r for r in df.select("i", X.edit_ratio("a", "b").alias("r")).orderBy("i").collect()] == [0.02, 0.0, 1.0]
