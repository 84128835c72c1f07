"""Limits, values and amounts in sentences, read word by word.

A sentence becomes an array of words, figures and signs; what a figure means follows
from the words next to it, which stand in the tables below.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a size that make it the largest or the smallest, and words behind it.
LARGEST_BEFORE = ("up to", "up to and including", "to and including", "not exceeding", "not above", "not more than", "no more than", "below", "under", "smaller than", "less than", "max", "maximum", "≤", "< =")
SMALLEST_BEFORE = ("at least", "not less than", "not under", "larger than", "greater than", "more than", "min", "minimum", "≥", "> =")
LARGEST_BEHIND = ("and smaller", "and below", "and under", "and less", "or smaller", "or less")
SMALLEST_BEHIND = ("and above", "and larger", "and over", "and up", "or larger", "or above")
#: Words that negate what follows: "not larger than 50" is no smallest size.
NEGATIONS = ("not", "no")
#: What a design note calls the distance of heads, the area of one, and a limit.
SPACING_WORDS, AREA_WORDS = ("spacing", "spacings", "centres", "apart", "distance"), ("area", "coverage")
HEAD_WORDS, LIMIT_WORDS = ("sprinkler", "sprinklers", "head", "heads"), ("max", "maximum", "limit", "most", "exceed", "exceeding")
#: What views are called, by words of their titles that stand together; the first that fits counts.
VIEWS = (
    ("enlarged plan", ("enlarged", "plan")), ("key plan", ("key plan",)), ("section", ("section",)), ("elevation", ("elevation",)),
    ("schematic", ("schematic",)), ("schematic", ("riser diagram",)), ("detail", ("detail",)), ("detail", ("details",)), ("plan", ("plan",)), ("plan", ("layout",)),
)
#: Words beside a level's number, and endings of ordinals.
LEVEL_BEFORE, LEVEL_BEHIND, ORDINALS = ("level", "lvl", "storey"), ("storey", "floor", "level"), ("st", "nd", "rd", "th")
#: Words that a title has at most, with a comma and without.
TITLE_WORDS, TITLE_WORDS_WITH_COMMA = 14, 8
#: Marks of a currency before an amount.
MONEY_MARKS = ("$", "sgd")


def let(value: Column, of) -> Column:
    """of(value), with the value computed once."""
    return F.transform(F.array(value), of)[0]


def tokens(text: Column) -> Column:
    """Words, figures and signs of a text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|\d+(?:\.\d+)?|[^\s\p{L}\d]"), F.lit(0))


def _one_of(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + ")"


def size_limits(sentence: Column) -> tuple[Column, Column]:
    """The smallest and the largest size that a sentence states.  Of a limit in each direction neither is sure, unless they
    are the ends of one range ("DN 15 to DN 50")."""
    # the words with a space around each; a size may have its mark before it and its unit behind
    line = F.concat(F.lit(" "), F.array_join(tokens(sentence), " "), F.lit(" "))
    size, mark, unit = r"(\d{2,4})(?= )", "(?:(?:dn|ø) )?", "(?: mm)?"
    negated = "".join(f"(?<! {n})" for n in NEGATIONS)

    def stated(before: tuple[str, ...], behind: tuple[str, ...], guard: str = "") -> Column:
        pattern = f"{guard} {_one_of(before)} {mark}{size}| {mark}{size}{unit} {_one_of(behind)} "
        return F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, g), F.lit("")).cast("int") for g in (1, 2)])

    largest, smallest = stated(LARGEST_BEFORE, LARGEST_BEHIND), stated(SMALLEST_BEFORE, SMALLEST_BEHIND, negated)
    ends = [F.nullif(F.regexp_extract(line, f" {size}{unit} (?:to|-|–) {mark}{size}", g), F.lit("")).cast("int") for g in (1, 2)]
    is_range = largest.isNull() & smallest.isNull() & (ends[0] < ends[1])
    low = F.when(is_range, ends[0]).when(largest.isNull(), smallest)
    return low, F.when(is_range, ends[1]).when(smallest.isNull(), largest)


def _values(ws: Column) -> Column:
    """Figures with a unit of length or area behind them: array<struct<value (m or m2), area>>."""

    def unit(i: Column) -> Column:
        """Metres of the unit behind the figure at i, and whether it is squared."""
        u, after = F.get(ws, i), F.get(ws, i + 1)
        squared = u.isin("sqm", "m²") | ((u == "m") & after.isin("2", "²")) | ((u == "sq") & (after == "m"))
        length = F.when(u == "mm", 0.001).when(u.isin("m", "metre", "metres"), 1.0)
        return F.struct(F.when(squared, 1.0).otherwise(length).alias("metres"), F.coalesce(squared, F.lit(False)).alias("area"))

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1))), lambda i: F.coalesce(F.get(ws, i - 1), F.lit("")).rlike(r"^\d"))
    found = F.transform(places, lambda i: F.struct((F.get(ws, i - 1).cast("double") * unit(i)["metres"]).alias("value"), unit(i)["area"].alias("area")))
    return F.filter(found, lambda v: v["value"].isNotNull())


def _any(ws: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(ws, F.array(*[F.lit(w) for w in words]))


def note_values(line: Column) -> Column:
    """struct<a, b, area> of a design note's line: the two greatest distances of heads, and the greatest area of a head, as
    far as the line states them.  An area may be given in plain metres, as its words say what it is."""

    def of(ws: Column) -> Column:
        def read(values: Column) -> Column:
            limited = _any(ws, LIMIT_WORDS)
            lengths = F.filter(values, lambda v: ~v["area"])
            spacing = limited & _any(ws, SPACING_WORDS) & (F.size(lengths) >= 2)
            area = limited & _any(ws, AREA_WORDS) & _any(ws, HEAD_WORDS)
            side = lambda k: F.when(spacing, F.get(lengths, F.lit(k))["value"])
            return F.struct(side(0).alias("a"), side(1).alias("b"), F.when(area, F.get(values, F.lit(0))["value"]).alias("area"))

        return let(_values(ws), read)

    return let(tokens(line), of)


def is_title(text: Column) -> Column:
    """Whether a line can be a view's title: a phrase, and no sentence or numbered note that has a title's word in it."""
    plain = F.trim(text)
    n = F.size(F.split(plain, r"\s+"))
    # a full stop or semicolon with more words behind it; a number with a stop or bracket at the start
    runs_on = plain.rlike(r"[.;]\s+\p{L}")
    first = F.translate(F.get(F.split(plain, r"\s+"), F.lit(0)), "(", "")
    numbered = (n > 1) & F.substring(first, -1, 1).isin(".", ")") & F.length(first).between(2, 3) & F.left(first, F.length(first) - 1).try_cast("int").isNotNull()
    return ~runs_on & ~numbered & (n <= F.when(F.contains(plain, F.lit(",")), TITLE_WORDS_WITH_COMMA).otherwise(TITLE_WORDS))


def view_of(title: Column) -> tuple[Column, Column]:
    """The kind of view that a title names, and its level; null for lines that are no titles."""
    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"\p{L}+\d*|\d+"), F.lit(0)), " "), F.lit(" "))
    kind = F.lit(None).cast("string")
    for name, words in reversed(VIEWS):
        has = F.lit(True)
        for w in words:
            has &= F.contains(line, F.lit(f" {w} "))
        kind = F.when(has, name).otherwise(kind)
    number = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    named = number(rf" (?:{'|'.join(LEVEL_BEFORE)}) (\d{{1,2}}|b\d|roof) ")
    ordinal = number(rf" (\d{{1,2}}) (?:{'|'.join(ORDINALS)}) (?:{'|'.join(LEVEL_BEHIND)}) ")
    ok = is_title(title)
    return F.when(ok, kind), F.when(ok & kind.isNotNull(), F.upper(F.coalesce(named, ordinal)))


def is_heading(line: Column) -> Column:
    """Whether a line is a title: it ends with a colon or is all in capitals, and has a word of four letters or more."""
    plain = F.trim(line)
    return plain.rlike(r"\p{L}{4}") & (plain.endswith(":") | (F.upper(plain) == plain))


def clause_number(line: Column) -> tuple[Column, Column]:
    """The clause number that a line begins with, and the rest of it; null if it begins with none.  A number has up to six
    parts of up to three digits, and text behind it."""
    halves = F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+", 2)
    first, rest = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
    number = F.when(first.endswith("."), F.left(first, F.length(first) - 1)).otherwise(first)
    parts = F.split(number, r"\.")
    short = F.forall(parts, lambda p: F.length(p).between(1, 3) & (F.translate(p, "0123456789", "") == ""))
    ok = (F.size(parts) <= 6) & short & (F.length(F.coalesce(rest, F.lit(""))) > 0)
    return F.when(ok, number), F.when(ok, rest)


def without_amounts(text: Column) -> Column:
    """A text with [amount] in place of every amount of money: a figure behind a currency's mark, or one with cents."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s+|\p{L}+|\d[\d,]*(?:\.\d+)?|[^\s\p{L}\d]"), F.lit(0))

    def masked(ps: Column) -> Column:
        at = lambda i: F.coalesce(F.get(ps, i), F.lit(""))
        blank = lambda i: at(i).rlike(r"^\s$")
        is_figure = lambda i: at(i).rlike(r"^\d")
        is_mark = lambda i: F.lower(at(i)).isin(*MONEY_MARKS)
        marked = lambda i: is_figure(i) & (is_mark(i - 1) | (blank(i - 1) & is_mark(i - 2)))
        cents = lambda i: at(i).rlike(r"\.\d\d$") & ~at(i - 1).rlike(r"[\p{L}._]$") & ~at(i + 1).rlike(r"^[\p{L}_]")
        # the mark of a marked figure, the letters of a dollar's country, and the blank between
        goes = lambda i: is_mark(i) & (marked(i + 1) | (blank(i + 1) & marked(i + 2)))
        country = lambda i: F.upper(at(i)).isin("S", "US") & (at(i + 1) == "$") & goes(i + 1)
        gap = lambda i: blank(i) & goes(i - 1)
        return F.array_join(F.transform(ps, lambda p, i: F.when(marked(i) | (is_figure(i) & cents(i)), "[amount]").when(goes(i) | country(i) | gap(i), "").otherwise(p)), "")

    return F.when(text.isNotNull(), let(pieces, masked))
