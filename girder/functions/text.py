"""Scalar functions on the text of drawings, specifications and quotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.functions import wording

BLANK = ("not specified", "n/a", "-")


def part(value: Column) -> Column:
    """A part of an item key: single spaces, lower case, and empty where it says nothing."""
    squashed = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))
    return F.when(squashed.isin(*BLANK), "").otherwise(squashed)


def size(value: Column) -> Column:
    """The numbers of a size joined by x: "DN 50 / 25" is 50x25."""
    return F.array_join(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), "x")


def key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def key_part(text: Column, n: int) -> Column:
    """The nth part of a key, empty beyond its last."""
    return F.coalesce(F.try_element_at(F.split(text, r"\|"), F.lit(n)), F.lit(""))


def sentences(text: Column) -> Column:
    """A text cut after a full stop or semicolon that a capital follows."""
    return F.split(text, r"(?<=[.;])\s+(?=\p{Lu})")


def size_range(sentence: Column) -> tuple[Column, Column]:
    """The smallest and the largest size that a sentence names, by its words (see wording.size_limits)."""
    return wording.size_limits(sentence)


def spacing_mm(sentence: Column) -> Column:
    """A spacing in metres or millimetres, as millimetres; under 500 it is none."""
    number = F.regexp_extract(sentence, r"(?i)(\d+(?:\.\d+)?)\s*(mm|m)\b", 1)
    unit = F.lower(F.regexp_extract(sentence, r"(?i)(\d+(?:\.\d+)?)\s*(mm|m)\b", 2))
    value = F.nullif(number, F.lit("")).cast("double") * F.when(unit == "m", 1000).otherwise(1)
    return F.when(value >= 500, F.rint(value).cast("int"))


def money_in(text: Column) -> Column:
    """The first number of a text without its separators, never negative."""
    found = F.nullif(F.regexp_extract(text, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(""))
    return F.regexp_replace(found, ",", "").cast("decimal(14,2)")


#: Currency codes, and signs that stand before a digit.
CURRENCIES = ("SGD", "USD", "EUR", "GBP", "AUD", "JPY")
SIGNS = (("S$", "SGD"), ("US$", "USD"), ("€", "EUR"), ("£", "GBP"))


def currency_in(text: Column) -> Column:
    word = F.nullif(F.regexp_extract(F.upper(text), rf"\b({'|'.join(CURRENCIES)})\b", 1), F.lit(""))
    sign = F.lit(None).cast("string")
    for mark, code in reversed(SIGNS):
        pattern = rf"(?<![A-Z]){''.join('[' + c + ']' for c in mark)}\s*\d"
        sign = F.when(text.rlike(pattern), code).otherwise(sign)
    return F.coalesce(word, sign)


def date_in(text: Column, *formats: str) -> Column:
    """The first of several formats that a text is in."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


#: Nominal sizes in millimetres of sizes in inches.
INCHES = (("1/2", 15), ("3/4", 20), ("1", 25), ("1 1/4", 32), ("1 1/2", 40), ("2", 50), ("2 1/2", 65), ("3", 80), ("4", 100), ("6", 150), ("8", 200), ("10", 250), ("12", 300))


def pipe_size(text: Column) -> Column:
    """The nominal size of a label: DN50, 50 mm, Ø50 or 2"."""
    metric = F.nullif(F.regexp_extract(text, r"(?i)(?:DN|Ø|\bdia\.?)\s*(\d{2,3})\b|\b(\d{2,3})\s*mm\b", 1), F.lit(""))
    other = F.nullif(F.regexp_extract(text, r"(?i)\b(\d{2,3})\s*mm\b", 1), F.lit(""))
    inch = F.regexp_extract(text, r'(?<![\d/])((?:\d+\s+)?\d/\d|\d{1,2})\s*(?:"|inch)', 1)
    by_inch = F.lit(None).cast("int")
    for name, dn in INCHES:
        by_inch = F.when(inch == name, dn).otherwise(by_inch)
    return F.coalesce(metric.cast("int"), other.cast("int"), by_inch)


def revision(label: Column) -> tuple[Column, Column]:
    """Series and number of a revision label: P3, C01, B, 2."""
    clean = F.upper(F.trim(F.regexp_replace(label, r"(?i)^rev(?:ision)?\.?\s*", "")))
    letters, number = F.regexp_extract(clean, r"^([A-Z]*)(\d*)$", 1), F.regexp_extract(clean, r"^([A-Z]*)(\d*)$", 2)
    ordinal = F.aggregate(F.split(letters, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(s * 26 + F.ascii(c) - 64))
    ok = clean.rlike(r"^[A-Z]*\d*$") & (clean != "")
    return F.when(ok, F.when(number == "", "").otherwise(letters)), F.when(ok, F.when(number == "", ordinal).otherwise(F.nullif(number, F.lit("")).cast("int")))


def file_revision(name: Column, number: Column) -> Column:
    """The revision label that a file's name has after its drawing number, if it has one.

    The name falls into runs of letters and digits, and brackets.  Some of the runs, joined, have to be the number: so
    its separators don't matter, and FP-L05-2010 is another drawing than FP-L05-201.  The run after it is judged: up to
    two letters and three digits are a label, one letter alone too, and two alone only in brackets or after REV.
    """
    stem = F.upper(F.regexp_replace(name, r"(?<=.)\.[^./\\]*$", ""))
    runs = F.regexp_extract_all(stem, F.lit(r"[\p{L}\p{N}]+|[(\[]"), F.lit(0))
    wanted = F.regexp_replace(F.upper(number), r"[^\p{L}\p{N}]", "")

    def after(own: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))),
            lambda j: F.exists(F.sequence(F.lit(1), j), lambda i: F.array_join(F.slice(own, i, j - i + 1), "") == wanted),
        )
        return F.when(F.size(ends) > 0, F.slice(own, F.element_at(ends, 1) + 1, F.size(own)))

    def judged(rest: Column) -> Column:
        bracket = F.coalesce(F.get(rest, F.lit(0)).isin("(", "["), F.lit(False))
        first = F.get(rest, F.when(bracket, 1).otherwise(0))
        said_so = first.startswith("REV") & ~F.coalesce(first.rlike("^REV[A-Z]{3,}$") & (first != "REVISION"), F.lit(False))
        bare = F.regexp_replace(first, "^REV(ISION)?", "")
        # REV may stand alone before the label
        label = F.when(said_so & (bare == ""), F.get(rest, F.when(bracket, 2).otherwise(1))).when(said_so, bare).otherwise(first)
        letters, digits = F.length(F.regexp_replace(label, "[^A-Z]", "")), F.length(F.regexp_replace(label, "[^0-9]", ""))
        shaped = (letters + digits == F.length(label)) & (letters <= 2) & (digits <= 3) & label.rlike("^[A-Z]*[0-9]*$")
        return F.when(shaped & ((digits > 0) | (letters == 1) | (letters == 2) & (bracket | said_so)), label)

    return F.when((wanted != "") & name.isNotNull(), wording.let(wording.let(runs, after), judged))


#: How a clause puts a duty: words that bind, what is to be done, and the same as something to be done to an item.
BINDING = ("shall", "must", "will")
DUTIES = ("provide", "supply", "install", "furnish", "fit", "deliver", "include")
DONE = ("provided", "supplied", "installed", "furnished", "fitted", "delivered", "included")
#: Words after which a noun only qualifies another one.
LINKING = ("to", "of", "for", "at", "from", "with", "by", "in", "on", "near", "under", "above", "serving", "feeding")


def requires(sentence: Column, item: str) -> Column:
    """Whether a sentence asks for an item itself, given by its words: as what the sentence is about and shall be
    provided, or as what someone shall provide.  An item after a linking word is named in passing and isn't asked for.
    """
    wanted = F.array(*[F.lit(w) for w in item.lower().split()])
    n = len(item.split())
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}-]*"), F.lit(0))
    among = lambda ws, table: F.exists(ws, lambda w: w.isin(*table))
    first = lambda ws, table: F.array_position(F.transform(ws, lambda w: w.isin(*table)), True).cast("int")

    def asked(ws: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1))), lambda i: F.slice(ws, i, F.lit(n)) == wanted)

        def about(i: Column) -> Column:
            before, after = F.slice(ws, F.lit(1), i - 1), F.slice(ws, i + n, F.lit(6))
            bound = first(after, BINDING)
            return (F.size(before) <= 4) & ~among(before, LINKING + DUTIES) & bound.between(1, 3) & among(F.slice(after, F.greatest(bound, F.lit(1)) + 1, F.lit(3)), DONE)

        def given(i: Column) -> Column:
            # the words before the item, the nearest first
            before = F.reverse(F.slice(ws, F.greatest(i - 8, F.lit(1)), F.least(i - 1, F.lit(8))))
            act = F.greatest(first(before, DUTIES), F.lit(0))
            return (act > 0) & (act <= 5) & ~among(F.slice(before, F.lit(1), F.greatest(act - 1, F.lit(0))), LINKING) & among(F.slice(before, act + 1, F.lit(3)), BINDING)

        return F.exists(places, lambda i: about(i) | given(i))

    return F.when(sentence.isNotNull(), wording.let(words, asked))


#: Titles of views and what they are.
VIEWS = (("section", r"\bsection\b"), ("elevation", r"\belevation\b"), ("detail", r"\bdetail\b"), ("schematic", r"\b(?:schematic|riser diagram)\b"), ("plan", r"\b(?:plan|layout)\b"))


def view_kind(title: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(VIEWS):
        kind = F.when(F.lower(title).rlike(pattern), name).otherwise(kind)
    return kind


def stated_scale(text: Column) -> Column:
    """The denominator of a stated scale; none where the sheet is not to scale."""
    found = F.nullif(F.regexp_extract(text, r"1\s*[:/]\s*(\d{1,5})", 1), F.lit("")).cast("int")
    return F.when(~F.upper(text).rlike(r"\bN\.?T\.?S\b|NOT TO SCALE"), found)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule that a text fits."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def sole_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name that all fitting rules agree on, else none."""
    names = F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules])))
    return F.when(F.size(names) == 1, F.try_element_at(names, F.lit(1)))


def described(template: list[tuple[str, Column]]) -> Column:
    """Parts of a description, of which those with an unknown value are left out."""
    return F.concat_ws(", ", *[F.when(value.isNotNull() & (value != ""), F.format_string(text, value)) for text, value in template])


def scrubbed(fields: Column, allowed: list[str]) -> Column:
    """A map that may be logged: amounts of money (a currency's, or a number with two decimals) are masked under allowed
    keys, and other keys keep only the length of their text."""
    hidden = lambda v: F.when(v.isNotNull(), F.concat(F.lit("[hidden] ("), F.length(v).cast("string"), F.lit(" characters)")))
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*allowed), wording.without_amounts(v)).otherwise(hidden(v)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def cites(clause: Column, value: Column) -> Column:
    """Whether all tokens of a value stand in the clause that is cited for it."""
    return F.size(F.array_except(tokens(value), tokens(clause))) == 0


def working_days(start: Column, end: Column, holidays: list[str]) -> Column:
    """Days after start up to end that are neither weekend nor holiday."""
    days = F.when(end > start, F.sequence(F.date_add(start, 1), end)).otherwise(F.array().cast("array<date>"))
    weekdays = F.filter(days, lambda d: F.weekday(d) < 5)
    return F.size(F.array_except(weekdays, F.array(*[F.lit(h).cast("date") for h in holidays])) if holidays else weekdays)


def word_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences: a row of the table at a time, over what is left without the common ends."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in side], np.int32) for side in (a, b))
    n = min(len(x), len(y))
    same = int(np.argmin(np.append(x[:n] == y[:n], False)))
    x, y = x[same:], y[same:]
    n = min(len(x), len(y))
    same = int(np.argmin(np.append((x[len(x) - n :] == y[len(y) - n :])[::-1], False)))
    x, y = x[: len(x) - same], y[: len(y) - same]
    if len(x) > len(y):
        x, y = y, x
    step = np.arange(len(y) + 1, dtype=np.int64)
    row = step.copy()
    for i, w in enumerate(x, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (y != w)))
        # an insertion takes the least value to the left, and one for each step from there
        row = np.minimum.accumulate(new - step) + step
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def edit_ratio(drafted: pd.Series, issued: pd.Series) -> pd.Series:
    """Levenshtein distance over words by the longer text's words, 0 where both are empty (a null text has no words)."""
    out = []
    for a, b in zip(drafted, issued):
        x, y = (a or "").split(), (b or "").split()
        out.append(word_distance(x, y) / max(len(x), len(y), 1))
    return pd.Series(out, dtype="float64")
