"""Documents and records: clauses, validated loads, sections, issues, answers, findings, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions import text as X
from girder.functions import wording


def clauses(lines: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """Clauses of a document: a line that begins with a clause number starts one, other lines go to the last."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    w = Window.partitionBy(document).orderBy(order)
    rows = lines.withColumn("__number", F.nullif(number, F.lit("")))
    rows = rows.withColumn("clause", F.count("__number").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(document, "clause").agg(F.max("__number").alias("number"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def numbered_clauses(paragraphs: DataFrame, document: str, order: str, style: str, text: str) -> DataFrame:
    """(document, ordinal, number, heading, text): clauses of text files, by their numbers and styles.

    A numbered paragraph in a heading style starts a clause.  One in another style does so
    if its number has several parts and an earlier clause is its parent or a sibling (or
    there is none yet), so that quantities ("50 mm pipes") start none.  Other paragraphs go to the
    last clause; those before the first are left out.
    """
    number, rest = wording.clause_number(F.col(text))
    heading = F.coalesce(F.lower(style).startswith("heading"), F.lit(False))
    rows = paragraphs.filter(F.col(text).isNotNull()).select(document, F.col(order).alias("__order"), number.alias("__number"), rest.alias("__rest"), heading.alias("__heading"), F.col(text).alias("__text"))
    column = rows.schema[document].dataType

    def starts(pdf):
        import pandas as pd

        pdf, known, begins = pdf.sort_values("__order", kind="stable"), set(), []
        for n, head in zip(pdf["__number"], pdf["__heading"]):
            parent = n.rpartition(".")[0] if n else ""
            ok = bool(n) and (head or (bool(parent) and (not known or parent in known)))
            if ok:
                # a clause stands for itself and for the parent of its siblings
                known |= {n, parent or n}
            begins.append(ok)
        return pd.DataFrame({document: pdf[document], "__order": pdf["__order"], "__starts": begins})

    # of each paragraph only its number and style go to Python
    marks = rows.select(document, "__order", "__number", "__heading")
    fields = f"`{document}` {column.simpleString()}, __order {rows.schema['__order'].dataType.simpleString()}, __starts boolean"
    found = marks.groupBy(document).applyInPandas(starts, fields)
    w = Window.partitionBy(document).orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.join(found, [document, "__order"]).withColumn("ordinal", F.count_if("__starts").over(w) - 1).filter("ordinal >= 0")
    said = F.when(~F.col("__starts"), F.col("__text")).when(~F.col("__heading"), F.col("__rest"))
    parts = F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct(F.col("__order").alias("o"), said.alias("t")))))
    first = lambda c: F.max(F.when(F.col("__starts"), c))
    return lines.groupBy(document, "ordinal").agg(
        first(F.col("__number")).alias("number"),
        F.coalesce(first(F.when(F.col("__heading"), F.col("__rest"))), F.lit("")).alias("heading"),
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
    )


def validated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with problems, the messages of all checks that fail (a null check fails)."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks.items()]))
    return rows.withColumn("problems", found)


def all_or_nothing(rows: DataFrame) -> DataFrame:
    """Validated rows, or none at all where any has a problem."""
    bad = rows.filter(F.size("problems") > 0).limit(1).count()
    return (rows.limit(0) if bad else rows).drop("problems")


def filled_down(rows: DataFrame, document: str, order: str, heading: Column, name: str = "section") -> DataFrame:
    """rows with the last heading at or before each."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def missing_both_ways(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with which one: required but absent, or present but unmentioned."""
    a, b = required.select(*keys).distinct(), present.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("required")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("present")))


def ranked_issues(issues: DataFrame, key: list[str], severity: str, ranks: list[str], *then: str) -> DataFrame:
    """Distinct issues in order: the most severe first, and then by the given columns."""
    level = F.array_position(F.array(*map(F.lit, ranks)), F.col(severity))
    return issues.dropDuplicates(key).orderBy(level, *then)


def answers(values: DataFrame, keys: list[str], value: str, citation: str) -> DataFrame:
    """The distinct values of each key with all their citations, both in order."""
    return values.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"), F.array_sort(F.collect_set(citation)).alias("citations"))


def classified(scores: DataFrame, document: str, kind: str, confidence: str, margin: float = 0.1, loss: float = 0.2) -> DataFrame:
    """The kind with the highest confidence, lowered where another kind is a close rival; ties by name."""
    w = Window.partitionBy(document).orderBy(F.desc(confidence), kind)
    rows = scores.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(confidence).over(w)).filter("__n = 1")
    close = F.coalesce(F.col(confidence) - F.col("__next") <= margin, F.lit(False))
    return rows.select(document, kind, F.when(close, F.greatest(F.col(confidence) - loss, F.lit(0.0))).otherwise(F.col(confidence)).alias(confidence), close.alias("rivalled"))


def quality_band(dpi: Column, ocr: Column, scale: Column) -> tuple[Column, Column]:
    """high, medium or low, and why it is not high."""
    reasons = F.array_compact(F.array(F.when(dpi < 200, "resolution"), F.when(ocr < 0.8, "text"), F.when(scale != "verified", "scale")))
    worst = (dpi < 120) | (ocr < 0.5)
    return F.when(worst, "low").when(F.size(reasons) > 0, "medium").otherwise("high"), reasons


def ocr_digits(text: Column) -> Column:
    """Letters that stand for digits next to digits: O and I, from either side, however many in a row."""
    out = text
    for wrong, right in (("O", "0"), ("[Il]", "1")):
        out = F.regexp_replace(out, rf"(?<=\d){wrong}", right)
        out = F.regexp_replace(out, rf"{wrong}(?=[OIl]*\d)", right)
    return F.regexp_replace(F.regexp_replace(out, r"(?<=\d)O", "0"), r"(?<=\d)[Il]", "1")


def grouped_candidates(candidates: DataFrame, ident: str, group: str, evidence: str) -> DataFrame:
    """Groups by key; a candidate without one is a group of its own.  Evidence is distinct, in order."""
    key = F.coalesce(F.nullif(F.col(group), F.lit("")), F.concat(F.lit("single:"), F.col(ident).cast("string")))
    return candidates.groupBy(key.alias("group_key")).agg(F.count("*").alias("members"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def first_findings(sentences: DataFrame, clause: str, order: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The first sentence of a clause that fits each rule."""
    rule = F.explode(F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in rules])))
    w = Window.partitionBy(clause, "rule").orderBy(order)
    return sentences.withColumn("rule", rule).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def labour_impact(hours: Column, factor: Column, applied: Column) -> tuple[Column, Column]:
    """Hours that a risk adds, and its state: not computed without hours, already priced where its multiplier is applied."""
    state = F.when(F.coalesce(hours, F.lit(0)) == 0, "not_computed").when(applied, "already_priced").otherwise("computed")
    return F.when(state == "computed", F.round(hours * (factor - 1), 2)).when(state == "already_priced", 0).cast("decimal(14,2)"), state


def manifest(df: DataFrame, ident: str) -> DataFrame:
    """The hash of every record of a frozen snapshot."""
    return df.select(ident, F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("hash"))


def tampered(df: DataFrame, ident: str, frozen: DataFrame) -> DataFrame:
    """Records whose hash differs from the manifest's, or that only one side has."""
    now = manifest(df, ident).withColumnRenamed("hash", "now")
    return frozen.join(now, ident, "full").filter(~F.col("hash").eqNullSafe(F.col("now"))).select(ident)


def adopted(shared: DataFrame, own: DataFrame, key: str, digest: str, base: str) -> DataFrame:
    """What adopting a shared takeoff does to each item: create, keep, keep as it diverged here, or replace."""
    s = shared.select(key, F.col(digest).alias("__s"))
    o = own.select(key, F.col(digest).alias("__o"), F.col(base).alias("__b"))
    action = F.when(F.col("__o").isNull(), "create").when(F.col("__s").isNull(), "own").when(F.col("__s") == F.col("__o"), "keep").when(F.col("__o") != F.col("__b"), "diverged").otherwise("replace")
    return s.join(o, key, "full").select(key, action.alias("action"))


def affected(providers: list, *arguments) -> DataFrame:
    """The items that any of several registered providers names, each once."""
    out = None
    for provide in providers:
        found = provide(*arguments)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


#: What clauses state about pipework: attribute, value, and the words that state it.
ATTRIBUTES = (
    ("material", "black steel", ("black steel", "mild steel")),
    ("material", "galvanised steel", ("galvanised", "galvanized")),
    ("material", "cpvc", ("cpvc", "chlorinated pvc")),
    ("material", "copper", ("copper",)),
    ("joining", "grooved", ("grooved", "groove couplings")),
    ("joining", "threaded", ("threaded", "screwed")),
    ("joining", "welded", ("welded", "butt weld")),
    ("joining", "flanged", ("flanged", "flanges")),
)
#: Where it holds, and sentences on supports, which name pipes only in passing.
PLACES = (("below ground", ("buried", "underground", "below ground")), ("basement", ("basement", "basements")), ("external", ("external", "outdoor", "outdoors")))
SUPPORTS = ("hanger", "hangers", "support", "supports", "bracing", "seismic")
#: Duties of a contractor: category, the words that name it, and the figures that go with it.
OBLIGATIONS = (
    ("testing", r"\btest(?:s|ed|ing)?\b", (("bar", r"(\d+(?:\.\d+)?)\s*bar\b"), ("hours", r"(\d+(?:\.\d+)?)\s*hours?\b"))),
    ("warranty", r"\b(?:warrant|guarantee)", (("years", r"(\d+)\s*years?\b"), ("months", r"(\d+)\s*months?\b"))),
    ("spares", r"\bspares?\b", (("percent", r"(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)"),)),
    ("submittals", r"\b(?:submit|submittal|as-built)", (("copies", r"(\d+)\s*(?:copies|sets)\b"),)),
)
#: Wordings that leave open what has to be done.
VAGUE = ("as required", "or equivalent", "where necessary", "if applicable", "to the satisfaction of", "as directed", "adequate")
#: Systems by the words of a section's heading, and words of other trades.
SYSTEMS = (("sprinkler", ("sprinkler", "sprinklers")), ("hydrant", ("hydrant", "hydrants", "rising main")), ("hose reel", ("hose reel", "hose reels")))
TRADES = ("electrical", "plumbing", "landscape", "lift", "lifts")


def says(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words, or word groups, stands in a text in lower case."""
    return text.rlike(r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b")


def clause_sentences(clauses: DataFrame, clause: str, text: str) -> DataFrame:
    """(clause, n, sentence).  Few bytes of clauses take long to read, so they are dealt to all cores, three portions each.
    Outer explodes, here and below: before others Spark puts a filter, which reads the clause or the sentence once more."""
    clauses = clauses.select(clause, text).repartition(3 * clauses.sparkSession.sparkContext.defaultParallelism)
    return clauses.select(clause, F.posexplode_outer(X.sentences(F.col(text))).alias("n", "sentence")).filter("n IS NOT NULL")


def attributes(clauses: DataFrame, clause: str, text: str) -> DataFrame:
    """(clause, n, attribute, value, dn_min, dn_max, place): what each sentence states, with its range of sizes and its place.
    A sentence on supports states their spacing in millimetres only."""
    rows = clause_sentences(clauses, clause, text)
    low = F.lower("sentence")
    on_supports = says(low, SUPPORTS)
    stated = [F.when(~on_supports & says(low, words), F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value"))) for a, v, words in ATTRIBUTES]
    spacing = X.spacing_mm(F.col("sentence"))
    stated.append(F.when(on_supports & spacing.isNotNull(), F.struct(F.lit("hanger spacing").alias("attribute"), spacing.cast("string").alias("value"))))
    place = F.coalesce(*[F.when(says(low, words), F.lit(name)) for name, words in PLACES])
    least, most = X.size_range(F.col("sentence"))
    # apart from the explode, which would take the names off the limits' fields
    rows = rows.withColumn("dn_min", least).withColumn("dn_max", most)
    rows = rows.select(clause, "n", "dn_min", "dn_max", place.alias("place"), F.explode_outer(F.array_compact(F.array(*stated))).alias("s")).filter("s IS NOT NULL")
    return rows.select(clause, "n", "s.attribute", "s.value", "dn_min", "dn_max", "place")


def obligations(clauses: DataFrame, clause: str, text: str) -> DataFrame:
    """(clause, n, category, unit, figure): duties that sentences put, one row a figure, or one without if they give none."""
    rows = clause_sentences(clauses, clause, text)
    low = F.lower("sentence")
    found = []
    for category, named, figures in OBLIGATIONS:
        of = lambda unit, value, c=category: F.struct(F.lit(c).alias("category"), F.lit(unit).cast("string").alias("unit"), value.cast("double").alias("figure"))
        values = [(u, F.nullif(F.regexp_extract(low, p, 1), F.lit(""))) for u, p in figures]
        given = F.array_compact(F.array(*[F.when(v.isNotNull(), of(u, v)) for u, v in values]))
        found.append(F.when(low.rlike(named), F.when(F.size(given) > 0, given).otherwise(F.array(of(None, F.lit(None))))))
    rows = rows.select(clause, "n", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("o"))
    return rows.select(clause, "n", "o.*")


def vague_phrases(clauses: DataFrame, clause: str, text: str) -> DataFrame:
    """(clause, phrase) of the wordings in clauses that leave open what has to be done."""
    low = F.lower(text)
    return clauses.select(clause, F.explode(F.array_compact(F.array(*[F.when(says(low, (p,)), F.lit(p)) for p in VAGUE]))).alias("phrase"))


def section_systems(clauses: DataFrame, decided: DataFrame, number: str, heading: str) -> DataFrame:
    """(number, system): clauses have the system of their first-level section.  A person's answer (section, system) decides,
    else its heading does: another trade's has none, unless it names a system too."""
    section = F.split(F.col(number), r"\.")[0]
    low = F.lower(heading)
    system = F.coalesce(*[F.when(says(low, words), F.lit(name)) for name, words in SYSTEMS])
    system = F.when(system.isNull() & says(low, TRADES), "other trade").otherwise(system)
    heads = clauses.filter(~F.contains(F.col(number), F.lit("."))).select(section.alias("section"), system.alias("by_heading"))
    own = heads.join(decided.select("section", F.col("system").alias("decided")), "section", "left")
    own = own.select("section", F.coalesce("decided", F.nullif("by_heading", F.lit("other trade"))).alias("system"))
    return clauses.select(number, section.alias("section")).join(own, "section", "left").select(number, "system")
