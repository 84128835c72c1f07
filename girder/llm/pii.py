"""Personal data by rules and by bootstrapped contextual extraction.

Rules give the base spans: e-mail addresses, IPv4 addresses, payment cards and
phone numbers.  Those entities are then the seeds of a bootstrap:

1. every identifier-like string of the corpus is an instance, the two words
   before it are a pattern, and the distinct (pattern, instance) pairs are the
   edges of a graph;
2. a pattern's confidence in a kind is the mean score of its instances, if at
   least MIN_SUPPORT distinct ones are known; an instance that no rule knows
   scores 1 - prod(1 - confidence) over its trusted patterns;
3. after ROUNDS rounds, the occurrences of instances that reached ACCEPT, outside
   all base spans, are spans of that kind.

All of it is DataFrame functions.  The texts are scanned once; what remains is a
short row of spans for each document, kept in the checkpoint folder.  Edges are
distinct pairs, so a phrase that a third of the documents share is one edge.

The patterns are the contracted ones, written so that Java's matcher takes linear
time and no stack on long runs: repeats are possessive, and a match starts at a
run's start or where the last match ended.

Cases: a null text is empty; repeated rows get equal spans; rows that share an id
but not the text get their own; an empty table gives no patterns; extra columns
are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.shared import checkpointed, table
from girder.llm.spans import joined, matches, placed, walk

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier: an address, or a number of several digits.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9._%+@-]))(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++|[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++)"
MIN_SUPPORT = 5
TRUST = 0.6
ACCEPT = 0.8
MIN_DIGITS = 6
ROUNDS = 3


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(found)).between(16, 19) & F.call_function("luhn_check", digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def named(kind: str, rank: int):
    return lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content (a hash of the text), base spans, and candidates with their left contexts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"))
    # one cheap look decides whether the other expressions are worth their time
    may = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    numeric = F.col("text").rlike("[0-9]")
    none = F.array().cast("array<string>")
    parts = [F.when(may.get(k, numeric), matches(F.col("text"), p)).otherwise(none).alias(f"m_{k}") for k, p in PATTERNS.items()]
    parts.append(F.when(numeric | may["email"], matches(F.col("text"), CANDIDATE)).otherwise(none).alias("m_cand"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("content"), *parts)
    rows = rows.select(
        "doc_id", "content",
        *[placed(F.col("text"), F.col(f"m_{k}"), p).alias(f"s_{k}") for k, p in PATTERNS.items()],
        placed(F.col("text"), F.col("m_cand"), CANDIDATE).alias("cand"),
        F.when(F.size("m_cand") > 0, F.slice(F.split("text", CANDIDATE, -1), F.lit(1), F.size("m_cand"))).otherwise(none).alias("gaps"),
    )
    base = [F.transform(F.filter(f"s_{k}", _filter(k)), named(k, r)) for r, k in enumerate(KINDS)]
    rows = rows.withColumn("left", F.when(F.size("cand") > 0, lefts(F.col("gaps"), F.col("cand"))).otherwise(none))
    return rows.select("doc_id", "content", F.concat(*base).alias("base"), F.zip_with("cand", "left", lambda c, p: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["found"].alias("found"), p.alias("pattern"))).alias("cand"))


def lefts(gaps: Column, found: Column) -> Column:
    """The two words before each candidate in lower case, whatever they are (other candidates too); empty where there
    are not two.  A walk over the gaps carries the last words on, so that each is read once."""

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc["tail"], F.regexp_replace(x["gap"], r"\s++", " "))
        # quotes and brackets that stand alone before the candidate are no words
        two = F.ltrim(F.substring_index(F.regexp_replace(before, r" [ \"'(]*+$", ""), " ", -2))
        pattern = F.when(F.contains(two, F.lit(" ")), F.lower(two)).otherwise("")
        return F.struct(F.substring_index(F.concat(before, x["found"]), " ", -3).alias("tail"), F.concat(acc["out"], F.array(pattern)).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, c: F.struct(g.alias("gap"), c["found"].alias("found")))
    start = F.struct(F.lit("").alias("tail"), F.coalesce(F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias("out"))
    return walk(pairs, start, step)


def _filter(kind: str):
    return lambda s: _valid(kind, s["found"])


def occurrences(found: DataFrame) -> DataFrame:
    """One row for each candidate: where, its instance and pattern, and the kind that the rules give it (or none).
    Candidates that only overlap a base span are left out."""
    rows = found.filter(F.size("cand") > 0).select("doc_id", "content", "base", F.explode("cand").alias("c"))
    exact = F.filter("base", lambda b: (b["start"] == F.col("c.start")) & (b["stop"] == F.col("c.stop")))
    overlap = F.exists("base", lambda b: (b["start"] < F.col("c.stop")) & (F.col("c.start") < b["stop"]))
    rows = rows.withColumn("kind", F.when(F.size(exact) > 0, F.try_element_at(exact, F.lit(1))["kind"])).filter(F.col("kind").isNotNull() | ~overlap)
    return rows.select("doc_id", "content", F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.lower("c.found").alias("instance"), F.regexp_replace("c.pattern", r"\s+", " ").alias("pattern"), "kind")


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind) of the instances that trusted patterns discover.

    edges: distinct (pattern, instance, kind); kind is null for instances that no rule knows.
    """
    known = edges.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    per = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    unknown = edges.filter("kind IS NULL").select("pattern", "instance")
    pairs = edges.select("pattern", "instance").distinct()
    scores = known
    for _ in range(rounds):
        support = pairs.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= accept).alias("support"))
        trusted = support.join(per, "pattern").withColumn("confidence", F.col("mass") / F.col("n")).filter((F.col("support") >= min_support) & (F.col("confidence") >= trust))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        new = unknown.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        new = new.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
        scores = checkpointed(known.union(new.select("instance", "kind", "score")))
    return scores.join(known.select("instance"), "instance", "left_anti").filter(F.col("score") >= accept).select("instance", "kind")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, base and spans, both array<struct<rank, start, kind, stop>> in order; spans has the discovered ones too."""
    found = checkpointed(scanned(docs, doc_id, text))
    where = occurrences(found)
    edges = checkpointed(where.filter("pattern <> ''").select("pattern", "instance", "kind").distinct())
    new = bootstrap(edges, **options).filter((F.length(digits(F.col("instance"))) >= MIN_DIGITS) | F.contains("instance", F.lit("@")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("k")).cast("int") - 1
    spans = where.filter("kind IS NULL").drop("kind").join(new.withColumnRenamed("kind", "k"), "instance")
    spans = spans.select(F.col("doc_id").alias("d"), F.col("content").alias("t"), F.struct(rank.alias("rank"), "start", F.col("k").alias("kind"), "stop").alias("span"))
    added = spans.groupBy("d", "t").agg(F.collect_set("span").alias("added"))
    both = found.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("t")), "left")
    none = F.array().cast(added.schema["added"].dataType)
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document; a null text has none, and an empty table gives no rows."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
