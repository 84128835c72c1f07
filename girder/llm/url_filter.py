"""URL filtering: host rules, and naive Bayes over segmented host and path words.

A host rule fits a host and its subdomains under a path prefix; the longest
fitting rule decides.  The urls that rules decide are the examples from which a
multinomial naive Bayes learns to decide the others.  Its words come from the
letter runs of hosts and paths, each split into dictionary words by a unigram
Viterbi search ("cheappillsonline" gives three).

The dictionary counts the words that pages write apart: those of whole titles and
the parts of hyphenated names, of two letters or more (single letters would split
anything).  A run that stands alone in a url is what has to
be split, so it does not count.  Dictionary, examples and odds are tables of any
size: the stretches of each distinct run meet the dictionary in a join, its
words then meet their odds, and urls the sums of their runs.  Each distinct run
and url is handled once, however many pages have it.

Cases: a null url, or one without "://", has an empty host and path, fits no rule
and is judged by the prior alone; ties are allowed; a word that no example has
says nothing; repeated rows get equal verdicts; an empty table gives an empty
result; titles and runs of any length are read whole (what one run meets is one
row); columns of pages with the names of results give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.shared import checkpointed, table

#: Verdict, host and path prefix of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An unknown stretch costs as much as a word ten times as rare as the rarest, and this for each of its letters.
PER_LETTER = 3.0
SEND = 1 << 16


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z in lower case) and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as its text and its verdict (null if none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, decides).otherwise(verdict)
    return name, verdict


def runs(text: Column) -> Column:
    """The runs of letters of a text in lower case, and 0 for each run of digits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), lambda r: F.when(r.rlike(r"^\p{N}"), "0").otherwise(r))


def dictionary(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(word, n): the words that titles and hyphenated names of urls write apart, with their counts."""
    apart = F.array_join(F.regexp_extract_all(F.col(url), F.lit(r"\p{L}+(?:[-_+]\p{L}+)+"), F.lit(0)), " ")
    text = apart if html is None else F.concat_ws(" ", F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1), apart)
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def cheapest(run: str, matches: list[tuple[int, int, int]], total: int) -> list[str]:
    """The split of a run with the least cost, given the dictionary words (start, length, count) in it.

    A word costs log(total / count), an unknown stretch log(10 * total) and PER_LETTER a letter.  Of equal costs a
    word comes before an unknown stretch, and the longer word first.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, count in sorted(matches):
        ending.setdefault(start + length, []).append((start, log(total / count)))
    unknown = log(10 * total)
    best, back = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
    # the cheapest way to be inside an unknown stretch, and where that begins
    stretch, begin = float("inf"), 0
    for end in range(1, len(run) + 1):
        if best[end - 1] + unknown < stretch:
            stretch, begin = best[end - 1] + unknown, end - 1
        stretch += PER_LETTER
        cost, at = None, 0
        for start, price in ending.get(end, ()):
            if cost is None or best[start] + price < cost:
                cost, at = best[start] + price, start
        best[end], back[end] = (stretch, begin) if cost is None or stretch < cost else (cost, at)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of the distinct letter runs in column run, by the dictionary (word, n)."""
    names = checkpointed(names.select("run").withColumn("id", F.monotonically_increasing_id()))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    longest = names.agg(F.coalesce(F.max(F.length("run")), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in counts.select(F.length("word")).filter(F.length("word") <= longest).distinct().collect())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, words = [], [], []

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(words, pa.string())], names=["id", "start", "word"])

        for batch in batches:
            for i, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start in range(len(run)):
                    for length in lengths:
                        if start + length > len(run):
                            break
                        ids.append(i)
                        starts.append(start)
                        words.append(run[start : start + length])
                    if len(ids) >= SEND:
                        yield send()
                        ids, starts, words = [], [], []
        if ids:
            yield send()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [cheapest(r, [(m["start"], m["length"], m["n"]) for m in f or ()], total) for r, f in zip(runs_, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    met = names.select("id", "run").mapInArrow(stretches, "id long, start int, word string").join(counts, "word")
    found = met.groupBy("id").agg(F.collect_list(F.struct("start", F.length("word").alias("length"), "n")).alias("found"))
    return names.join(found, "id", "left").select("run", "found").mapInArrow(split, "run string, words array<string>")


def judge(pages: DataFrame, url: str = "url", html: str | None = "html", rules=RULES) -> DataFrame:
    """pages (without html) with host, path, rule, verdict and block_odds, the method's log odds."""
    name, decided = rule_of(rules)
    given = pages.select(*[c for c in pages.columns if c != html and c not in ("host", "path", "rule", "verdict", "block_odds")])
    split = parts(given, url).withColumn("rule", name).withColumn("verdict", decided)
    # each url once, with the number of its pages
    urls = checkpointed(split.groupBy("host", "path", "verdict").agg(F.count("*").alias("pages")).withColumn("u", F.monotonically_increasing_id()))

    def of(kind: str, name: str) -> Column:
        return F.transform(runs(F.col(name)), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("run")))

    tokens = urls.select("u", "verdict", "pages", F.explode(F.concat(of("h", "host"), of("p", "path"))).alias("t")).select("u", "verdict", "pages", "t.*")
    side = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)).alias(v)
    by_run = checkpointed(tokens.groupBy("kind", "run").agg(side("allow"), side("block")))
    words = segmented(by_run.filter("run <> '0'").select("run").distinct(), checkpointed(dictionary(pages, url, html)))
    by_run = checkpointed(by_run.join(words, "run", "left").withColumn("words", F.coalesce("words", F.array("run"))))
    # the model: counts of each word, and the odds that they give
    each = by_run.select("kind", "run", "allow", "block", F.explode("words").alias("word"))
    counts = checkpointed(each.groupBy("kind", "word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    seen = counts.filter(F.col("allow") + F.col("block") > 0)
    size, allow, block = seen.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    allowed, blocked = urls.agg(*[F.coalesce(side(v), F.lit(0)) for v in ("allow", "block")]).first()
    prior = log((blocked + 1) / (allowed + 1))
    odds = seen.select("kind", "word", (F.log((F.col("block") + 1) / (block + size)) - F.log((F.col("allow") + 1) / (allow + size))).alias("odds"))
    by_run = each.join(odds, ["kind", "word"]).groupBy("kind", "run").agg(F.sum("odds").alias("odds"))
    scored = tokens.select("u", "kind", "run").join(by_run, ["kind", "run"]).groupBy("u").agg(F.sum("odds").alias("odds"))
    scored = urls.join(scored, "u", "left").select("host", "path", F.round(prior + F.coalesce("odds", F.lit(0.0)), 9).alias("block_odds"))
    out = split.join(scored, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow")))
    return out.select(*given.columns, "host", "path", "rule", "verdict", "block_odds")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; null urls are judged by the prior, and an empty table gives no rows."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_odds")
