"""Secret scanning with an incremental ledger of blobs.

Every version of every path is a blob, named by the SHA-256 of its content.  The
ledger is a table of the (blob, rule version) pairs that were scanned and what
they hold; a run scans only pairs that it lacks, one copy of each blob, appends
them, and joins the findings back to all paths whose content is that blob.  The
rule version is a hash of the rules, so other rules never meet old findings.  All
of it is DataFrame functions: copies are found by hash with a partial aggregate,
so a blob that a third of the paths share costs one scan and no large group.

A look for a rule's fixed part ("AKIA", "eyJ" ..) decides whether its expression
is worth running.

Cases: a null text is an empty blob; repeated rows are paths of their own with
the same findings; null paths are kept; an empty history gives empty findings; a
text of any length is scanned whole; extra columns pass through, and an output
name that is taken gets a leading underscore.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.shared import checkpoint_folder, fresh, table
from girder.llm.spans import joined, matches, placed, walk

#: Kinds, their patterns and the tests that a match must pass.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of hexadecimal digits passes with 24 of them; shorter runs never pass, so they are not matched.
HEX = r"[0-9a-f]{24,}"
#: Kinds beside the three: private key headers, signed web tokens, tokens of hosting services.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
HOST = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9]+-[A-Za-z0-9-]{10,}"
BASE = ("assign", "access", "hex")
RULES: dict[str, str] = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "pem": PEM, "jwt": JWT, "host": HOST}
#: Least lengths of what counts: the value of an assignment, a whole access key.
LEAST = {"assign": 6, "access": 20}
#: What a text holds, in lower case, if it holds a match at all.
SIGNS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "pem": ("-----begin",), "jwt": ("eyj",), "host": ("gh", "xox")}
LEDGER = "blob string, rule_version string, found array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def version_of(rules: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([list(rules.items()), LEAST]).encode()).hexdigest()[:16]


def _passes(kind: str) -> Column | None:
    def secret(s: Column) -> Column:
        return F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= LEAST["assign"]

    return {"assign": secret, "access": lambda s: F.length(s["found"]) >= LEAST["access"]}.get(kind)


def _worth(kind: str, pattern: str, lowered: Column) -> Column:
    """Whether a text can have a match; rules of one's own are always run."""
    out = F.lit(False)
    for sign in SIGNS.get(kind, ()):
        out = out | F.contains(lowered, F.lit(sign))
    return out if kind in SIGNS and RULES.get(kind) == pattern else F.lit(True)


def named_span(kind: str, rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))


def found_in(blobs: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """blobs with `found`, array<struct<start, rank, kind, stop>> in order, instead of the text."""
    rules = rules or RULES
    keep = [c for c in blobs.columns if c != text]
    none = F.array().cast("array<string>")
    staged = blobs.select(*keep, text, F.lower(text).alias("__lower"))
    staged = staged.select(*keep, text, *[F.when(_worth(k, p, F.col("__lower")), matches(F.col(text), p)).otherwise(none).alias(f"__m_{k}") for k, p in rules.items()])
    staged = staged.select(*keep, *[placed(F.col(text), F.col(f"__m_{k}"), p).alias(f"__s_{k}") for k, p in rules.items()])
    lists = []
    for rank, kind in enumerate(rules):
        spans = F.col(f"__s_{kind}")
        if test := _passes(kind):
            spans = F.filter(spans, test)
        lists.append(F.transform(spans, named_span(kind, rank)))
    return staged.select(*keep, F.array_sort(F.concat(*lists)).alias("found"))


#: The session's setting that names the folder of a kept ledger; queries and the pipeline read it too.
LEDGER_SETTING = "spark.girder.secrets.ledger"


def open_ledger(spark: SparkSession, folder: str | None = None) -> tuple[str, DataFrame]:
    """The ledger's folder, made if it is not there, and its rows.  Without a folder it is the one that the session's
    setting LEDGER_SETTING names, and without that a new one beside the checkpoints, so that the run scans all blobs."""
    folder = folder or spark.conf.get(LEDGER_SETTING, None) or f"{checkpoint_folder(spark)}/secrets-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)
    return folder, spark.read.schema(LEDGER).parquet(folder)


def scan_unseen(history: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rules: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, new): paths has path and blob of every row; new is the ledger's addition,
    (blob, rule_version, found) of each pair that the ledger lacks."""
    version = version_of(rules or RULES)
    named = history.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("blob", F.sha2("text", 256))
    paths = named.select("path", "blob")
    # one path of each blob that is still to be scanned; where ids repeat, equal rows are scanned alike
    todo = paths.groupBy("blob").agg(F.min("path").alias("path"))
    todo = todo.join(ledger.filter(F.col("rule_version") == version), "blob", "left_anti")
    todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"))
    copies = named.join(todo, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    new = found_in(copies.select("blob", "text"), "text", rules).dropDuplicates(["blob"])
    return paths, new.select("blob", F.lit(version).alias("rule_version"), "found")


def scanned(history: DataFrame, folder: str | None = None, path: str = "doc_id", text: str = "text", rules: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, hits) after the ledger in folder has got all pairs that it lacked; hits has blob and found of the blobs
    with any finding."""
    spark = history.sparkSession
    folder, ledger = open_ledger(spark, folder)
    paths, new = scan_unseen(history, ledger, path, text, rules)
    new.write.mode("append").parquet(folder)
    ledger = spark.read.schema(LEDGER).parquet(folder)
    # two runs at once may both have scanned a blob
    hits = ledger.filter((F.col("rule_version") == version_of(rules or RULES)) & (F.size("found") > 0)).groupBy("blob").agg(F.first("found").alias("found"))
    return paths, hits


def findings_by_path(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """path, blob and found (empty where nothing was found) of every row of paths."""
    none = F.array().cast(hits.schema["found"].dataType)
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", none))


def redact(docs: DataFrame, path: str = "doc_id", text: str = "text", mark: str = "[SECRET]", ledger: str | None = None) -> DataFrame:
    """docs with every secret in text replaced by a mark; a text without any is left as it is."""
    row, found = fresh(docs, "row", "found")
    # one key for id and content, so that texts move once
    content = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    key = F.concat_ws(":", F.col(path).cast("string"), content)
    paths, hits = scanned(docs, ledger, path, text)
    # findings go to the paths first, which are small, and with these to the texts
    own = paths.join(hits.withColumnRenamed("found", found), "blob").select(F.concat_ws(":", F.col("path").cast("string"), "blob").alias(row), found).dropDuplicates([row])
    out = docs.withColumn(row, key).join(own, row, "left")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        piece = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    none = F.coalesce(F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    pieces = walk(F.col(found), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), cut)
    end = F.array_max(F.transform(found, lambda s: s["stop"]))
    whole = F.concat(F.array_join(pieces, ""), F.substring(F.col(text), (end + 1).cast("int"), F.length(text)))
    return out.withColumn(text, F.when(F.col(found).isNotNull(), whole).otherwise(F.col(text))).select(*docs.columns)


def op5_secret_scan(spark, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Counts, digest and spans of every document (a null text has none; an empty table gives no rows).  ledger is the
    folder of a kept ledger, whose blobs are not scanned again; without one the session's setting counts (open_ledger)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings_by_path(*scanned(docs, ledger))

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col("path").alias("doc_id"), *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql(kind: str, pattern: str, test: str, rank: int) -> str:
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, found, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS stop
FROM (SELECT row, doc_id, i, m[i] AS found, g[i] AS gap FROM
  (SELECT *, unnest(generate_series(1, len(m))) AS i FROM
    (SELECT row, doc_id, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS g FROM d)))
QUALIFY {test}"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
OP5_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), s AS ("
    + "\nUNION ALL ".join([
        "SELECT * FROM (" + _sql("assign", f"'{_ASSIGN_SQL}'", f"length(regexp_extract(found, '{_ASSIGN_SQL}', 2)) >= 6", 0) + ")",
        "SELECT * FROM (" + _sql("access", f"'{ACCESS}'", "length(found) >= 20", 1) + ")",
        "SELECT * FROM (" + _sql("hex", f"'{HEX}'", "true", 2) + ")",
        "SELECT * FROM (" + _sql("pem", f"'{PEM}'", "true", 3) + ")",
        "SELECT * FROM (" + _sql("jwt", f"'{JWT}'", "true", 4) + ")",
        "SELECT * FROM (" + _sql("host", f"'{HOST}'", "true", 5) + ")",
    ])
    + """),
t AS (SELECT doc_id, kind, rank, stop - length(found) AS start, kind || ':' || (stop - length(found)) || ':' || stop AS span FROM s),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM t GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)"""
)
