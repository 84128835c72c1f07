"""The corpus pipeline: five stages, each of which works on all that the one before has kept.

language_id     keeps documents in a language that the labelled ones teach, and notes the language found in lang
near_duplicates keeps the first document of each component of texts with a five-word Jaccard similarity of 0.8
decontaminate   drops documents that hold a benchmark passage
secrets         puts a mark in place of every secret in the texts
encode          gives the piece ids of each text, and the text that they decode to

Each function takes the session, the documents and the folder of the tables; all
but the last return the columns of documents, and columns that they don't use
pass through.  All take an empty table and give one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import decontam, langid, pieces, secret_scan, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1.  Rejects texts without letters (null and empty ones) and long texts that are like no learned
    language; lang becomes the language found, whatever the source says.  Repeated rows stay repeated."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  One document of each group stays, that with the smallest id (null ids last); wordless texts are one
    group, and of repeated rows one stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7.  Drops documents with any benchmark window; texts without words hold none and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.scan(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), benchmark, text="in_text").filter(F.size("hit_items") == 0)
    return found.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5.  Every row stays, secrets in its text replaced by [SECRET] and n_chars counted anew; a null text
    stays null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8.  Every row with piece_ids and decoded; a null or empty text has the begin and end ids alone."""
    return pieces.encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: The stages hold models and iterations that SQL can't express; tests/llm compares them with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
