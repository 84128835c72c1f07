"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from the letter's code
alone.  A letter trigram is the product of its letters' vectors, rotated by
their place in it; a document is the sum of its trigrams' vectors, a language
the sum of its documents'.  A document gets the language whose prototype has the
largest cosine with it.  Prototypes and documents are centred on the mean of the
unit prototypes, as all languages that share an alphabet have much in common.

The prototypes are fitted on a sample of the labelled rows of about PER_LANG
documents a language at most (chosen by a hash of the id, so every part of the
table counts); documents are then predicted in one pass without a shuffle.

Cases: a null text, or one without letters, is `und` with score 0, as is any
text if no language could be learned; rows without a label, or without an id,
teach nothing; a text of any length is read whole; ties go to the language that
sorts first; repeated rows get equal predictions; an empty table teaches nothing
and gives no rows; an output name that is taken gets a leading underscore.  More
than LABELS labels are an error, as prototypes go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.flat import U64, mix
from girder.llm.pieces import text_groups
from girder.llm.shared import fresh, table

DIMENSIONS = 1024
PER_LANG = 4000
UNDETERMINED = "und"
#: Trigrams whose vectors are held at once.
COLUMNS = 4096
LABELS = 10_000
#: A text is in none of the languages if it is no nearer to any than a random vector's standard deviation (1 / 32);
#: this is asked only of texts of JUDGED characters or more, as few trigrams have too much chance in them.
LEAST = 0.5 + 0.5 / 32
JUDGED = 200


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code; 0 stands for the gap between words."""
    lanes = np.arange(DIMENSIONS // 64, dtype=U64)
    with np.errstate(over="ignore"):
        bits = mix(mix(codes.astype(U64) + U64(1))[:, None] + lanes[None, :] * U64(0x9E3779B97F4A7C15))
    return 1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8)


def document_vectors(texts: list[str]) -> np.ndarray:
    """The sum of the trigram vectors of each text; texts without letters have zero."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    joined = "".join(f" {t} " for t in (x.lower() for x in texts))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    sym = np.where(letters()[codes], codes, 0)
    first = np.zeros(len(sym), bool)
    first[np.cumsum(sizes) - sizes] = True
    keep = (sym != 0) | first
    keep[1:] |= sym[:-1] != 0
    sym, doc = sym[keep], doc[keep]
    if len(sym) < 3:
        return out
    present = np.zeros(0x110000, bool)
    present[sym] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    s, a = place[sym], len(alphabet)
    gram = (s[:-2] * a + s[1:-1]) * a + s[2:]
    inside = (doc[2:] == doc[:-2]) & ~((sym[:-2] == 0) & (sym[2:] == 0) & (sym[1:-1] == 0))
    gram, owner = gram[inside], doc[2:][inside]
    if a**3 <= 1 << 22:
        seen = np.zeros(a**3, bool)
        seen[gram] = True
        distinct = np.flatnonzero(seen)
        index = np.zeros(a**3, np.int64)
        index[distinct] = np.arange(len(distinct))
        column = index[gram]
    else:
        distinct, column = np.unique(gram, return_inverse=True)
    base = letter_vectors(alphabet)
    rolled = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for lo in range(0, len(distinct), COLUMNS):
        g = distinct[lo : lo + COLUMNS]
        vectors = rolled[1][g // (a * a)] * rolled[0][g // a % a] * base[g % a]
        if len(distinct) > COLUMNS:
            own = (column >= lo) & (column < lo + COLUMNS)
            at = owner[own].astype(np.int64) * len(g) + column[own] - lo
        else:
            at = owner.astype(np.int64) * len(g) + column
        counts = np.bincount(at, minlength=len(texts) * len(g)).reshape(len(texts), len(g))
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_utf8()).fill_null("").to_pylist()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = PER_LANG) -> dict[str, np.ndarray]:
    """The prototype of each language, from about per_lang of its documents at most."""
    known = labelled.filter(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().limit(LABELS + 1).collect()}
    if len(counts) > LABELS:
        raise ValueError(f"{lang} has more than {LABELS} values")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_lang / n))])
    chosen = F.pmod(F.xxhash64(F.col(doc_id), F.lit("langid")), F.lit(1 << 24)) < share[F.col(lang)] * (1 << 24)
    sample = known.filter(chosen).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = _texts(batch, "text"), batch.column(0).to_pylist()
            for lo, hi in text_groups(texts):
                vectors = document_vectors(texts[lo:hi]).astype(np.int64)
                own = np.array(langs[lo:hi], object)
                for name in set(langs[lo:hi]):
                    sums[name] = sums.get(name, 0) + vectors[own == name].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})

    def add(part: pa.Table) -> pa.Table:
        total = np.stack(part.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)).sum(axis=0)
        return pa.table({"lang": part.column("lang").slice(0, 1), "vector": pa.array([total.tolist()], pa.list_(pa.int64()))})

    schema = "lang string, vector array<long>"
    rows = sample.mapInArrow(bundle, schema).groupBy("lang").applyInArrow(add, schema).collect()
    return {r.lang: np.array(r.vector, np.float64) for r in sorted(rows, key=lambda r: r.lang) if any(r.vector)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, (1 + cosine) / 2 of the language's prototype and the document."""
    pred_name, score_name = fresh(docs, "lang_pred", "score")
    names = list(prototypes)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    unit = np.stack([p / np.linalg.norm(p) for p in prototypes.values()]) if names else np.zeros((0, DIMENSIONS))
    centre = unit.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    axes = unit - centre
    axes = axes / np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, text)
            for lo, hi in text_groups(texts):
                vectors = document_vectors(texts[lo:hi]).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                # a text with letters can't be told from its vector's being zero alone
                lettered = size > 0 if names else np.zeros(hi - lo, bool)
                v = vectors / np.maximum(size, 1e-12)[:, None] - centre
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                cos = v @ axes.T if names else np.zeros((hi - lo, 1))
                best = cos.argmax(axis=1)
                score = np.where(lettered, np.clip((1 + cos[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
                pred = [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*part.schema.names, pred_name, score_name])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang: str = "lang", languages: list[str] | None = None, least: float = LEAST, judged: int = JUDGED) -> DataFrame:
    """The documents in one of the languages (all learned ones), with the language that was found in lang.

    Rejected are texts without letters (null and empty ones too), texts in another language than those asked for, and
    texts of `judged` characters or more with a score below `least`, which are in no language that was learned.  If
    no language was learned, nothing is rejected.  An empty table gives an empty one; other columns pass through.
    """
    if not prototypes:
        return docs
    pred, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, prototypes, text).filter((F.col(pred) != UNDETERMINED) & ((F.col(score) >= least) | (F.length(text) < judged)))
    if languages is not None:
        found = found.filter(F.col(pred).isin(languages))
    return found.select(*[F.col(pred).alias(c) if c == lang else c for c in docs.columns])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language and score of every document (`und` and 0 for null, empty or letterless texts); none for an empty table."""
    docs = table(spark, sf_dir, "documents")
    prototypes = fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    found = predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
