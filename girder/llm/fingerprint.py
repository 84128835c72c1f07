"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases whose borders depend on a few symbols around them
and not on their place, by deterministic coin tossing:

1. a run of one symbol becomes one symbol, so neighbours differ;
2. each symbol gets the label 2 * i + b, where i is the lowest bit in which it
   differs from its left neighbour and b is its own bit there; three such rounds
   leave labels below 8, still different between neighbours;
3. phrases begin at the labels' local maxima, which stand 2 to 15 symbols apart,
   and a phrase's name is a hash of its symbols.

The names are the next level's symbols, up to a level with one phrase.  Equal
substrings so have equal phrases at every level, but for a few at their ends.
The fingerprint is a sketch of the names: each of its 64 slots holds the smallest
hash of those names that fall to it; 8 slots serve the first level (phrases of
about 3 characters), 16 the second and 40 all higher ones, so texts of any length
have something to compare.  The likeness of two fingerprints is the share of
equal slots among those that either one fills.

Cases: null and empty texts have an empty sketch, like each other and unlike any
other; equal texts have equal fingerprints; a text of any length is parsed
whole; an empty table gives no rows; an output name that is taken gets a leading
underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.flat import U64, span_hashes
from girder.llm.pieces import text_groups
from girder.llm.shared import fresh, partitions, table, whole_ids

SLOTS = ((0, 8), (8, 16), (24, 40))
WIDTH = 64
EMPTY = np.uint32(0xFFFFFFFF)
ROUNDS = 3
SLICE_CHARS = 1 << 19
RANGES = 32
#: Quantiles of the ids between which ranges are evenly wide.
COARSE = 512
NULL_ID = -(1 << 63)


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of labels; first are the indices of the documents' first symbols."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = x[first] ^ x.dtype.type(1)
    low = x ^ before
    low &= -low if low.dtype == np.uint8 else (~low + low.dtype.type(1))
    bit = (x & low) != 0
    return (np.bitwise_count(low - low.dtype.type(1)) << np.uint8(1)) | bit


def level(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of sequences (values[bound[d] : bound[d + 1]], none empty), and the names' bounds."""
    first = np.zeros(len(values), bool)
    first[bound[:-1]] = True
    # a run of one symbol becomes one; its length goes into the name
    head = first.copy()
    head[1:] |= values[1:] != values[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(values)))
    x = values[at]
    start = first[at]
    index = np.flatnonzero(start)
    label = toss(x, index)
    for _ in range(ROUNDS - 1):
        label = toss(label, index)
    border = start.copy()
    border[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # what follows a document's last symbol is another document
    border[index[1:] - 1] = start[index[1:] - 1]
    with np.errstate(over="ignore"):
        x = x + (size.astype(U64) - U64(1)) * U64(0x9FB21C651E98DF25)
    begin = np.flatnonzero(border)
    end = np.append(begin[1:], len(x))
    return span_hashes(x, begin, end), np.searchsorted(begin, np.append(index, len(x)))


def sketches(texts: list[str]) -> np.ndarray:
    """A row of WIDTH 32-bit slots for each text."""
    out = np.full((len(texts), WIDTH), EMPTY, np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.flatnonzero(sizes)
    values, bound = codes.astype(U64), np.concatenate([[0], np.cumsum(sizes[doc])])
    flat, depth = out.reshape(-1), 0
    while len(doc):
        values, bound = level(values, bound)
        base, width = SLOTS[min(depth, len(SLOTS) - 1)]
        owner = np.repeat(doc, np.diff(bound))
        slot = owner * WIDTH + base + ((values >> U64(40)) % U64(width)).astype(np.int64)
        np.minimum.at(flat, slot, ((values >> U64(4)).astype(np.uint32)) & np.uint32(0xFFFFFFFE))
        more = np.diff(bound) > 1
        keep = np.repeat(more, np.diff(bound))
        sizes = np.diff(bound)[more]
        values, doc, bound = values[keep], doc[more], np.concatenate([[0], np.cumsum(sizes)])
        depth += 1
    return out


def encoded(rows: np.ndarray) -> list[str]:
    """Four hexadecimal digits a slot; an empty slot is 0000."""
    with np.errstate(over="ignore"):
        short = ((rows * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    short = np.where(rows == EMPTY, 0, np.maximum(short, 1)).astype(">u2")
    return [r.tobytes().hex() for r in short]


def likeness(a: str, b: str) -> float:
    """Equal slots of two fingerprints over the slots that either fills (1 if neither fills any)."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    filled = (x != 0) | (y != 0)
    return float(((x == y) & filled).sum() / filled.sum())


def fingerprints(texts: list[str]) -> list[str]:
    out: list[str] = []
    for lo, hi in text_groups(texts, SLICE_CHARS):
        out.extend(encoded(sketches(texts[lo:hi])))
    return out


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the fingerprint of their text."""
    (name,) = fresh(docs, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_utf8()).fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(texts), pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many characters of the following one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(docs: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Borders of so many id ranges, and the range where each range's largest id is also
    needed: the one before it, by descending ids."""
    ids = docs.select("doc")
    # a few quantiles of the ids, whose summary on the driver has a fixed size, and even steps between them
    coarse = min(parts, COARSE)
    shares = [i / coarse for i in range(coarse + 1)] if parts > 1 else []
    ends = sorted({int(c) for c in ids.approxQuantile("doc", shares, 0.2 / coarse)} if shares else [])
    steps = -(-parts // coarse)
    inner = {lo + (hi - lo) * k // steps for lo, hi in zip(ends, ends[1:]) for k in range(steps)}
    cuts = np.array(sorted(inner - set(ends[:1])), np.int64)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            doc = batch.column(0).to_numpy()
            part = range_of(doc, cuts)
            for p in np.unique(part):
                best[int(p)] = max(best.get(int(p), NULL_ID), int(doc[part == p].max()))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(best), pa.int64()), "head": pa.array(list(best.values()), pa.int64())})

    rows = ids.mapInArrow(heads, "part long, head long").groupBy("part").agg(F.max("head").alias("head")).collect()
    filled = sorted(r.part for r in rows)
    before = dict(zip(filled, filled[-1:] + filled[:-1]))
    return cuts, {r.head: before[r.part] for r in rows}


def range_of(doc: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of each id, counted from the largest ids down."""
    return len(cuts) - np.searchsorted(cuts, doc, "right")


def with_following(docs: DataFrame) -> DataFrame:
    """(part, guest, doc, n, fp, packed, tie): the documents dealt by ranges of ids, where each range
    also gets, as a guest, the first document of the range after it (the last one that of the first)."""
    spark = docs.sparkSession
    # several ranges a partition even out what the hash of ranges deals to each
    cuts, guests = _cuts(docs, RANGES * partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            doc = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.large_utf8()).to_pylist()
            prints = fingerprints(texts)
            raw = [t.encode() for t in texts]
            also = np.array([i for i, d in enumerate(doc) if int(d) in guests], np.int64)
            rows = np.concatenate([np.arange(len(doc)), also])
            part = np.concatenate([range_of(doc, cuts), [guests[int(doc[i])] for i in also]]).astype(np.int64)
            packed = [pack.compress(r) for r in raw]
            tie = [hashlib.sha256(r).digest()[:8] for r in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part), pa.array(np.arange(len(rows)) >= len(doc)), pa.array(doc[rows]),
                    pa.array([len(texts[i]) for i in rows], pa.int64()), pa.array([prints[i] for i in rows], pa.string()),
                    pa.array([packed[i] for i in rows], pa.binary()), pa.array([tie[i] for i in rows], pa.binary()),
                ],
                names=["part", "guest", "doc", "n", "fp", "packed", "tie"],
            )

    dealt = docs.mapInArrow(run, "part long, guest boolean, doc long, n long, fp string, packed binary, tie binary").repartition(partitions(spark), "part")
    return dealt.sortWithinPartitions("part", "guest", F.desc("doc"), "tie")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ready: list[tuple] = []
    size = 0

    def send() -> pa.RecordBatch:
        prints = fingerprints([r[3] for r in ready])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), pa.array([hashlib.sha256(r[3].encode()).hexdigest() for r in ready]),
                pa.array([r[2] for r in ready]), pa.array(prints), pa.array([likeness(r[2], p) for r, p in zip(ready, prints)], pa.float64()), pa.array([likeness(r[2], r[4]) for r in ready], pa.float64()),
            ],
            names=names,
        )

    last = None
    for batch in batches:
        for lo in range(0, len(batch), 500):
            for part, guest, doc, n, fp, packed, _ in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                text = unpack.decompress(packed).decode()
                if last is not None and last[0] == part:
                    ready.append((last[1], last[2], last[3], edited(last[4], text), fp))
                    size += last[2]
                # after a guest nothing is compared
                last = None if guest else (part, doc, n, fp, text)
                if size >= SLICE_CHARS or len(ready) >= 5000:
                    yield send()
                    ready, size = [], 0
    if ready:
        yield send()


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness; a null text is empty, and rows with one id
    stand in the order of a hash of their texts; ids that are no whole numbers raise a TypeError."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.coalesce(whole_ids(docs, "doc_id"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = with_following(docs).mapInArrow(_compare, schema)
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), *out.columns[1:])
