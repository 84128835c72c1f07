"""Exact substring deduplication by seed and extend.

A window is WINDOW consecutive words; each word is removed that lies in a window
whose words also start earlier (in a document with a smaller id, or earlier in
the same one).  What is removed are the maximal repeats of WINDOW words or more,
but for their first occurrence.

Seeds.  Every window has an anchor, the SEED-word gram with the smallest hash in
it (winnowing).  Equal windows have equal anchors in equal places, so only
occurrences of one anchor need to be compared.  Consecutive windows with one
anchor form a run, which is the anchor with its context to both sides; there are
about 2 / (WINDOW - SEED + 2) runs a word.

Join.  Runs meet by anchor.  Where a run's whole context also stands in a
document with a smaller id, all its windows repeat, however many copies there
are: each group needs only its smallest id.

Extend.  What is left are the first runs of each context of an anchor with
several contexts.  Each is widened to both sides as far as its anchor reaches: all
windows around the anchor get hashes of their own and meet the others by them;
again only the smallest id of each window counts.  Windows that repeat and adjoin
are one repeat, so maximal ones come out whole.

No step makes pairs, so a passage that a third of the documents share costs as
much as any other text.  Before each shuffle a task drops all but the smallest
id of equal runs or windows of its own and notes the others as repeats: a hot
group sends one row a task and not one a document.  An anchor that a task sends
with more than HOT contexts is dealt by its contexts and not as one group; a row
that stands for it tells the group that there are several.  Texts travel
compressed.

Sequences are compared by two independent 64-bit hashes of their words.

Cases: null, empty and blank texts have no words; texts of fewer words than a
window are kept; rows with equal ids are judged each by itself, neither being
earlier than the other; rows with a null id stand before all others, on the same
terms; ids that are no whole numbers raise a TypeError; a text of any length is one unit;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.flat import BYTE_VALUES, NOT_SPACE, SEQ_BASE, U64, covered, mix, ragged, span_hashes, text_slices, window_hashes, words
from girder.llm.shared import checkpointed, partitions, table, whole_ids

WINDOW = 20
SEED = 6
#: Runs or windows that a task holds to drop its own repeats; more are sent in several portions.
PORTION = 400_000
NULL_ID = -(1 << 63)
#: Contexts of one anchor that a task sends to the anchor's own group.
HOT = 16
#: The second hash of words and sequences.
OTHER = U64(0xB5297A4D3F84D5A7)


def other_hash(values: np.ndarray) -> np.ndarray:
    """A second value of each word for the second hash of sequences; it depends on all bits of the first."""
    with np.errstate(over="ignore"):
        return mix(values * OTHER + U64(0x68E31DA4C2B2AE35))



OTHER_VALUES = other_hash(BYTE_VALUES)


def leftmost_minimum(h: np.ndarray, span: int) -> np.ndarray:
    """The index of the smallest of h[i : i + span], the first of equals, for each i."""
    at = np.arange(len(h))
    width = 1
    while width * 2 <= span:
        a, b = at[: len(at) - width], at[width:]
        at = np.where(h[a] <= h[b], a, b)
        width *= 2
    if width < span:
        rest = span - width
        a, b = at[: len(at) - rest], at[rest:]
        at = np.where(h[a] <= h[b], a, b)
    return at


class Slice:
    """The words of some documents and their windows' anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
        self.data, self.window = data, window
        self.starts, self.ends, self.bound = words(data, offsets, NOT_SPACE)
        self.hashes = span_hashes(BYTE_VALUES[data], self.starts, self.ends)
        # words by bytes valued otherwise, so that words with one first hash still differ
        self.others = span_hashes(OTHER_VALUES[data], self.starts, self.ends, OTHER)
        self.count = np.diff(self.bound)
        n = len(self.hashes) - window + 1
        if n > 0:
            self.doc_of = np.repeat(np.arange(len(self.count)), self.count)
            self.whole = np.flatnonzero(self.doc_of[:n] == self.doc_of[window - 1 :])
        else:
            self.doc_of, self.whole = np.repeat(np.arange(len(self.count)), self.count), np.zeros(0, np.int64)
        self.seed = seed

    def runs(self) -> tuple[np.ndarray, ...]:
        """(document, first window, windows, anchor, context, context by the second hash) of each run of windows with one
        anchor."""
        if not len(self.whole):
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(U64), none.view(U64), none.view(U64)
        grams = window_hashes(self.hashes, self.seed)
        anchor = leftmost_minimum(grams, self.window - self.seed + 1)[self.whole]
        doc = self.doc_of[self.whole]
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(anchor)))
        begin, place = self.whole[at], anchor[at]
        context = span_hashes(self.hashes, begin, begin + size + self.window - 1, SEQ_BASE)
        second = span_hashes(self.others, begin, begin + size + self.window - 1, OTHER)
        with np.errstate(over="ignore"):
            context = mix(context + (place - begin).astype(U64) * U64(0xE7037ED1A0B428DB))
        return doc[at], begin - self.bound[doc[at]], size, grams[place], context, second

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each window."""
        return window_hashes(self.hashes, self.window), window_hashes(self.others, self.window, OTHER)

    def repeats_within(self) -> np.ndarray:
        """The windows (as word numbers of the slice) that also start earlier in their own document."""
        if not len(self.whole):
            return self.whole
        h, second = (x[self.whole] for x in self.windows())
        with np.errstate(over="ignore"):
            key = mix(h + self.doc_of[self.whole].astype(U64) * U64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if (second[order[1:]] != second[order[:-1]])[same].any():
            order = np.lexsort([second, key])
            same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:]] = same & (second[order[1:]] == second[order[:-1]])
        return self.whole[again]


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows, and what tells rows with one id apart."""
    return batch.column("doc").to_numpy(), batch.column("tie").to_numpy()


def first_of_task(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to send on, those with the smallest document of equal keys; and rows that repeat a smaller document's."""
    order = np.lexsort([start, tie, doc, *keys[::-1]])
    if not len(order):
        return order, order
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    new = np.concatenate([[True], ~same])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    least = doc[order][lead]
    later = doc[order] > least
    # of one row's own occurrences the first is enough: the others repeat it anyway
    other = np.concatenate([[True], (tie[order[1:]] != tie[order[:-1]]) | ~same])
    return order[~later & other], order[later]


Rows = tuple[np.ndarray, ...]
PLACE = ("doc", "tie", "start", "n")


def _portions(batches: Iterator[pa.RecordBatch], rows_of: Callable[[pa.RecordBatch], Iterator[Rows]], anchored: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, ..., doc, tie, start, n, part, dropped) of a task: without its own repeats, and those repeats as dropped
    ones, whose keys only spread them.  Both come from one pass, so that nothing is dropped that is not noted.

    part is 0, but for rows whose first key (an anchor) the task sends very often; such a key also gets a row without
    windows in part 0, whose other keys are those of no other row.
    """

    def send(held: list[Rows]) -> Iterator[pa.RecordBatch]:
        *keys, doc, tie, start, n = (np.concatenate(c) for c in zip(*held))
        send_on, again = first_of_task(keys, doc, tie, start)
        if len(again):
            place = _merged(doc[again], tie[again], start[again], n[again])
            spread = mix(place[0].view(U64) ^ mix(place[2].astype(U64)))
            yield rows_with([spread] * len(keys), place, np.zeros(len(spread), np.int64), True)
        if len(send_on):
            keys, place = [k[send_on] for k in keys], (doc[send_on], tie[send_on], start[send_on], n[send_on])
            part = np.zeros(len(send_on), np.int64)
            if anchored:
                anchors, of, count = np.unique(keys[0], return_inverse=True, return_counts=True)
                part = np.where((count > HOT)[of], keys[1].view(np.int64) | 1, 0)
                hot = anchors[count > HOT]
                if len(hot):
                    none = np.zeros(len(hot), np.int64)
                    yield rows_with([hot, *[none.view(U64)] * (len(keys) - 1)], (none, none, none, none), none, False)
            yield rows_with(keys, place, part, False)

    def rows_with(keys: list[np.ndarray], place: Rows, part: np.ndarray, dropped: bool) -> pa.RecordBatch:
        doc, tie, start, n = place
        columns = [*[pa.array(k.view(np.int64)) for k in keys], pa.array(doc), pa.array(tie), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(part), pa.array(np.full(len(doc), dropped))]
        return pa.RecordBatch.from_arrays(columns, names=[*[f"k{i}" for i in range(len(keys))], *PLACE, "part", "dropped"])

    held, size = [], 0
    for batch in batches:
        for rows in rows_of(batch):
            held.append(rows)
            size += len(rows[0])
            if size >= PORTION:
                yield from send(held)
                held, size = [], 0
    if held:
        yield from send(held)


def _merged(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> Rows:
    """Intervals of windows, adjoining ones of a document in one row."""
    order = np.lexsort([start, tie, doc])
    doc, tie, start, stop = doc[order], tie[order], start[order], (start + n)[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > stop[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], tie[at], start[at], stop[last] - start[at]


def _runs(window: int, seed: int):
    def rows_of(batch: pa.RecordBatch) -> Iterator[Rows]:
        ids, ties = ids_of(batch)
        for lo, _, data, offsets in text_slices(batch, "text"):
            doc, start, size, anchor, context, second = Slice(data, offsets, window, seed).runs()
            yield anchor, context, second, ids[lo + doc], ties[lo + doc], start, size

    return lambda batches: _portions(batches, rows_of, anchored=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and compressed texts."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array([pack.compress(t.as_buffer()) for t in texts], pa.binary())], names=["doc", "tie", "packed"])


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    unpack = zstandard.ZstdDecompressor()
    texts = pa.array([unpack.decompress(x.as_buffer()) for x in batch.column("packed")], pa.large_binary()).cast(pa.large_utf8())
    return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), texts, batch.column("at")], names=["doc", "tie", "text", "at"])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Texts unpacked a few at a time."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield _unpacked(batch.slice(lo, rows))


def _intervals(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of the slice, start, n) of the intervals in the column at."""
    at = batch.column("at").slice(lo, hi - lo)
    size = np.diff(at.offsets.to_numpy())
    flat = at.flatten()
    return np.repeat(np.arange(hi - lo), size), flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def _windows(window: int, seed: int):
    """The windows of the runs that are to be extended."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[Rows]:
        ids, ties = ids_of(batch)
        for lo, hi, data, offsets in text_slices(batch, "text"):
            s = Slice(data, offsets, window, seed)
            doc, start, n = _intervals(batch, lo, hi)
            at = np.repeat(doc, n)
            start = ragged(start, n)
            h, second = (x[s.bound[at] + start] for x in s.windows())
            yield h, second, ids[lo + at], ties[lo + at], start, np.ones(len(start), np.int64)

    return lambda batches: _portions(_small(batches), rows_of)


def _removed(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            for lo, hi, data, offsets in text_slices(batch, "text"):
                s = Slice(data, offsets, window, seed)
                doc, start, n = _intervals(batch, lo, hi)
                begin = s.bound[doc] + start
                own = s.repeats_within()
                gone = covered(np.concatenate([begin, own]), np.concatenate([begin + n + window - 1, own + window]), len(s.hashes))
                raw = data.tobytes()
                kept = np.flatnonzero(~gone)
                edge = np.searchsorted(kept, s.bound)
                a, b = s.starts[kept].tolist(), s.ends[kept].tolist()
                texts = [" ".encode().join([raw[x:y] for x, y in zip(a[i:j], b[i:j])]) for i, j in zip(edge[:-1], edge[1:])]
                n_kept = np.diff(edge)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array(s.count, pa.int64()), pa.array(s.count - n_kept, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc", "n_words", "n_removed", "kept"],
                )

    return run


PLACED = "doc long, tie long, start int, n int"


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document."""
    parts = partitions(docs.sparkSession)
    plain = docs.select(F.coalesce(whole_ids(docs, doc_id), F.lit(NULL_ID)).alias("doc"), F.col(text).cast("string").alias("text"))
    # where ids repeat, a hash of the text tells their rows apart; else nothing has to be sent for that
    repeated_ids = plain.groupBy("doc").count().filter("count > 1").limit(1).count() > 0
    plain = plain.select("doc", (F.xxhash64("text") if repeated_ids else F.lit(0).cast("long")).alias("tie"), "text")
    # seeds: runs that meet by anchor
    runs = plain.mapInArrow(_runs(window, seed), f"k0 long, k1 long, k2 long, {PLACED}, part long, dropped boolean")
    by_anchor = Window.partitionBy("k0", "part", "dropped")
    differ = (F.min("k1").over(by_anchor) != F.max("k1").over(by_anchor)) | (F.min("k2").over(by_anchor) != F.max("k2").over(by_anchor))
    met = runs.withColumn("several", (F.col("part") != 0) | differ).filter("n > 0")
    met = met.withColumn("least", F.min("doc").over(Window.partitionBy("k0", "part", "dropped", "k1", "k2")))
    again = F.col("dropped") | (F.col("doc") > F.col("least"))
    # most anchors stand once in the corpus; the rest is kept, as it is needed twice
    met = checkpointed(met.filter(again | F.col("several")).select(*PLACE, again.alias("again")))
    repeated = met.filter("again").select(*PLACE)
    # extension: the windows of first runs, by their own hashes
    packed = plain.mapInArrow(_packed, "doc long, tie long, packed binary").repartition(parts, "doc", "tie")
    spans = F.collect_list(F.struct("start", "n")).alias("at")
    extended = packed.join(met.filter("NOT again").groupBy("doc", "tie").agg(spans), ["doc", "tie"])
    # sorted, so that a task that is run again has the same portions
    windows = extended.sortWithinPartitions("doc", "tie").mapInArrow(_windows(window, seed), f"k0 long, k1 long, {PLACED}, part long, dropped boolean")
    again = windows.select(*PLACE, "dropped", F.min("doc").over(Window.partitionBy("k0", "k1", "dropped")).alias("least")).filter("dropped OR doc > least").select(*PLACE)
    # all repeats of a document, in one list
    gone = repeated.union(again).groupBy("doc", "tie").agg(spans)
    none = F.array().cast(gone.schema["at"].dataType)
    with_gone = packed.join(gone, ["doc", "tie"], "left").select("doc", "tie", "packed", F.coalesce("at", none).alias("at"))
    out = with_gone.mapInArrow(_removed(window, seed), "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept ones of every document; null texts have none, and an empty table
    gives no rows."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL: every window by its words, and the first place of each.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h, md5(array_to_string(w[i:i + 19], ' ')) AS m
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM wins QUALIFY row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS k FROM later),
lists AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(ks, k)), lambda k: w[k]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""
