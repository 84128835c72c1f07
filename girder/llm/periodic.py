"""Maximal periodic runs of words, by longest previous factors and Main's extensions.

A run is a stretch of words with smallest period q (words q apart are equal) that
no neighbouring word extends with that period; those of `least` words and `times`
periods or more are asked for.

Ranks.  The suffixes of a slice of documents are ranked by their first 1, 2, 4, ...
words until all ranks differ (prefix doubling); the last order is the suffix array.
The rank tables of all lengths stay: two places share their next 2**k words if
their ranks of table k are equal, so common extensions to the right and to the left
are a walk down the tables, for arrays of places at once.  One such walk over
neighbours in the suffix array is the LCP array.

Blocks.  Places are taken out of the suffix array from the last to the first; the
larger LCP to the two neighbours that are left is the longest previous factor, and
the neighbour its earlier place.  Going from block to block by these lengths cuts a
document into LZ blocks.

Runs.  A run that touches a block's border has, at that border, a period no longer
than the block and the one before it together, or lies whole periods into the block
(Main): each such period is extended both ways.  If a run reached further back, the
block before would have been longer.  A run inside a block is a copy of one in the
block's earlier place: starts are buckets in order, and each block copies the runs
of its earlier place, those included that it has just copied itself.

Work is linear in a document's words but for the walks, which take a step for each
doubling of the longest repeat.  Documents go in slices of two megabytes; a single
longer text is a slice of its own, as its runs can reach from end to end, and takes
about 300 bytes a word.

Cases: null, empty and blank texts have no words and no runs; repeated rows are
judged each by itself; other columns pass through, and a name that is taken gets a
leading underscore; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.flat import ragged, text_slices
from girder.llm.shared import fresh, table

LEAST, TIMES = 24, 3
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def rank_tables(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all places by their next 2**k words, a row for each k, and the suffix array.  first ranks the places'
    own words, those of different documents apart; end is the end of each place's document.  A last column is -1."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    head = np.concatenate([[True], first[order[1:]] != first[order[:-1]]])
    start = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    tables, width = [rank], 1
    while True:
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        place = order[at]
        ahead = place + width
        second = np.where(ahead < end[place], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[place]))
        place, second = place[by], second[by]
        order[at] = place
        own = rank[place]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])])
        head[at] = new
        rank = rank.copy()
        rank[place] = np.repeat(at[new], np.diff(np.append(np.flatnonzero(new), len(at))))
        tables.append(rank)
        width *= 2
    out = np.full((len(tables), n + 1), -1, np.int32 if n < 1 << 31 else np.int64)
    for k, t in enumerate(tables):
        out[k, :n] = t
    return out, order


def ahead(tables: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on; i and j are different places of a document, or of two."""
    n = np.zeros(len(i), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        n += np.where(tables[k][i + n] == tables[k][j + n], 1 << k, 0)
    return n


def behind(tables: np.ndarray, begin: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j, for i < j in a document that starts at begin."""
    n = np.zeros(len(i), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        a, b = i - n - (1 << k), j - n - (1 << k)
        n += np.where((a >= begin) & (tables[k][np.maximum(a, 0)] == tables[k][np.maximum(b, 0)]), 1 << k, 0)
    return n


def previous_factors(tables: np.ndarray, order: np.ndarray) -> tuple[list[int], list[int]]:
    """The length of the longest factor at each place that also starts earlier, and an earlier place of it."""
    n = len(order)
    lcp = [0, *ahead(tables, order[:-1], order[1:]).tolist(), 0]
    place = [*order.tolist(), -1]
    spot = np.empty(n, np.int64)
    spot[order] = np.arange(n)
    above, below = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [-1] * n
    for at, r in zip(range(n - 1, -1, -1), spot[::-1].tolist()):
        up, down = above[r], below[r]
        a, b = lcp[r], lcp[down]
        if a >= b:
            length[at], source[at] = a, place[up]
            lcp[down] = b
        else:
            length[at], source[at] = b, place[down]
            lcp[down] = a
        if up >= 0:
            below[up] = down
        above[down] = up
    return length, source


def blocks(length: list[int], source: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and earlier places of the LZ blocks; no block leaves its document, as no factor does."""
    starts, at, n = [], 0, len(length)
    while at < n:
        starts.append(at)
        at += length[at] or 1
    start = np.array(starts)
    return start, np.diff(np.append(start, n)), np.array(source)[start]


def touching(tables: np.ndarray, start: np.ndarray, before: np.ndarray, own: np.ndarray, bounds: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a border of blocks; own is the document of each block."""
    # each block's end is a border; a document's last one has no block behind it
    border, begin = start + before, bounds[own]
    size = np.where(border < bounds[own + 1], np.append(before[1:], 0), 0)
    reach = np.minimum(before + size, border - begin)
    # a period to the right of the border, and one to its left
    right, left = np.repeat(border, size), np.repeat(border, reach)
    i = np.concatenate([right, left - ragged(np.ones(len(reach), np.int64), reach)])
    j = np.concatenate([right + ragged(np.ones(len(size), np.int64), size), left])
    begin = np.concatenate([np.repeat(begin, size), np.repeat(begin, reach)])
    # half of what a run needs beyond its period lies on one side: a look at one table leaves few
    half = (np.maximum(least, times * (j - i)) - (j - i) + 1) // 2
    k = np.log2(half).astype(np.int64)
    ok = k < len(tables)
    i, j, begin, k = i[ok], j[ok], begin[ok], k[ok]
    a = i - (1 << k)
    ok = (tables[k, i] == tables[k, j]) | ((a >= begin) & (tables[k, np.maximum(a, 0)] == tables[k, np.maximum(j - (1 << k), 0)]))
    i, j, begin = i[ok], j[ok], begin[ok]
    start, end, period = i - behind(tables, begin, i, j), j + ahead(tables, i, j), j - i
    ok = end - start >= np.maximum(least, times * period)
    rows = np.stack([start[ok], end[ok], period[ok]], 1)
    # a stretch with a period has its multiples too: the smallest counts
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows


def with_copies(found: list[tuple[int, int, int]], cut: Iterable[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """The runs (start, end, period) of a document: those found at borders, and their copies inside of blocks."""
    at: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in found:
        at.setdefault(start, []).append((end, period))
    starts = sorted(at)
    for start, size, source in cut:
        if size < least + 2:
            continue
        k = bisect_right(starts, source)
        while k < len(starts) and starts[k] + least < source + size:
            for end, period in list(at[starts[k]]):
                if end < source + size:
                    to = starts[k] + start - source
                    if to not in at:
                        at[to] = []
                        insort(starts, to)
                    at[to].append((end + start - source, period))
            k += 1
    return sorted((start, end, period) for start in starts for end, period in set(at[start]))


def runs_of(documents: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not bounds[-1]:
        return out
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(documents)), np.int64, bounds[-1])
    own = np.repeat(np.arange(len(documents)), np.diff(bounds))
    tables, order = rank_tables(own * len(numbers) + word, bounds[1:][own])
    start, size, source = blocks(*previous_factors(tables, order))
    found = touching(tables, start, size, own[start], bounds, least, times)
    of = own[found[:, 0]]
    for d in np.unique(of).tolist():
        lo, part = int(bounds[d]), slice(*np.searchsorted(start, bounds[d : d + 2]).tolist())
        cut = zip(start[part].tolist(), size[part].tolist(), source[part].tolist())
        runs = with_copies([tuple(r) for r in found[of == d].tolist()], cut, least)
        out[d] = [(s - lo, e - s, q) for s, e, q in sorted(runs, key=lambda r: (r[0], r[2]))]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs without the text, with n_words, runs (array of start, length, period, by start and period) and collapsed, the
    text's words without those that a run repeats."""
    names = fresh(docs, "n_words", "runs", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, c in enumerate(batch.schema.names) if c != text]
            for lo, hi, data, offsets in text_slices(batch, text):
                raw = data.tobytes()
                documents = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                found = runs_of(documents, least, times)
                kept = [collapsed(d, r).decode() for d, r in zip(documents, found)]
                made = [
                    pa.array([len(d) for d in documents], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                    pa.array(kept, pa.string()),
                ]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *made], names=[*(batch.schema.names[i] for i in rest), *names])

    fields = [f for f in docs.schema.fields if f.name != text]
    made = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), RUNS, T.StringType()))]
    return docs.mapInArrow(run, T.StructType([*fields, *made]))


def looped(text: str = "text", doc_id: str = "doc_id"):
    """The text, of which a tenth of the documents (by their id) repeats a stretch of its words to its end."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col(text))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Number, strongest and digest of the periodic runs of every document, and a digest of its words without what the
    runs repeat; null texts have no words, and an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", looped().alias("text"))
    found = periodic_runs(docs)
    one = RUNS.elementType.simpleString()
    # exact comparison of length / period, the first of equals in order of start and period
    best = F.aggregate("runs", F.lit(None).cast(one), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
