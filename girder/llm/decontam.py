"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item (a shorter
item is one pattern of its own length).  For the patterns of one length m a
shift table tells, from the hash of the last block of words read, how far the
search may jump without missing a pattern; a jump of zero leads to the bucket of
patterns with that suffix, whose members are compared word by word, and at last
byte by byte, with the text.  A slice of texts is cut into lanes that all jump
at once.

The patterns are collected on the driver and shipped to the tasks only in blocks
of at most BLOCK_BYTES of benchmark text; more text means more passes over the
documents, whose hits add up, and never a larger block.  A long item is first cut
into parts that overlap by a window less one word, so each of its windows stands
in one.

Cases: null, empty and wordless texts have no words and no hits; wordless and
null items have no patterns; items with one id count once, a null id counts as
an empty one; a text of any length is searched whole; repeated rows give
repeated rows; an output name that is taken gets a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.flat import ALNUM, BYTE_VALUES, LOWER, U64, covered, mix, ragged, span_hashes, text_slices, words
from girder.llm.shared import checkpointed, fresh, table

WINDOW = 10
BLOCK_BYTES = 8 << 20
LANE = 256


def word_list(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


def hashes_of(seq: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(seq), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in seq]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return word_hashes(data, starts.astype(np.int64), ends.astype(np.int64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_VALUES[data], starts, ends)


class Patterns:
    """The shift table, suffix buckets and members of the patterns of one length."""

    def __init__(self, m: int, sequences: list[list[bytes]], items: list[list[int]]):
        self.m, self.block = m, min(3, m)
        self.text = [b" ".join(s) for s in sequences]
        self.items = items
        seq = np.stack([hashes_of(s) for s in sequences])
        bits = int(np.clip(np.ceil(np.log2(len(seq) * m * 8)), 10, 24))
        self.down = U64(64 - bits)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int16)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._slot(self._block(seq[:, :end])), m - end)
        suffix = self._block(seq)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.seq, self.member = suffix[order], seq[order], order

    def _block(self, seq: np.ndarray) -> np.ndarray:
        """The hash of the last block of words, along the last axis."""
        with np.errstate(over="ignore"):
            h = seq[..., -1].copy()
            for back in range(2, self.block + 1):
                h = mix(h * U64(0x9E3779B97F4A7C15) + seq[..., -back])
            return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (mix(h) >> self.down).astype(np.int64)

    def search(self, w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of the places whose words have the pattern's hashes."""
        n, m = len(w), self.m
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < m:
            return nothing
        h = np.zeros(n, U64)
        h[self.block - 1 :] = self._block(np.stack([w[i : n - self.block + 1 + i] for i in range(self.block)], 1))
        slot = self._slot(h)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            jump = self.shift[slot[at]]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.sort(np.concatenate(found))
        end = end[doc[end] == doc[end - m + 1]]
        lo, hi = np.searchsorted(self.suffix, h[end], "left"), np.searchsorted(self.suffix, h[end], "right")
        places, members = [], []
        size = hi - lo
        for part in np.array_split(np.arange(len(end)), max(1, int(size.sum()) // 500_000 + 1)):
            first = np.repeat(end[part] - m + 1, size[part])
            member = ragged(lo[part], size[part])
            for k in range(m):
                same = self.seq[member, k] == w[first + k]
                first, member = first[same], member[same]
            places.append(first)
            members.append(self.member[member])
        return (np.concatenate(places), np.concatenate(members)) if places else nothing


def compile_items(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[Patterns], list[str]]:
    """The pattern sets of (id, text) items by length, and the ids that patterns refer to."""
    names = sorted({i for i, _ in items})
    index = {name: k for k, name in enumerate(names)}
    by_length: dict[int, dict[tuple, set[int]]] = {}
    for name, text in items:
        seq = word_list(text)
        if not seq:
            continue
        m = min(window, len(seq))
        own = by_length.setdefault(m, {})
        for i in range(len(seq) - m + 1):
            own.setdefault(tuple(seq[i : i + m]), set()).add(index[name])
    return [Patterns(m, [list(s) for s in own], [sorted(x) for x in own.values()]) for m, own in sorted(by_length.items())], names


def _scan(patterns: list[Patterns], names: list[str], text: str, columns: tuple[str, str, str, str], first: bool):
    n_name, from_name, to_name, items_name = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, text):
                data = LOWER[data]
                starts, ends, bound = words(data, offsets, ALNUM)
                w = word_hashes(data, starts, ends)
                count = np.diff(bound)
                doc = np.repeat(np.arange(hi - lo), count)
                begin, finish, hit_items = [], [], set()
                for p in patterns:
                    for at, member in zip(*p.search(w, doc)):
                        if b" ".join(data[a:b].tobytes() for a, b in zip(starts[at : at + p.m], ends[at : at + p.m])) == p.text[member]:
                            begin.append(at)
                            finish.append(at + p.m)
                            hit_items.update((int(doc[at]), i) for i in p.items[member])
                part = batch.slice(lo, hi - lo)
                if not first:
                    # hits of the blocks before
                    for into, name in ((begin, from_name), (finish, to_name)):
                        old = part.column(part.schema.get_field_index(name))
                        into.extend(np.repeat(bound[:-1], np.diff(old.offsets.to_numpy())) + old.flatten().to_numpy(zero_copy_only=False))
                    old = part.column(part.schema.get_field_index(items_name)).to_pylist()
                hit = covered(np.array(begin, np.int64), np.array(finish, np.int64), len(w))
                a, b, edge = _intervals(hit, bound)
                own = [set() for _ in range(hi - lo)]
                for d, i in hit_items:
                    own[d].add(names[i])
                if not first:
                    own = [x | set(y) for x, y in zip(own, old)]
                    part = part.select([c for c in part.schema.names if c not in columns])
                at = pa.array(edge, pa.int32())
                made = [
                    pa.array(count, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(a, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(b, pa.int32())),
                    pa.array([sorted(x) for x in own], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *columns])

    return run


def _intervals(hit: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hits, as word numbers within their documents."""
    from girder.llm.flat import runs

    starts, ends, edge = runs(hit, bound)
    base = np.repeat(bound[:-1], np.diff(edge))
    return starts - base, ends - base, edge


def parts_of(items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(id, text) of distinct items, each long one in parts of about a sixteenth of a block that hold all its windows."""
    limit = max(256, block_bytes // 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None and len(text.encode()) > limit:
                    seq = word_list(text)
                    begin = 0
                    while begin == 0 or begin + window <= len(seq):
                        stop, size = min(begin + window, len(seq)), sum(len(w) + 1 for w in seq[begin : begin + window])
                        while stop < len(seq) and size + len(seq[stop]) < limit:
                            size += len(seq[stop]) + 1
                            stop += 1
                        ids.append(name)
                        texts.append(b" ".join(seq[begin:stop]).decode())
                        begin = max(begin + 1, stop - window + 1)
                else:
                    ids.append(name)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])

    return checkpointed(items.distinct().mapInArrow(cut, "id string, text string").distinct())


def blocks_of(items: DataFrame, block_bytes: int):
    """(block of an item, number of blocks), so that no block has more than block_bytes (but for a part that alone has)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total, n = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(total) // max(1, block_bytes)))
    while True:
        block_of = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
        held = items.groupBy(block_of.alias("block")).agg(F.sum(size).alias("size"), F.count("*").alias("n"))
        if not held.filter((F.col("size") > block_bytes) & (F.col("n") > 1)).limit(1).count() or blocks > 4 * n:
            return block_of, blocks
        blocks += -(-blocks // 4)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_from and hit_to (intervals of hit words) and hit_items (ids, sorted as strings)."""
    columns = tuple(fresh(docs, "n_words", "hit_from", "hit_to", "hit_items"))
    schema = T.StructType([
        *docs.schema.fields,
        T.StructField(columns[0], T.LongType()),
        T.StructField(columns[1], T.ArrayType(T.IntegerType())),
        T.StructField(columns[2], T.ArrayType(T.IntegerType())),
        T.StructField(columns[3], T.ArrayType(T.StringType())),
    ])
    items = parts_of(benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text")), window, block_bytes)
    block_of, blocks = blocks_of(items, block_bytes)
    out = docs
    for block in range(blocks):
        own = items.filter(block_of == block)
        patterns, names = compile_items([(r.id, r.text) for r in own.collect()], window)
        out = out.mapInArrow(_scan(patterns, names, text, columns, block == 0), schema)
        if block + 1 < blocks:
            out = checkpointed(out)
    return out


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, hit words and items found of every document; null texts have none, and an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


#: The same in SQL (items and documents are split into words, windows are joined by their text).
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM p),
wins AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
         FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, wins.m, item_id FROM wins JOIN p USING (m, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
