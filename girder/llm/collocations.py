"""Word collocations of every language, from phrase counts by sorted suffixes.

Texts are cut into pieces and those into words; a phrase is up to max_n words that
follow each other in a piece.

Suffixes.  At each word starts a suffix, cut at max_n words.  A task counts equal
ones, and sends them by language and first word, the head: a row has a head and the
suffixes behind it, as lines.  A head that is frequent in the whole corpus (more than
SHARE occurrences, known from a count of words) goes to several buckets, by a hash of
the next word; if that is frequent too, of the next two, and so on.  As what follows up
to the first word that is not frequent is in one bucket, and is no more frequent than
that word, no bucket collects much more than SHARE occurrences, whatever the corpus
repeats (a suffix of frequent words alone is counted by the tasks before).  Beyond
SHARE * MOST_HEAVY words SHARE grows, so that the frequent words, a hash and a count
each, go to the tasks with a size that is bounded.  A word that is too rare in the
whole corpus for any phrase asked for begins no suffix and ends those that it is in; the
tasks know such words by a bitmap of BITS hashes, in which some may be missing.

Counting.  Spark sorts a partition's heads in reverse order, and the lines of a head
are sorted when it is read, after those whose next words are too rare there have been
cut and added up.  Suffixes with a common beginning are then neighbours,
and one stack of max_n words counts all beginnings: a word that the next suffix does
not share is popped, which is a phrase with its count, and its count goes to the word
below.  Phrases of frequent words alone have parts of their counts in several heads;
those parts are added up afterwards, all others are whole and leave the task only
if they are frequent enough.

Parts.  A candidate is cut after each of its words, and both sides, which are as
frequent as it is at least, join their counts.  Numbers are decimals where products
could pass 64 bits.  The first candidates of a language are kept by a window that
Spark cuts before its shuffle.

Cases: null, empty and blank texts have no words; a null language is `und`;
repeated rows count as often as they are there; a text of any length is read whole;
other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.flat import LOWER, mix, runs, text_slices
from girder.llm.shared import checkpointed, partitions, table

MAX_N, LEAST, SHADE, TOP = 4, 30, 80, 2000
#: Occurrences of a word from which on it is frequent, and how many words may be.
SHARE, MOST_HEAVY = 250_000, 2_000_000
#: Bits of the bitmap of words that are not rare, in parts of PART bits (the size of Spark's bitmaps).
BITS, PART = 1 << 24, 1 << 15
#: Bytes of text of which a task counts equal suffixes at once.
PORTION = 4 << 20
#: Bytes that end a piece, and those that part its words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[list(ENDS + GAPS)] = True
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
#: A-Z in lower case, and spaces for all that stands outside of words.
_PLAIN = LOWER.copy()
_PLAIN[_OUTSIDE] = 0x20
#: The byte that joins words in lines; it is smaller than all others, so that a phrase and what continues it
#: are neighbours.  Words that have it, or the next one, are written with two bytes for one, in the same order.
JOIN = b"\0"


def escaped(word: bytes) -> bytes:
    return word.replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x01")


def readable(phrase: bytes) -> str:
    return phrase.replace(JOIN, b" ").replace(b"\x01\x01", b"\0").replace(b"\x01\x02", b"\x01").decode()


class Words:
    """The words of texts as numbers, with the number of words from each on to its piece's end."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = _PLAIN[data]
        starts, ends, bound = runs(plain != 0x20, offsets)
        raw = plain.tobytes()
        # a word that ends where the next document's first one starts is one of two that split() would join
        joined = np.flatnonzero(starts[1:] == ends[:-1])
        words: Iterable[bytes] = raw.split() if not len(joined) else (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(starts))
        piece = np.cumsum(np.concatenate([[0], _END[data]]))[starts] if len(starts) else starts
        first = np.zeros(len(starts) + 1, bool)
        first[1:-1] = piece[1:] != piece[:-1]
        first[bound] = True
        edge = np.flatnonzero(first)
        return numbers, edge[np.searchsorted(edge, np.arange(len(starts)), "right")] - np.arange(len(starts)) if len(starts) else starts

    def spelt(self) -> list[bytes]:
        return [escaped(w) for w in self.number]


def by_language(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[tuple[str, Words, list[tuple[np.ndarray, np.ndarray]]]]:
    """The words of each language in portions of texts (columns lang, text)."""
    held: dict[str, tuple[Words, list]] = {}
    size = 0
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(langs.indices.to_numpy() == code)
            part = pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(rows))], names=["text"])
            for _, _, data, offsets in text_slices(part, "text"):
                words, parts = held.setdefault(lang, (Words(), []))
                parts.append(words.read(data, offsets))
                size += len(data)
                if size >= portion:
                    yield from ((k, *v) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, *v) for k, v in held.items())


def word_hash(lang: str, word: bytes) -> int:
    """As Spark's xxhash64 of the same bytes, unsigned."""
    return xxhash.xxh64_intdigest(lang.encode() + b" " + word, 42)


def _word_counts(portion: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, parts in by_language(batches, portion):
            spelt = words.spelt()
            count = sum(np.bincount(numbers, minlength=len(spelt)) for numbers, _ in parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spelt), pa.string()), pa.array(spelt, pa.binary()), pa.array(count, pa.int64())], names=["lang", "word", "n"])

    return run


SENT = "lang string, head binary, bucket int, open int, n long, lines binary, counted binary"


def _suffixes(max_n: int, heavy: dict[int, int], known: np.ndarray, portion: int):
    """Rows (lang, head, bucket, open, n, lines, counted): lines continue the head, counted are those that stand for several,
    with their counts before them, n is how many suffixes they are; `open` words from the head on are frequent, so that
    their phrases have counts elsewhere too.  heavy has the buckets of frequent words, known is a bitmap of words that are
    not rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, parts in by_language(batches, portion):
            spelt = words.spelt()
            if not spelt:
                continue
            # numbers in order of spelling, from 1 on; 0 is the end of a suffix
            order = sorted(range(len(spelt)), key=spelt.__getitem__)
            spelt = [b"", *(spelt[i] for i in order)]
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            hashes = [word_hash(lang, w) for w in spelt[1:]]
            buckets = np.array([0, *(heavy.get(h, 0) for h in hashes)], np.int64)
            spot = np.array(hashes, np.uint64)
            mixed = np.append(np.uint64(0), spot)
            spot %= np.uint64(BITS)
            rare = np.append(True, known[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 == 0)
            columns = []
            for numbers, left in parts:
                r = np.append(rank[numbers], np.int32(0))
                # a rare word is an end like that of a piece, and r ends with one
                ends = np.flatnonzero(rare[r])
                at = np.flatnonzero(~rare[r[:-1]])
                left = np.minimum(left[at], ends[np.searchsorted(ends, at)] - at)
                columns.append(np.stack([np.where(left > k, r[np.minimum(at + k, len(numbers))], np.int32(0)) for k in range(max_n)]))
            parts.clear()
            grid = np.concatenate(columns, axis=1)
            columns.clear()
            if not grid.shape[1]:
                continue
            # two words in a number, as numbers of words have less than 32 bits
            pairs = [grid[k].astype(np.int64) << 32 | (grid[k + 1] if k + 1 < max_n else 0) for k in range(0, max_n, 2)]
            grid = grid[:, np.lexsort(pairs[::-1])]
            new = np.concatenate([[True], (grid[:, 1:] != grid[:, :-1]).any(axis=0)])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, grid.shape[1]))
            grid = grid[:, at]
            # frequent words from the first on, and the bucket by all words up to the first other one
            lead = np.cumprod(buckets[grid] > 0, axis=0).sum(axis=0)
            open_ = np.minimum(lead, max_n - 1)
            name = np.zeros(grid.shape[1], np.uint64)
            for k in range(1, max_n):
                name = np.where(k <= open_, mix(name ^ mixed[grid[k]]), name)
            bucket = np.where(lead > 0, (name % np.maximum(buckets[grid[0]], 1).astype(np.uint64)).astype(np.int64), 0)
            by = np.lexsort((open_, bucket, grid[0]))
            grid, count, open_, bucket = grid[:, by], count[by], open_[by], bucket[by]
            group = np.flatnonzero(np.concatenate([[True], (grid[0, 1:] != grid[0, :-1]) | (bucket[1:] != bucket[:-1]) | (open_[1:] != open_[:-1])]))
            joined = [b"", *(JOIN + w for w in spelt[1:])]
            # rows of at most some ten thousand suffixes at a time, or of one group
            cuts = [*group[np.unique(np.minimum(np.searchsorted(group, np.arange(0, len(count), 1 << 15)), len(group) - 1))].tolist(), len(count)]
            for lo, hi in zip(cuts, cuts[1:]):
                own = group[(group >= lo) & (group < hi)]
                rest = [[(joined if k > 1 else spelt)[i] for i in grid[k, lo:hi].tolist()] for k in range(1, max_n)]
                lines = list(map(b"".join, zip(*rest)))
                several = np.flatnonzero(count[lo:hi] > 1)
                for i, n in zip(several.tolist(), count[lo:hi][several].tolist()):
                    lines[i] = b"%d\t%s" % (n, lines[i])
                once, more = [], []
                first = np.searchsorted(several, own - lo).tolist()
                for a, b, c, d in zip((own - lo).tolist(), [*(own[1:] - lo).tolist(), hi - lo], first, [*first[1:], len(several)]):
                    if c == d:
                        once.append(b"\n".join(lines[a:b]))
                        more.append(None)
                    else:
                        more.append(b"\n".join([lines[i] for i in several[c:d].tolist()]))
                        once.append(b"\n".join([x for x in lines[a:b] if b"\t" not in x]) if d - c < b - a else None)
                made = [
                    pa.array([lang] * len(own), pa.string()), pa.array([spelt[i] for i in grid[0, own].tolist()], pa.binary()), pa.array(bucket[own], pa.int32()),
                    pa.array(open_[own], pa.int32()), pa.array(np.add.reduceat(count[lo:hi], own - lo), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["lang", "head", "bucket", "open", "n", "lines", "counted"])

    return run


class Stack:
    """Counts the beginnings of sorted suffixes: words and counts of the suffix at hand, from the first word on."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.open = 0
        self.out: list[tuple[bytes, int, int]] = []

    def pop(self, depth: int) -> None:
        words, counts = self.words, self.counts
        while len(words) > depth:
            n = counts.pop()
            if n >= self.least or len(words) <= self.open:
                self.out.append((JOIN.join(words), len(words), n))
            words.pop()
            if counts:
                counts[-1] += n

    def push(self, suffix: list[bytes], n: int, open_: int) -> None:
        words, depth = self.words, 0
        for a, b in zip(words, suffix):
            if a != b:
                break
            depth += 1
        if depth < len(words):
            self.pop(depth)
        # of the words that stay, those before open_ are as open as they were
        self.open = open_
        words += suffix[depth:]
        self.counts += [0] * (len(suffix) - depth)
        self.counts[-1] += n


def condensed(lines: list[bytes], counted: list[tuple[bytes, int]], least: int, keep: int) -> Counter:
    """Counts of lines, of which the words go that make a beginning that less than least of them have; the first `keep`
    words stay in any case."""
    out: Counter = Counter()
    depth = keep
    while lines or counted:
        depth += 1
        begin = (lambda x: x.partition(JOIN)[0]) if depth == 1 else (lambda x, n=depth: JOIN.join(x.split(JOIN, n)[:n]))
        keys = [begin(x) for x in lines]
        count = Counter(keys)
        for line, n in counted:
            count[begin(line)] += n
        # a line that ends here is its own beginning, as it was a word before
        whole = (lambda k: not k) if depth == 1 else (lambda k, n=depth: k.count(JOIN) < n - 1)
        goes_on = {k for k, n in count.items() if n >= least and not whole(k)}
        for k, n in count.items():
            if k not in goes_on:
                out[k if whole(k) else k.rpartition(JOIN)[0] if depth > 1 else b""] += n
        lines = [x for x, k in zip(lines, keys) if k in goes_on]
        counted = [(x, n) for x, n in counted if begin(x) in goes_on]
    return out


def _counted(least: int):
    """(lang, phrase, size, n) of the beginnings of sorted rows (see SENT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[str, bytes, int, int] | None = None
        held: list[bytes] = []
        held_counted: list[bytes] = []
        total = 0
        stack = Stack(least)

        def count() -> None:
            _, head, _, open_ = own
            # a head that is whole here and too rare has no phrase
            if total < least and not open_:
                return
            lines = b"\n".join(held).split(b"\n") if held else []
            pairs = (x.partition(b"\t") for x in b"\n".join(held_counted).split(b"\n")) if held_counted else ()
            found = condensed(lines, [(x, int(n)) for n, _, x in pairs], least, max(0, open_ - 1))
            for line in sorted(found, reverse=True):
                stack.push([head, *line.split(JOIN)] if line else [head], found[line], open_)

        def found(lang: str) -> pa.RecordBatch:
            phrases, sizes, counts = zip(*stack.out)
            stack.out = []
            made = [pa.array([lang] * len(phrases), pa.string()), pa.array([readable(p) for p in phrases], pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "size", "n"])

        for batch in batches:
            for *key, n, lines, counted in zip(*(batch.column(c).to_pylist() for c in ("lang", "head", "bucket", "open", "n", "lines", "counted"))):
                if own is not None and key != own:
                    count()
                    held.clear()
                    held_counted.clear()
                    total = 0
                    if key[0] != own[0]:
                        stack.pop(0)
                    if stack.out and (key[0] != own[0] or len(stack.out) > 1 << 14):
                        yield found(own[0])
                own = key
                total += n
                if lines is not None:
                    held.append(lines)
                if counted is not None:
                    held_counted.append(counted)
        if own is not None:
            count()
            stack.pop(0)
            if stack.out:
                yield found(own[0])

    return run


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, portion: int = PORTION) -> tuple[DataFrame, DataFrame]:
    """(lang, n), the words of each language, and (lang, phrase, size, n) of the phrases of at most max_n words that occur
    least times or more."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = checkpointed(rows.mapInArrow(_word_counts(4 * portion), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = checkpointed(words.groupBy("lang").agg(F.sum("n").alias("n")))
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    # no more than MOST_HEAVY words can occur so often
    share = max(share, all_words // MOST_HEAVY, 1)
    named = F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b" "), "word"))
    frequent = words.filter(F.col("n") > share).select(named.alias("word"), F.ceil(F.col("n") / share).alias("buckets")).toArrow()
    heavy = dict(zip(frequent.column("word").to_numpy().view(np.uint64).tolist(), frequent.column("buckets").to_pylist()))
    bit = F.pmod(named, F.lit(BITS))
    parts = words.filter(F.col("n") >= least).groupBy(F.floor(bit / PART).alias("part")).agg(F.bitmap_construct_agg(bit % PART).alias("bits"))
    known = np.zeros(BITS // 8, np.uint8)
    # BITS / PART rows at most
    for r in parts.collect():
        known[r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    sent = rows.mapInArrow(_suffixes(max_n, heavy, known, portion), SENT)
    dealt = sent.repartition(partitions(docs.sparkSession), "lang", "head", "bucket").sortWithinPartitions(F.desc("lang"), F.desc("head"), "bucket", "open")
    parts = dealt.mapInArrow(_counted(least), "lang string, phrase string, size int, n long")
    return totals, checkpointed(parts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, least: int = LEAST, shade: int = SHADE, top: int = TOP, **options: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `top` phrases of each language; a phrase is left out if a longer
    one that holds it is at least shade percent as frequent."""
    totals, counts = phrase_counts(docs, lang, text, max_n, least, **options)
    several = counts.filter("size > 1").select("lang", "phrase", "size", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    piece = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    # weakest cut
    cuts = several.select("lang", "phrase", "size", "words", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("scaled", F.lit(2_000_000).cast("decimal(7,0)") * _wide(F.col("a"))).withColumn("both", _wide(F.col("l")) + _wide(F.col("r")))
    cuts = cuts.withColumn("score", F.expr("scaled div both"))
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # shaded by a longer one: the most frequent that holds it decides
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("size") - size + 1), lambda start: F.slice("words", start, size))))
    held = several.filter("size > 2").select("lang", "a", F.explode(inner).alias("inner"))
    held = held.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * shade))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of each language of the documents; null texts have no words, a null language is
    `und`, and an empty table gives no rows."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same in SQL: every phrase of a piece by its place.
OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i:i + k - 1] AS w, k FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                                              FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, w, k AS size, count(*) AS f FROM g GROUP BY lang, w, k HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE size > 1),
cuts AS (SELECT c.lang, c.w, c.f AS a, k, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS score
         FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c) c
         JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:c.size]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inner_ AS (SELECT lang, w[i:i + k - 1] AS w, max(f) AS longer
           FROM (SELECT *, unnest(generate_series(1, size - k + 1)) AS i FROM (SELECT *, unnest(generate_series(2, size - 1)) AS k FROM c WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.w = s.w
         WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
