"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit fingerprint of its word shingles; fingerprints that
differ in at most `radius` bits link, and linked documents form components.

Linking works on distinct fingerprints, so exact copies cost nothing more.
Fingerprints are dealt to buckets by bit blocks: `radius` differing bits spoil
at most `radius` of 2 * radius blocks, so two near fingerprints agree on some
choice of `radius` whole blocks, and every choice is one bucket key of about 32
bits (more blocks, and longer keys, beyond 2**32 distinct fingerprints).
(Distances to random pivots are concentrated around 32 and could not deal the
work out by themselves.)  In a bucket the pivot table does the work: the Hamming
distances to PIVOTS reference fingerprints are computed once, pairs whose
largest coordinate difference exceeds the radius are discarded by the triangle
inequality, and survivors are verified.  A large bucket is searched breadth
first from one member at a time against those not yet reached, which gives a
spanning forest of its links: output stays below the bucket's size, however
dense it is, and the components are exact.

A bucket of more than CROWD fingerprints is not searched but dealt again, by the
bits that its key leaves open: those are cut into blocks in the same way.  What
is left open then (16 bits of 64) bounds a bucket by 65,536 distinct
fingerprints, so no task ever holds more, whatever the corpus repeats.

near_components and keep_first are the operator's form for copies with edited
words: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more.  Such fingerprints are about ten bits apart, too far for bit blocks, so
candidates meet by MinHash bands (see shingles.BANDS).  In a bucket the pivot
table of their SimHash fingerprints discards what is more than FAR bits apart, and
whole sets verify the rest.  (The references are the first PIVOTS texts of the
bucket that had no partner, as random ones discard next to nothing at such a
radius.  At similarity 0.8 the distance is 9.7 with a deviation of 2.9, so one pair
in ten thousand is further apart.)  Each text is compared with those held before
it, and one link to each component among them is enough.

A task holds HELD_BYTES of a bucket.  A bucket of more than TEXTS texts is dealt to
several tasks: some TEXTS of them, picked by hash, go to all of those tasks, every
other text to one.  What a task could not hold, and what was compared with the picked
ones only, is left over; of that, only texts that no links connect yet have anything
to find.  So a next round looks at the buckets in which several components are left,
holds the smaller ones first, and skips what is connected; it ends when each bucket
has one component left.  A bucket of near copies is through after the first round or
two, however large it is, and all pairs that meet in a bucket are linked or connected,
whatever the bounds are.

Cases: texts without words (null and empty ones too) have fingerprint zero and
link like any other; an empty table gives no links and no rows; a text of any
length is read whole, a few megabytes of texts at a time; repeated rows share a
fingerprint; a component's id is its smallest doc_id (null if it has none; rows
with a null id come last); other columns pass through, and a name that is taken
gets a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.flat import LOWER, U64, mix, text_slices
from girder.llm.shared import checkpointed, fresh, partitions, table
from girder.llm.shingles import BANDS, band_keys, majority, node_of, shingles
from girder.operators import lookup

SEED = 42
PIVOTS = 32
SMALL = 24
#: Fingerprints that a bucket may have before it is dealt again.
CROWD = 4096
SHINGLE, SIMILARITY = 5, 0.8
FAR = 20
#: Bytes of sets of shingles that a task holds of a bucket, and texts from which on a bucket is dealt to several tasks.
HELD_BYTES, TEXTS = 16 << 20, 1024


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64 hashes (repeats included)."""
    n = len(words) - shingle + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], U64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs with `fp`, the fingerprint as a signed 64-bit integer."""
    (name,) = fresh(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros(len(batch), U64)
            for lo, hi, data, offsets in text_slices(batch, text):
                raw = LOWER[data].tobytes()
                for i in range(hi - lo):
                    values[lo + i] = fingerprint(raw[offsets[i] : offsets[i + 1]].split(), shingle)
            rest = [c for c in batch.schema.names if c != text]
            part = batch.select(rest)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values.view(np.int64))], names=[*rest, name])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))


def pivots(n: int = PIVOTS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fp ^ r) for r in refs], 1).astype(np.int8)


def _near(fp: np.ndarray, coords: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) survive the table and are near."""
    live = np.arange(len(a))
    for lo in range(0, coords.shape[1], 8):
        gap = np.abs(coords[a[live], lo : lo + 8] - coords[b[live], lo : lo + 8]).max(axis=1)
        live = live[gap <= radius]
    return live[np.bitwise_count(fp[a[live]] ^ fp[b[live]]) <= radius]


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal keys: all pairs of small runs, a spanning forest of large ones."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    several = np.repeat((size > 1) & (size <= SMALL), size)
    at = np.flatnonzero(several)
    if len(at):
        k, f = key[at], fp[at]
        coords = pivot_table(f, refs)
        for lag in range(1, SMALL):
            a = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(a):
                break
            ok = a[_near(f, coords, a, a + lag, radius)]
            yield f[ok], f[ok + lag]
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        yield from forest(fp[s : s + n], radius, refs)


def forest(fp: np.ndarray, radius: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever near pairs connect among fp."""
    coords = pivot_table(fp, refs)
    left = np.arange(len(fp))
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
        root = frontier.pop()
        near = _near(fp, coords, np.full(len(left), root), left, radius)
        if len(near):
            hit = left[near]
            yield np.full(len(hit), fp[root]), fp[hit]
            frontier.extend(hit.tolist())
            left = np.delete(left, near)


def _link_runs(radius: int, crowd: int | None):
    """Links within the runs of one key of sorted rows (key, choice, fp); as rows with `again`, and choice as b, the
    members of runs of more than crowd, of which no more than that and a batch is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        crowded = None

        def rows(a: np.ndarray, b: np.ndarray, again: bool) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), again))], names=["a", "b", "again"])

        def linked(key: np.ndarray, choice: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if crowd is not None and len(key) > crowd:
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(start, len(key)))
                big = np.repeat(size > crowd, size)
                yield from rows(fp[big], choice[big], True)
                key, fp = key[~big], fp[~big]
            if len(key):
                for a, b in bucket_links(key, fp, radius, refs):
                    yield from rows(a, b, False)

        for batch in batches:
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().view(U64)
            if crowded is not None:
                more = int(np.searchsorted(new[0] != crowded, True))
                yield from rows(new[2][:more], new[1][:more], True)
                new = tuple(c[more:] for c in new)
            if not len(new[0]):
                continue
            key, choice, fp = (np.concatenate(c) for c in zip(held, new))
            cut = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            yield from linked(key[:cut], choice[:cut], fp[:cut])
            held, crowded = (key[cut:], choice[cut:], fp[cut:]), None
            if crowd is not None and len(held[0]) > crowd:
                yield from rows(held[2], held[1], True)
                held, crowded = tuple(c[:0] for c in held), key[-1]
        yield from linked(*held)

    return run


def block_masks(radius: int, blocks: int, bits: list[int] | None = None) -> list[int]:
    """Masks of every choice of the blocks of bits (all 64) that `radius` differing bits can leave whole."""
    bits = list(range(64)) if bits is None else bits
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks_for(n: int, radius: int) -> int:
    """Blocks enough for keys with a bit for each doubling of n, so that buckets stay small whatever n is."""
    blocks = 2 * radius
    while blocks < 64 and 64 * (blocks - radius) / blocks < n.bit_length():
        blocks += 1
    return blocks


def _dealt(keyed: DataFrame, radius: int, crowd: int | None) -> DataFrame:
    dealt = keyed.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    return dealt.select("key", "choice", "fp").mapInArrow(_link_runs(radius, crowd), "a long, b long, again boolean")


def links(prints: DataFrame, radius: int = 3, blocks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(a, b) links between the distinct fingerprints in column fp that connect all near ones."""
    masks = block_masks(radius, blocks or blocks_for(prints.count(), radius))
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for i, m in enumerate(masks)])
    first = checkpointed(_dealt(prints.select(F.explode(choices).alias("c"), "fp").select("c.*", "fp"), radius, crowd))
    found = first.filter("NOT again").select("a", "b")
    # crowded buckets once more, by the bits that their keys leave open
    again = first.filter("again").select(F.col("a").alias("fp"), F.col("b").cast("int").alias("choice"))
    if again.limit(1).count():
        finer = []
        for mask in masks:
            left = [b for b in range(64) if not mask >> b & 1]
            finer.append(F.array(*[F.lit(signed(mask | m)) for m in block_masks(radius, min(2 * radius, len(left)), left)]))
        again = again.select("fp", "choice", F.posexplode(F.element_at(F.array(*finer), F.col("choice") + 1)).alias("finer", "mask"))
        again = again.select("choice", F.xxhash64("choice", "finer", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
        found = found.union(_dealt(again, radius, None).select("a", "b"))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node it is connected with."""
    return lookup.components(edges, checkpointed)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, content, fp, root, component_id) of each document; content is a hash of the text, root the smallest
    fingerprint of the component."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    prints = checkpointed(fingerprints(rows, "text", shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return prints.join(_labels(distinct, roots, "fp"), "fp")


def _labels(members: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, root, component_id) of members (node, first_id): a node without links is its own component."""
    member = members.select(node, "first_id").join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    return member.join(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select(node, "root", "component_id")


def near_prints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, place, node, fp, keys) of rows (doc_id, place, text): node names the set of shingles, keys are its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, count = [], [], [], []
            for grams, bound in shingles(batch, "text", shingle):
                sets = [np.unique(grams[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                size = np.array([len(x) for x in sets])
                nodes += [node_of(x) for x in sets]
                edge = np.concatenate([[0], np.cumsum(size)])
                grams = np.concatenate(sets) if len(sets) else grams[:0]
                prints.append(majority(grams, edge))
                if len(grams):
                    keys.append(band_keys(grams, edge).ravel().view(np.int64))
                count.append(np.where(size > 0, BANDS, 0))
            if nodes:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                made = [pa.array(nodes, pa.int64()), pa.array(np.concatenate(prints).view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *made], names=["doc_id", "place", "node", "fp", "keys"])

    return rows.select("doc_id", "place", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place string, node long, fp long, keys array<long>")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, bound in shingles(batch, "text", shingle):
                sets = [np.unique(grams[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return run


class Bucket:
    """The texts of a bucket that later ones are compared with, and their pivot table."""

    def __init__(self, similarity: float, far: int = FAR, held_bytes: int = HELD_BYTES):
        self.similarity, self.far, self.held_bytes = similarity, far, held_bytes
        self.refs = np.zeros(0, U64)
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        #: of each held text its fingerprint, distances to references, component and number of shingles
        self.fp, self.coords = np.zeros(16, U64), np.zeros((16, PIVOTS), np.int8)
        self.component, self.size = np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.bytes = 0
        #: a held text of each component that is known from elsewhere
        self.of: dict[int, int] = {}
        #: pairs that met, that the pivot table left, and that whole sets were read of
        self.met = self.left = self.read = 0

    def root(self, i: int) -> int:
        return int(self.component[i])

    def near(self, node: int, fp: int, grams: np.ndarray, known: int | None = None) -> tuple[list[int], bool]:
        """The first text of each component that a held text near to this one is in, but for that which it is known to be in;
        and whether it is held now.  Links to first texts are stars, which components are contracted from in few rounds."""
        n, fp = len(self.nodes), U64(fp)
        used = len(self.refs)
        coords = np.bitwise_count(self.refs ^ fp).astype(np.int8)
        live = np.arange(n)
        for lo in range(0, used if n else 0, 8):
            hi = min(lo + 8, used)
            live = live[np.abs(self.coords[live, lo:hi] - coords[lo:hi]).max(axis=1, initial=0) <= self.far]
        self.met, self.left = self.met + n, self.left + len(live)
        apart = np.bitwise_count(self.fp[live] ^ fp)
        live, apart = live[apart <= self.far], apart[apart <= self.far]
        live = live[np.argsort(apart, kind="stable")]
        # sizes too far apart can't be near, nor need a component be found that it is in
        size = self.size[live]
        live = live[np.minimum(size, len(grams)) >= self.similarity * np.maximum(size, len(grams))]
        joined = {self.root(self.of[known])} if known in self.of else set()
        for r in joined:
            live = live[self.component[live] != r]
        found: dict[int, int] = {}
        while len(live):
            i = int(live[0])
            self.read += 1
            both = len(np.intersect1d(grams, self.sets[i], assume_unique=True))
            if both >= self.similarity * (len(grams) + len(self.sets[i]) - both) - 1e-9:
                found[self.root(i)] = i
                live = live[self.component[live] != self.component[i]]
            else:
                live = live[1:]
        # one text at least, so that rounds come to an end
        room = not self.nodes or self.bytes < self.held_bytes
        own = min([*joined, *found], default=None)
        if room:
            if n == len(self.fp):
                self.fp, self.coords, self.component, self.size = (np.concatenate([x, x]) for x in (self.fp, self.coords, self.component, self.size))
            self.fp[n], self.coords[n, :used], self.component[n], self.size[n] = fp, coords, n, len(grams)
            if not found and used < PIVOTS:
                self.refs = np.append(self.refs, fp)
                self.coords[: n + 1, used] = np.bitwise_count(self.fp[: n + 1] ^ fp)
            self.nodes.append(node)
            self.sets.append(grams)
            self.bytes += grams.nbytes
            own = n if own is None else own
        if own is not None:
            held = self.component[: len(self.nodes)]
            if room:
                held[n] = own
            for r in (*found, *joined):
                if r != own:
                    held[held == r] = own
            if known is not None:
                self.of[known] = n if room else next(i for i in (*found.values(), self.of.get(known)) if i is not None)
        return [self.nodes[r] for r in found], room


def _link_buckets(similarity: float, held_bytes: int):
    """Links (a, b) within the buckets (key, part), and as rows with `again` the node and key of what is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bucket = None, Bucket(similarity, held_bytes=held_bytes)
        for batch in batches:
            a, b, again = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("key", "part", "picked", "node", "fp", "known"))
            for key, part, picked, node, fp, known, grams in zip(*columns, batch.column("grams")):
                if (key, part) != own:
                    own, bucket = (key, part), Bucket(similarity, held_bytes=held_bytes)
                # a copy, as a view would hold its whole batch
                near, held = bucket.near(node, fp % (1 << 64), np.frombuffer(grams.as_buffer(), U64).copy(), known)
                a += [node] * len(near)
                b += near
                again += [False] * len(near)
                if not (held and picked):
                    a.append(node)
                    b.append(key)
                    again.append(True)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(again, pa.bool_())], names=["a", "b", "again"])

    return run


def _parts(left: DataFrame, texts: int) -> DataFrame:
    """left (key, node, known, follows) with part and picked: a bucket of more than texts texts has several parts, of which
    each gets those that are picked, and one gets each other text."""
    counts = left.groupBy("key").agg(F.count_if(~F.col("follows")).alias("some"), F.ceil(F.count("*") / texts).cast("int").alias("parts"))
    hash_ = F.xxhash64("node", "key")
    picked = (F.col("parts") == 1) | (~F.col("follows") & (F.pmod(hash_, F.col("some")) < texts))
    rows = left.join(counts, "key").withColumn("picked", picked)
    to = F.when(F.col("picked"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64(hash_), F.col("parts")).cast("int")))
    return rows.select("key", "node", "known", "follows", "picked", F.explode(to).alias("part"))


def near_components(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, held_bytes: int = HELD_BYTES, texts: int = TEXTS) -> DataFrame:
    """(doc_id, place, root, component_id) of rows (doc_id, place, text); place tells rows with one id but other texts apart."""
    found = checkpointed(near_prints(rows, shingle))
    nodes = checkpointed(found.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("place").alias("place"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    # buckets of several nodes, each set of members once
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    several = several.groupBy("n", "members").agg(F.min("key").alias("key")).select("key")
    left = checkpointed(keyed.join(several, "key").select("key", "node", F.lit(None).cast("long").alias("known"), F.lit(False).alias("follows")))
    edges = roots = None
    while True:
        # their sets, from one text of each
        asked = nodes.join(left.select("node").distinct(), "node", "left_semi").select("place")
        sets = rows.select("place", "text").join(asked, "place", "left_semi").dropDuplicates(["place"]).mapInArrow(_sets(shingle), "node long, grams binary")
        sets = sets.join(nodes.select("node", "first_id", "fp"), "node")
        dealt = _parts(left, texts).join(sets, "node").repartition(partitions(rows.sparkSession), "key", "part")
        dealt = dealt.sortWithinPartitions("key", "part", F.desc("picked"), "follows", F.asc_nulls_last("first_id"), "node").select("key", "part", "picked", "node", "fp", "known", "grams")
        met = checkpointed(dealt.mapInArrow(_link_buckets(similarity, held_bytes), "a long, b long, again boolean"))
        links_ = met.filter("NOT again").select("a", "b").distinct()
        edges, roots = links_ if edges is None else checkpointed(edges.union(links_)), None
        again = met.filter("again").select(F.col("a").alias("node"), F.col("b").alias("key")).distinct()
        if not again.limit(1).count():
            break
        # buckets with one component left have nothing to find; of others the largest component comes last
        roots = components(edges)
        again = again.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("known"))
        per = again.groupBy("key", "known").agg(F.count("*").alias("n"))
        per = per.groupBy("key").agg(F.max_by("known", F.struct("n", "known")).alias("largest"), F.count("*").alias("n")).filter("n > 1")
        left = checkpointed(again.join(per, "key").select("key", "node", "known", (F.col("known") == F.col("largest")).alias("follows")))
        if not left.limit(1).count():
            break
    return found.select("doc_id", "place", "node").join(_labels(nodes, components(edges) if roots is None else roots, "node"), "node").drop("node")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, **bounds: int) -> DataFrame:
    """docs without those that have an earlier document in their component of near texts; of several rows with its
    first id one stays.  Texts without words are copies of each other."""
    place = F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(text).cast("string"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), place.alias("place"), F.col(text).cast("string").alias("text"))
    found = near_components(rows, shingle, similarity, **bounds)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("place").alias("place"))
    # one key of id and text, so that the join and the search for repeated rows move the texts once
    (key,) = fresh(docs, "key")
    return docs.withColumn(key, place).join(first.select(F.col("place").alias(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (three-word shingles, three bits); null and wordless texts have
    fingerprint zero, and an empty table gives no rows."""
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
