"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents are linked through hubs: a pair of documents is a hub of two, a group of
equal texts one of many, so no pairs are made.  Every linked document starts in a
shard by its hash.  In a round

  * each hub counts its documents by shard, and each document adds up the counts of
    its hubs;
  * a document wants to move to the shard with the most of its neighbours that has
    room.  Documents of a shard that is full leave it for their neighbours elsewhere,
    unless they belong to a hub of more than GRAIN of a shard, which has to be split
    in any case;
  * what wants to move from one shard to another is noted by gain and hash, and the
    quotas, which let no shard grow beyond its capacity, allow the first part of it.
    A hub's documents share a hash, so they go together, but for those large hubs.

The rounds end when nothing wants to move.  Shards that are over the mean then give up a part,
as do hubs that the quotas have parted; this and all documents without links fill the shards up: they are summed in bins
by size and hash, and the bins go, largest first, to the shard that has the least.

The driver gets sums by shards and by bins, of which there is a fixed number, and
never rows.  Hubs of over a thousandth of all documents, of which there are less than
a thousand, join by broadcast, so none of them is one task; all other joins are by
document or by smaller hubs.  Rounds are kept as checkpoints.

Cases: a document without links, or whose hub has no other, is placed by size alone;
one that is larger than a shard's share makes its shard the largest; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from girder.llm.shared import checkpointed, table

SHARDS, ROUNDS = 8, 16
#: Part of a shard from which on a hub may be split, part of all documents from which on it joins by broadcast.
GRAIN, HOT = 1 / 16, 1 / 1000
#: Part of its capacity that a shard must have free to be moved to.
ROOM = 1 / 32
#: Hash bins of what moves, of what fills up, and of places in a shard.
MOVE_BINS, FILL_BINS, SLOT_BINS = 256, 1024, 1024
#: Votes are counted in steps, and less than a step is a hash, below NOISE for each hub, so that a hub's documents agree on
#: ties.
STEP, NOISE = 1 << 20, 1 << 10


def _bin(x: Column, n: int, use: str) -> Column:
    """One of n bins by hash; each use has hashes of its own."""
    return F.pmod(F.xxhash64(x, F.lit(use)), F.lit(n)).cast("int")


def by_hub(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows joined with hubs by hub (and hot, which marks the same hubs on both sides)."""
    hot = rows.filter("hot").join(F.broadcast(hubs.filter("hot").drop("hot")), "hub")
    return hot.unionByName(rows.filter("NOT hot").join(hubs.filter("NOT hot").drop("hot"), "hub"))


def linked(items: DataFrame, links: DataFrame, n_items: int, share: float) -> DataFrame:
    """(node, spread, size, hub, hot, wide) of links (node, hub) whose hub has several documents."""
    rows = items.join(links.distinct(), "node")
    counts = rows.groupBy("hub").agg(F.count("*").alias("members"), F.sum("size").alias("bytes")).filter("members > 1")
    counts = checkpointed(counts.select("hub", (F.col("members") > max(32, int(n_items * HOT))).alias("hot"), (F.col("bytes") > share * GRAIN).alias("wide")))
    hot = F.broadcast(counts.filter("hot"))
    cold = rows.join(hot, "hub", "left_anti").join(counts.filter("NOT hot"), "hub")
    return rows.join(hot, "hub").unionByName(cold)


def quotas(wanted: dict[tuple[int, int], int], loads: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """How much may move from shard to shard so that none is over its capacity after all moves."""
    allowed = {k: float(v) for k, v in wanted.items()}
    for _ in range(200):
        flow = [0.0] * len(loads)
        into = [0.0] * len(loads)
        for (a, b), x in allowed.items():
            flow[a] -= x
            flow[b] += x
            into[b] += x
        over = {j for j in range(len(loads)) if into[j] > 0 and loads[j] + flow[j] > capacity + 1}
        if not over:
            return allowed
        for (a, b), x in allowed.items():
            if b in over:
                allowed[a, b] = x * max(0.0, 1 - (loads[b] + flow[b] - capacity) / into[b])
    # what still doesn't fit without counting on moves out of a shard stays
    into = [sum(x for (_, b), x in allowed.items() if b == j) for j in range(len(loads))]
    return {(a, b): x * min(1.0, max(0.0, capacity - loads[b]) / into[b]) if into[b] else 0.0 for (a, b), x in allowed.items()}


def wishes(state: DataFrame, n: int, open_: list[int]) -> DataFrame:
    """(node, size, label, target, rank) of each linked document; rank orders moves by gain, then by hash."""
    profile = state.groupBy("hub", "hot", "label").agg((F.count("*") * STEP + F.pmod(F.xxhash64("hub", "label"), F.lit(NOISE))).alias("votes"))
    profile = profile.groupBy("hub", "hot").agg(F.map_from_entries(F.collect_list(F.struct("label", "votes"))).alias("votes"))
    votes = by_hub(state, profile)
    per_shard = [F.sum(F.coalesce(F.element_at("votes", F.lit(i)), F.lit(0))).alias(f"v{i}") for i in range(n)]
    own = votes.groupBy("node").agg(F.max("size").alias("size"), F.max("spread").alias("spread"), F.max("label").alias("label"), F.min("hub").alias("lead"), F.max("wide").alias("wide"), F.count("*").alias("hubs"), *per_shard)
    own = own.withColumn("all", F.array(*[F.struct(F.col(f"v{i}").alias("votes"), F.lit(i).alias("shard")) for i in range(n)]))
    choices = F.filter("all", lambda s: s["shard"].isin(open_) & (s["shard"] != F.col("label")) & (s["votes"] > 0)) if open_ else F.filter("all", lambda s: F.lit(False))
    # a document votes for its own shard, once and not in each of its hubs
    here = (F.element_at("all", F.col("label") + 1)["votes"] - (F.col("hubs") - 1) * STEP).alias("here")
    best = F.array_max(choices)
    others = F.exists("all", lambda s: (s["shard"] != F.col("label")) & (s["votes"] > 0))
    free = F.element_at(F.array(*[F.lit(i) for i in open_]), _bin(F.col("lead"), len(open_), "free") + 1) if open_ else F.col("label")
    stays = F.col("wide") | F.col("label").isin(open_) if open_ else F.lit(True)
    target = F.when(~others, F.col("label")).when(stays & (best.isNull() | (here >= best["votes"])), F.col("label")).otherwise(F.coalesce(best["shard"], free))
    own = own.select("node", "size", "spread", "label", "lead", "wide", here, F.coalesce(best["votes"], F.lit(0)).alias("there"), target.alias("target"))
    gain = F.floor(F.log2(F.greatest(F.lit(0), F.floor((F.col("there") - F.col("here")) / STEP)) + 1)).cast("int")
    return own.select("node", "size", "label", "target", ((63 - gain) * MOVE_BINS + _bin(F.when(F.col("wide"), F.col("spread")).otherwise(F.col("lead")), MOVE_BINS, "move")).alias("rank"))


def sums(df: DataFrame, n: int) -> list[int]:
    out = [0] * n
    for r in df.groupBy("label").agg(F.sum("size").alias("size")).collect():
        out[r.label] = r.size
    return out


def propagated(rows: DataFrame, n: int, share: float, rounds: int) -> DataFrame:
    """(node, spread, size, label, hub, wide) of linked rows after the rounds."""
    state = checkpointed(rows.withColumn("label", _bin(F.col("spread"), n, "start")))
    loads = sums(state.dropDuplicates(["node"]), n)
    capacity = max(share, 1.05 * sum(loads) / n)
    full: set[int] = set()
    for _ in range(rounds):
        wish = checkpointed(wishes(state, n, [i for i in range(n) if i not in full and capacity - loads[i] > capacity * ROOM]))
        moves = checkpointed(wish.filter("label != target").groupBy("label", "target", "rank").agg(F.sum("size").alias("size")))
        wanted = {(r.label, r.target): r.size for r in moves.groupBy("label", "target").agg(F.sum("size").alias("size")).collect()}
        allowed = [(*k, x) for k, x in quotas(wanted, loads, capacity).items() if x > 0]
        spark = rows.sparkSession
        limit = spark.createDataFrame(allowed, "label int, target int, most double")
        running = F.sum("size").over(Window.partitionBy("label", "target").orderBy("rank"))
        last = moves.withColumn("running", running).join(F.broadcast(limit), ["label", "target"]).filter("running <= most")
        last = [tuple(r) for r in last.groupBy("label", "target").agg(F.max("rank"), F.max("running")).collect()]
        # a shard that has too little room for any part of what wants to come counts as full
        closed = {b for _, b in wanted} - {r[1] for r in last}
        if not last and not closed:
            break
        full |= closed
        accepted = spark.createDataFrame([r[:3] for r in last], "label int, target int, last int")
        chosen = wish.join(F.broadcast(accepted), ["label", "target"], "left").filter(F.col("rank") <= F.col("last")).select("node", F.col("target").alias("moved"))
        state = checkpointed(state.join(chosen, "node", "left").withColumn("label", F.coalesce("moved", "label")).drop("moved"))
        for a, b, _, size in last:
            loads[a] -= size
            loads[b] += size
    return state


def shards(items: DataFrame, links: DataFrame, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of items (node, spread, size): node is unique, spread a hash of what the item is, so that results don't
    depend on the order of rows.  links has rows (node, hub)."""
    n_items, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / n
    state = propagated(linked(items, links, n_items, share), n, share, rounds)
    unit = F.when(F.max("wide"), F.max("spread")).otherwise(F.min("hub"))
    node = state.groupBy("node").agg(F.max("size").alias("size"), F.max("label").alias("label"), unit.alias("unit"), F.max("wide").alias("wide"), F.count("*").alias("hubs"))
    placed = checkpointed(node.withColumn("bin", _bin(F.col("unit"), FILL_BINS, "fill")))
    # documents that have one hub only, and one that need not be split, but that quotas have parted
    parted = placed.filter("NOT wide").groupBy("unit").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("hubs").alias("hubs"))
    parted = parted.filter("a < b AND hubs = 1").select("unit")
    whole = placed.join(parted, "unit", "left_anti")
    # shards above the mean give up a part, in order of hashes
    parts = whole.groupBy("label", "bin").agg(F.sum("size").alias("size"))
    own: dict[int, list[tuple[int, int]]] = {}
    for r in parts.collect():
        own.setdefault(r.label, []).append((r.bin, r.size))
    loads, freed = [0] * n, []
    for label, bins in own.items():
        loads[label] = sum(size for _, size in bins)
        for b, size in sorted(bins):
            if loads[label] <= share:
                break
            loads[label] -= size
            freed.append((label, b))
    spark = items.sparkSession
    free = F.broadcast(spark.createDataFrame(freed, "label int, bin int"))
    kept = whole.join(free, ["label", "bin"], "left_anti").select("node", F.col("label").alias("shard"))
    loose = whole.join(free, ["label", "bin"], "left_semi").unionByName(placed.join(parted, "unit", "left_semi")).select("node", "size", "bin")
    loose = loose.unionByName(items.join(placed, "node", "left_anti").select("node", "size", _bin(F.col("spread"), FILL_BINS, "fill").alias("bin")))
    loose = checkpointed(loose.withColumn("class", F.floor(F.log2("size")).cast("int")))
    least = [(load, i) for i, load in enumerate(loads)]
    heapq.heapify(least)
    filled = []
    for r in sorted(loose.groupBy("class", "bin").agg(F.sum("size").alias("size")).collect(), key=lambda r: (-r.size, r.bin, r["class"])):
        load, i = heapq.heappop(least)
        filled.append((r["class"], r.bin, i))
        heapq.heappush(least, (load + r.size, i))
    to = spark.createDataFrame(filled, T.StructType([T.StructField(c, T.IntegerType()) for c in ("class", "bin", "shard")]))
    return kept.unionByName(loose.join(F.broadcast(to), ["class", "bin"]).select("node", "shard"))


def slotted(rows: DataFrame, order: list[str], spread: str = "spread") -> DataFrame:
    """rows (shard, ...) with slot, their place in the shard from 0 on: by bins of hashes, then by order."""
    rows = rows.withColumn("slot_bin", _bin(F.col(spread), SLOT_BINS, "slot"))
    counts = rows.groupBy("shard", "slot_bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slot_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slot_bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "slot_bin").orderBy(*order))
    # a row for each bin of a shard
    return rows.withColumn("number", number).join(F.broadcast(starts), ["shard", "slot_bin"]).withColumn("slot", F.col("first") + F.col("number") - 1).drop("first", "number", "slot_bin")


def equal_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, doc_id, spread, hub, size, text_crc32) of documents: hub is a hash of the text, size its bytes and one more."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hub"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = checkpointed(rows.withColumn("spread", F.xxhash64(F.col("doc_id").cast("string"), "hub")))
    # only rows that are there several times need their place to be told apart
    twice = rows.groupBy("spread").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    return rows.withColumn("spread", F.xxhash64("spread", "node")) if twice else rows


def op12_balanced_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and place of every document, equal texts together, shards of even size in bytes; a null text has size 1, and
    an empty table gives no rows."""
    rows = equal_texts(table(spark, sf_dir, "documents"))
    found = checkpointed(rows.join(shards(rows.select("node", "spread", "size"), rows.select("node", "hub")), "node"))
    out = slotted(found, ["doc_id", "text_crc32", "node"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
