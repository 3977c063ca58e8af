"""Sharding by fixed virtual slots, with DataFrame functions only.

Every record is hashed (document number and text) into one of ``slots`` virtual slots, which never change. A small map says which shard has
which slot; it is kept as a table with a version. The bytes of each slot are summed, and the map is edited: slots move from the largest shard
to the smallest until their sizes are nearly equal (``rebalanced``), or to a new shard (``grown``), which takes slots from the others and moves nothing else. Records of
slots that are not moved stay where they are.

A slot that holds much more than its share in many rows (copies of one record) is split into parts by a second hash that also takes the row's place in the
table of sizes, which is written once; which of those copies goes to which part may change with the layout of the files, all else depends on the records alone. Slots and parts are some thousands whatever the corpus, so the map has a proven size: it is the only thing
broadcast, and its sums are the only thing the driver sees. Places in a shard come from sums over slots, parts and finer buckets, so no task
numbers a whole shard.

Results in odd cases: a null text has no bytes and weighs one; a null ``doc_id`` counts as the smallest number; rows that repeat are placed one by one; a text that is larger than
a shard's share makes its shard larger (rows are never cut), very long texts weigh their bytes; ties go to the smaller slot and shard; an empty table gives no rows and a map; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import given, number, written

SLOTS = 4096
#: A slot of more than a ``HEAVY``-th of a shard is split into parts of about a quarter of that.
HEAVY = 16
#: Moves stop when the largest and the smallest shard differ by no more than this share of the mean.
NEAR = 0.0002
#: Rows that one task numbers in order.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class SlotMap:
    """Shard of each (slot, part), and the version; an edit gives a map of the next version."""

    version: int
    shards: int
    shard: dict[tuple[int, int], int]

    def edited(self, moves: dict[tuple[int, int], int], shards: int | None = None) -> SlotMap:
        return SlotMap(self.version + 1, shards or self.shards, self.shard | moves)

    def table(self, spark: SparkSession) -> DataFrame:
        """``version``, ``slot``, ``part`` and ``shard``."""
        return _table(spark, [(self.version, *e, k) for e, k in sorted(self.shard.items())], "version", "slot", "part", "shard")


def _table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """Whole numbers as a table."""
    text = F.lit(",".join(" ".join(map(str, r)) for r in rows))
    one = spark.range(1).select(F.explode(F.split(text, ",")).alias("e")).select(F.split("e", " ").alias("e"))
    return one.select(*[F.col("e")[i].cast("int").alias(c) for i, c in enumerate(names)])


def first_map(parts: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """The map of version 1: slots dealt in turn, each part after the one before. ``parts``: the number of parts of slots that are split."""
    entries = [(s, p) for s in range(slots) for p in range(parts.get(s, 1))]
    return SlotMap(1, shards, {e: i % shards for i, e in enumerate(entries)})


def _held(slot_map: SlotMap, size: dict[tuple[int, int], int]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Bytes of each shard, and its entries that have some."""
    load, own = [0] * slot_map.shards, [[] for _ in range(slot_map.shards)]
    for e, k in sorted(slot_map.shard.items()):
        if size.get(e, 0):
            load[k] += size[e]
            own[k].append(e)
    return load, own


def rebalanced(slot_map: SlotMap, size: dict[tuple[int, int], int], near: float = NEAR) -> SlotMap:
    """The next version: entries move from the largest shard to the smallest, each time the one that leaves the two nearest to each other."""
    load, own = _held(slot_map, size)
    moves: dict[tuple[int, int], int] = {}
    open_ = list(range(len(load)))  # a shard that no move makes smaller, such as one of a single large entry, is left aside
    while len(open_) > 1:
        high, low = max(open_, key=lambda k: (load[k], -k)), min(open_, key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        if gap <= near * sum(load) / len(load):
            break
        e = min(own[high], key=lambda x: (abs(gap - 2 * size[x]), x))
        pair = (e, None) if size[e] < gap else _exchange(own[high], own[low], size, gap)
        if pair is None:
            open_.remove(high)
            continue
        for x, a, b in ((pair[0], high, low), (pair[1], low, high)):
            if x is not None:
                own[a].remove(x)
                own[b].append(x)
                load[a] -= size[x]
                load[b] += size[x]
                moves[x] = b
    return slot_map.edited(moves)


def _exchange(high: list, low: list, size: dict, gap: int) -> tuple | None:
    """Entries of two shards whose exchange leaves the shards nearest to each other, if one brings them nearer."""
    ordered = sorted(low, key=lambda x: (size[x], x))
    best, found, j = gap, None, 0
    for x in sorted(high, key=lambda x: (size[x], x)):
        while j < len(ordered) and 2 * (size[x] - size[ordered[j]]) > gap:
            j += 1
        for y in ordered[max(0, j - 1) : j + 1]:
            left = abs(gap - 2 * (size[x] - size[y]))
            if left < best:
                best, found = left, (x, y)
    return found


def grown(slot_map: SlotMap, size: dict[tuple[int, int], int]) -> SlotMap:
    """The next version, with one more shard: it takes entries from the largest shards until it has its share; nothing else moves."""
    load, own = _held(slot_map, size)
    moves: dict[tuple[int, int], int] = {}
    share, new = sum(load) / (len(load) + 1), 0
    while new < share:
        fits = ((k, [x for x in own[k] if new + size[x] <= share + size[x] / 2]) for k in sorted(range(len(load)), key=lambda k: -load[k]))
        high, entries = next(((k, x) for k, x in fits if x), (None, None))
        if high is None:
            break
        e = max(entries, key=lambda x: (min(size[x], load[high] - share), x))
        own[high].remove(e)
        load[high] -= size[e]
        new += size[e]
        moves[e] = len(load)
    return slot_map.edited(moves, len(load) + 1)


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size`` (bytes of the text and one), ``text_crc32``, ``slot``, ``salt`` and ``row`` of each row of ``docs(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    name = F.xxhash64(number(), text)
    rows = docs.select(number().alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name.alias("name"))
    rows = rows.select("doc_id", "size", "text_crc32", F.pmod("name", F.lit(slots)).cast("int").alias("slot"), "name", F.monotonically_increasing_id().alias("row"))
    return written(rows.select("doc_id", "size", "text_crc32", "slot", F.xxhash64("name", "row").alias("salt"), "row"), "records")


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> tuple[DataFrame, list[SlotMap]]:
    """``doc_id``, ``size``, ``text_crc32``, ``virtual_slot``, ``part``, ``shard`` and ``place`` (in the shard, from 0) of each row, and the versions of the map.

    The first version deals slots in turn, the second balances their bytes; rows are placed by the second.
    """
    spark = docs.sparkSession
    rows = sized(docs, slots)
    per = rows.groupBy("slot").agg(F.sum("size").alias("size"), F.max("size").alias("most")).collect()  # at most ``slots`` rows
    size = {r["slot"]: r["size"] for r in per}
    limit = max(1, sum(size.values()) // (shards * HEAVY))
    parts = {r["slot"]: -(-4 * r["size"] // limit) for r in per if r["size"] > max(limit, 4 * r["most"])}
    part = F.lit(0)
    if parts:  # such a slot holds more than a fixed share of all bytes, so there are few
        rows = rows.join(F.broadcast(_table(spark, sorted(parts.items()), "slot", "parts")), "slot", "left")
        part = F.coalesce(F.pmod("salt", F.col("parts")), F.lit(0)).cast("int")
    rows = rows.withColumn("part", part)
    own = {(s, 0): n for s, n in size.items()}
    if parts:
        own = {(r["slot"], r["part"]): r["size"] for r in rows.groupBy("slot", "part").agg(F.sum("size").alias("size")).collect()}
    first = first_map(parts, shards, slots)
    maps = [first, rebalanced(first, own)]
    table = written(maps[0].table(spark).unionByName(maps[1].table(spark)).coalesce(1), "slot-map")
    last = table.where(F.col("version") == maps[-1].version).drop("version")
    rows = rows.join(F.broadcast(last), ["slot", "part"])  # at most ``slots`` and some hundred parts
    return _placed(rows), maps


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in their shard: what is before their slot and part, before their bucket, and before them in it."""
    entry = ["shard", "slot", "part"]
    counts = rows.groupBy(*entry).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*entry, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("cuts"))
    rows = rows.join(F.broadcast(starts), entry).withColumn("bucket", F.pmod(F.xxhash64("salt"), F.col("cuts")).cast("int"))
    buckets = rows.groupBy(*entry, "bucket").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*entry).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*entry, "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("skipped"))
    along = Window.partitionBy(*entry, "bucket").orderBy("row")
    rows = rows.withColumn("nth", F.row_number().over(along) - 1).join(buckets, [*entry, "bucket"])
    place = (F.col("start") + F.col("skipped") + F.col("nth")).cast("long")
    return rows.select(given(), "size", "text_crc32", F.col("slot").alias("virtual_slot"), "part", "shard", place.alias("place"))
