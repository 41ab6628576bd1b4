"""Sharding over fixed virtual slots.

A record hashes (by id and content) into one of ``n_slots`` virtual slots, for ever.  Bytes
are aggregated per slot; a slot-to-shard map of bounded size (``n_slots`` rows)
is built from these sums, stored with a version, and edited, never rebuilt, when
shards are added or drift apart.  Records move only when their slot's entry does.

Law: ``bytes`` - the shards' byte sums are near equal.

Edge cases: a null text has no bytes and the crc of the empty text; null ids and
repeated ids spread by content, and rows that repeat both by their number among the
equal ones, so that no slot gathers them; equal texts are separate records and need
not share a shard; a very long text is one record; an empty table gives no rows and
an even map.  Columns of the input that are called like a result column are not
carried.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Virtual slots.  More slots even out the shards and spread the final sort.
N_SLOTS = 8192
#: Bytes that a record costs besides its text.
OVERHEAD = 16


def records(docs: DataFrame, scratch: common.Scratch, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record."""
    plain = docs.select("doc_id", (common.text_bytes("text") + OVERHEAD).alias("size"), common.crc32_of("text").alias("text_crc32"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    plain = scratch.save(plain.select("*", key.alias("key"), F.monotonically_increasing_id().alias("row")), "plain")
    equal = plain.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    equal = scratch.save(equal.withColumn("repeated", F.lit(True)), "equal")
    placed = common.join_split(plain, equal, "key", "copies", plain.count(), "left")
    salt = F.when(F.col("repeated"), F.col("row")).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", "row", F.pmod(F.xxhash64("key", salt), F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_sums(recs: DataFrame) -> DataFrame:
    """Rows and bytes per virtual slot; map-side sums leave n_slots rows a task."""
    return recs.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def build_map(sums: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Shard of each slot: largest slot first onto the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda v: (-sums.get(v, 0), v)):
        load, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + sums.get(slot, 0), s))
    return shard


def _best_step(heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int) -> tuple | None:
    """(rest of the gap, slot to move, slot to take back or (0, -1)): what halves the gap best, if anything narrows it."""
    back, best = [(0, -1), *light], None
    for size, slot in heavy:
        at = bisect.bisect_left(back, (size - gap / 2, -1))
        for other in back[max(0, at - 1) : at + 1]:
            left = abs(gap - 2 * (size - other[0]))
            if left < gap and (best is None or left < best[0]):
                best = (left, (size, slot), other)
    return best


def edit_map(shard: list[int], sums: dict[int, int], n_shards: int, tolerance: float = 0.002) -> list[int]:
    """The next version: moves few slots, until all shards are within ``tolerance`` of the mean.

    Shards may have been added; slots of dropped shards move first.  A step moves the
    slot, or swaps the two slots, that evens out the heaviest and lightest shard best.
    """
    shard = list(shard)
    load = [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, s in enumerate(shard):
        if s >= n_shards:
            homeless.append((sums.get(slot, 0), slot))
        else:
            load[s] += sums.get(slot, 0)
            held[s].append((sums.get(slot, 0), slot))

    def put(size: int, slot: int, s: int) -> None:
        shard[slot] = s
        load[s] += size
        held[s].append((size, slot))

    for size, slot in sorted(homeless, reverse=True):
        put(size, slot, min(range(n_shards), key=load.__getitem__))
    mean = sum(load) / n_shards
    held = [sorted(x) for x in held]
    for _ in range(4 * len(shard)):
        by_load = sorted(range(n_shards), key=load.__getitem__)
        low, best = by_load[0], None
        for high in reversed(by_load[1:]):  # the heaviest one that can give something
            gap = load[high] - load[low]
            if gap <= tolerance * mean:
                break
            best = _best_step(held[high], held[low], gap)
            if best is not None:
                break
        if best is None:
            break
        for entry, old, new in ((best[1], high, low), (best[2], low, high)):
            if entry[1] >= 0:
                held[old].remove(entry)
                bisect.insort(held[new], entry)
                load[old] -= entry[0]
                load[new] += entry[0]
                shard[entry[1]] = new
    return shard


def map_table(spark: SparkSession, shard: list[int], sums: dict[int, tuple[int, int]], version: int) -> DataFrame:
    """The map as a table: version, virtual_slot, shard and the slot's base position in its shard."""
    base, rows = {}, []
    for slot, s in enumerate(shard):
        rows.append((version, slot, s, base.get(s, 0)))
        base[s] = base.get(s, 0) + sums.get(slot, (0, 0))[0]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, base long")


def shard_records(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, store: str | None = None, version: int = 1) -> DataFrame:
    """Every record with its shard and gapless position in it.

    ``store`` names a folder for the versioned map; a stored earlier version is
    edited instead of building a new map.  Only the n_slots sums reach the driver,
    and the joined map has n_slots rows: both are bounded by a parameter.
    """
    spark = docs.sparkSession
    recs = records(docs, common.Scratch(spark, "slots"), n_slots)
    sums = {r.virtual_slot: (r.n, r.bytes) for r in slot_sums(recs).collect()}
    sizes = {k: b for k, (_, b) in sums.items()}
    if store and version > 1:
        old = spark.read.parquet(f"{store}/version={version - 1}").orderBy("virtual_slot").collect()
        shard = edit_map([r.shard for r in old], sizes, n_shards)
    else:
        shard = build_map(sizes, n_shards, n_slots)
    entries = map_table(spark, shard, sums, version)
    if store:
        entries.coalesce(1).write.mode("overwrite").parquet(f"{store}/version={version}")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return recs.withColumn("place", place).join(F.broadcast(entries), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 of the map knows no sizes; version 2 is edited from it to even out the bytes."""
    docs = common.table(spark, sf_dir, "documents")
    store = common.Scratch(spark, "op10").path("slot_map")
    even = map_table(spark, [v % 40 for v in range(N_SLOTS)], {}, 1)
    even.coalesce(1).write.mode("overwrite").parquet(f"{store}/version=1")
    return shard_records(docs, 40, store=store, version=2)
