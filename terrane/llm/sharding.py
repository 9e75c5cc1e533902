"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash by doc_id and text into thousands of slots that never change. Bytes
and rows are aggregated for each slot; a map says which shard each slot lives on.
Every edit of the map (balancing by bytes, growing by a shard) starts from the
newest stored version, moves whole slots only, no more than it needs, and makes a
new version; all versions are stored as one table.

The map has at most SLOTS rows for each version, so it may live on the driver and
be broadcast, whatever the input's size. Since the text is part of the hash, rows
that share a doc_id, or have none, spread over slots; only rows equal in both
share one for certain.

Defined results: a null text has no bytes, a null doc_id hashes like any other
value; texts of any length are one record and never cut, so that one larger than a
shard's share leaves its shard too large; repeated rows, and others that tie, take
places of their own in their slot; an empty table gives an empty result; columns
besides doc_id and text are never looked at.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import stage, whole_text

#: Virtual slots; fixed for the life of a store.
SLOTS = 8192
#: Bytes that a record takes besides its text.
HEADER = 16


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: all that placing a record needs."""
    text = whole_text().cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + HEADER).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_loads(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: at most SLOTS rows reach the driver."""
    found = placed.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in found}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1, before anything is known: slots in turn."""
    return [s % shards for s in range(slots)]


def balanced_map(old: list[int], loads: dict[int, int], shards: int, near: float = 0.001) -> list[int]:
    """Next version, near equal in bytes, by moves of slots from the fullest to the emptiest shards.

    Slots on shards that are gone move first. Then, while a shard is off the mean
    by more than `near` of it, the fullest gives the emptiest the slot whose size
    is nearest to half of what they differ by, as long as that brings them nearer.
    A map whose loads have hardly changed is hardly edited.
    """
    new, weight = list(old), [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        if shard < shards:
            weight[shard] += loads.get(slot, 0)
            own[shard].append((loads.get(slot, 0), slot))
    for size, slot in sorted(((loads.get(s, 0), s) for s, k in enumerate(old) if k >= shards), reverse=True):
        to = min(range(shards), key=lambda k: (weight[k], k))
        new[slot] = to
        weight[to] += size
        own[to].append((size, slot))
    for slots in own:
        slots.sort()
    mean = sum(weight) / shards
    for _ in range(4 * len(old)):
        full = max(range(shards), key=lambda k: (weight[k], -k))
        bare = min(range(shards), key=lambda k: (weight[k], k))
        gap = weight[full] - weight[bare]
        if max(weight[full] - mean, mean - weight[bare]) <= near * mean:
            break
        at = bisect.bisect_left(own[full], (gap / 2, 0))
        near_half = [k for k in (at - 1, at) if 0 <= k < len(own[full]) and 0 < own[full][k][0] < gap]
        if not near_half:
            break
        size, slot = own[full].pop(min(near_half, key=lambda k: abs(own[full][k][0] - gap / 2)))
        new[slot] = bare
        bisect.insort(own[bare], (size, slot))
        weight[full] -= size
        weight[bare] += size
    return new


def grown_map(old: list[int], loads: dict[int, int]) -> list[int]:
    """Next version with one more shard, which takes its slots from the heaviest shards.

    No slot moves between old shards.
    """
    shards = max(old) + 1
    weight = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        weight[shard] += loads.get(slot, 0)
        own[shard].append(slot)
    for slots in own:
        slots.sort(key=lambda s: (loads.get(s, 0), s))
    goal, new, got = sum(weight) / (shards + 1), list(old), 0
    heap = [(-w, k) for k, w in enumerate(weight)]
    heapq.heapify(heap)
    while heap and got < goal:
        w, k = heapq.heappop(heap)
        if not own[k]:
            continue
        slot = own[k].pop()
        size = loads.get(slot, 0)
        if got + size > goal * 1.02:
            heapq.heappush(heap, (w, k)) if own[k] else None
            if all(not o or got + loads.get(o[0], 0) > goal * 1.02 for o in own):
                break
            continue
        new[slot], got = shards, got + size
        heapq.heappush(heap, (w + size, k))
    return new


MAP = "version int, vslot int, shard int"


def newest(maps: DataFrame, slots: int = SLOTS) -> tuple[int, list[int]]:
    """The newest version of a stored map: its number and the shard of each slot."""
    rows = maps.filter(F.col("version") == maps.agg(F.max("version")).first()[0]).select("version", "vslot", "shard").collect()
    if sorted(r["vslot"] for r in rows) != list(range(slots)):
        raise ValueError(f"the stored map isn't one of {slots} slots")
    return rows[0]["version"], [r["shard"] for r in sorted(rows, key=lambda r: r["vslot"])]


def with_version(spark: SparkSession, maps: DataFrame | None, version: int, new: list[int]) -> DataFrame:
    """The stored map (version, vslot, shard) with one more version, in the shared folder."""
    rows = spark.createDataFrame([(version, slot, shard) for slot, shard in enumerate(new)], MAP)
    return stage((rows if maps is None else maps.unionByName(rows)).coalesce(1), "slot-map")


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, maps: DataFrame | None = None) -> DataFrame:
    """Each record's shard under the balanced map, and its gapless place in the shard.

    maps: the stored map whose newest version is edited; without one, version 1
    deals the slots in turn and version 2 balances them. A place is the sum of the
    rows of the shard's earlier slots plus the rank in the slot, so that no task
    ever sees more than a slot's records.
    """
    spark = docs.sparkSession
    placed = stage(slotted(docs, slots), "slotted")
    loads = slot_loads(placed)
    if maps is None:
        maps = with_version(spark, None, 1, first_map(shards, slots))
    version, old = newest(maps, slots)
    now = balanced_map(old, {s: b for s, (b, _) in loads.items()}, shards)
    if now != old:
        version += 1
        maps = with_version(spark, maps, version, now)
    used, starts = [0] * shards, []
    for slot, shard in enumerate(now):
        starts.append((slot, used[shard]))
        used[shard] += loads.get(slot, (0, 0))[1]
    current = maps.filter(F.col("version") == version).select("vslot", "shard")
    bounds = spark.createDataFrame(starts, "vslot int, before long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(current.join(F.broadcast(bounds), "vslot")), "vslot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("vslot").alias("virtual_slot"),
            F.lit(version).alias("map_version"),
        )
    )
