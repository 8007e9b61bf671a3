"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. The bytes of each slot are summed, and a versioned table says which shard
holds each slot. Rebalancing edits that table: whole slots move, records never change their slot.

Cases: a null text counts as no bytes; null keys hash like any value, with the text's checksum spreading them; repeated
rows land in one slot and get places of their own there; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stage_path, whole

#: Fixed number of slots: it bounds the map, the sums on the driver and the broadcast.
N_SLOTS = 4096
#: Bytes that a record takes besides its text.
ROW_BYTES = 16
MAP_SCHEMA = "version int, slot int, shard int, n_bytes long, row_base long"


@dataclass(frozen=True)
class Slot:
    slot: int
    n_rows: int
    n_bytes: int


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Key, size, checksum and slot of every record: no shuffle, all in the scan's stage."""
    crc = F.crc32(whole(text).cast("binary"))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole(text)).cast("long") + ROW_BYTES).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(recs: DataFrame) -> list[Slot]:
    """Rows and bytes of each slot that has any: at most as many rows as there are slots reach the driver."""
    got = recs.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return [Slot(r.virtual_slot, r.n, r.b) for r in got]


def first_map(slots: list[Slot], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Version 1: largest slots first, each to the shard with the fewest bytes so far; empty slots go round."""
    load = [(0, 0, s) for s in range(n_shards)]
    heapq.heapify(load)
    held = {s.slot for s in slots}
    out = {s: s % n_shards for s in range(n_slots) if s not in held}
    for s in sorted(slots, key=lambda s: (-s.n_bytes, s.slot)):
        b, n, shard = heapq.heappop(load)
        out[s.slot] = shard
        heapq.heappush(load, (b + s.n_bytes, n + 1, shard))
    return out


def rebalanced(held: dict[int, int], slots: list[Slot], n_shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """The next version of a map: shards above the mean by more than `tolerance` give slots to the emptiest shards.

    Only moves that lower the larger of the two loads are made, so that few slots move and a further shard fills up
    from the others."""
    size = {s.slot: s.n_bytes for s in slots}
    out = {slot: shard if shard < n_shards else slot % n_shards for slot, shard in held.items()}
    load, own = [0] * n_shards, [[] for _ in range(n_shards)]
    for slot, shard in out.items():
        load[shard] += size.get(slot, 0)
        if size.get(slot):
            own[shard].append(slot)
    limit = sum(load) / n_shards * (1 + tolerance)
    for _ in range(len(out)):
        high, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fit = [s for s in own[high] if 2 * size[s] <= gap] or [s for s in own[high] if size[s] < gap]
        if load[high] <= limit or not fit:
            break
        slot = max(fit, key=lambda s: (size[s], -s))
        own[high].remove(slot)
        own[low].append(slot)
        load[high], load[low], out[slot] = load[high] - size[slot], load[low] + size[slot], low
    return out


def store_map(spark: SparkSession, path: str, version: int, held: dict[int, int], slots: list[Slot]) -> None:
    """Append a version of the map, with the first place of each slot's rows within its shard."""
    by, base, rows = {s.slot: s for s in slots}, {}, []
    for slot, shard in sorted(held.items()):
        s = by.get(slot, Slot(slot, 0, 0))
        rows.append((version, slot, shard, s.n_bytes, base.get(shard, 0)))
        base[shard] = base.get(shard, 0) + s.n_rows
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, or the latest."""
    found = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version)


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of each record and its place in the shard, counted without gaps from 0.

    A slot's rows are numbered within the slot; the map has how many rows of the shard come before, so no task ever
    holds a shard. The map has as many rows as there are slots, which bounds the broadcast."""
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    small = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", "row_base", F.col("version").alias("map_version"))
    return (
        recs.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(small), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("row_base") + F.col("place")).alias("slot"), "virtual_slot", "map_version")
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """All documents in shards of near equal bytes, by version 1 of the stored slot map; `next_shard` is the shard by
    version 2, which is edited for one more shard."""
    recs = records(documents(spark, sf_dir))
    slots = slot_sizes(recs)
    path = stage_path(spark, "slot-map")
    first = first_map(slots, n_shards)
    store_map(spark, path, 1, first, slots)
    store_map(spark, path, 2, rebalanced(first, slots, n_shards + 1), slots)
    after = read_map(spark, path, 2).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("next_shard"))
    return assign(recs, read_map(spark, path, 1)).join(F.broadcast(after), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard",
    )
