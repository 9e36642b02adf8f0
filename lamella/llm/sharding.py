"""Shards through fixed virtual slots.

Records are hashed into a fixed number of slots, several thousand whatever the data. Bytes
are added up per slot, and a small versioned table says which shard holds each slot. The
first version deals the slots in turn; rebalancing edits it, moving slots until shards are
near equal in bytes, and stores the next version beside it. A record's shard is a lookup.

Rows that share id and text would share a slot. Where a slot has many times the mean bytes,
its records are numbered in a written table and hashed again with their number.

What reaches the driver is one row per slot. Texts are not shuffled, only ids and sizes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.rows import hold
from lamella.session import work_dir


@dataclass(frozen=True)
class Slots:
    """Shards, slots per record hash, and the fixed bytes that each record counts besides its text; when a slot is hot."""

    shards: int = 40
    slots: int = 8192
    overhead: int = 16
    hot: float = 8.0  # times the mean bytes of a slot


DEFAULT = Slots()


def virtual_slot(slots: int, doc_id: str = "doc_id", checksum: str = "text_crc32") -> Column:
    """Slot of a record. The checksum spreads rows that share an id, or have none."""
    return F.pmod(F.xxhash64(doc_id, checksum), F.lit(slots)).cast("int")


def dealt(slots: int, shards: int) -> list[int]:
    """The first version: slots in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(shard_of: list[int], sizes: list[int], shards: int, tolerance: float = 0.001) -> list[int]:
    """Edit a map until no single move or exchange of slots narrows the widest gap.

    ``sizes`` has the bytes of each slot. In each step the fullest shard gives the slot, or
    exchanges the pair of slots, that comes nearest to halving its gap to the emptiest.
    Stops within ``tolerance`` of the mean. Other slots stay where they are.
    """
    shard_of = list(shard_of)
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].append(slot)
    load = [sum(sizes[s] for s in slots) for slots in held]
    mean = sum(load) / shards
    for _ in range(4 * len(shard_of)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        if gap <= tolerance * mean or not held[high]:
            break
        half = gap / 2
        giving = sorted((s for s in held[high] if sizes[s]), key=sizes.__getitem__)
        taking = sorted(held[low], key=sizes.__getitem__)
        best, at = (abs(half), None, None), 0
        for s in giving:
            best = min(best, (abs(sizes[s] - half), s, None), key=lambda x: x[0])
            while at < len(taking) and sizes[taking[at]] < sizes[s] - half:
                at += 1
            for t in taking[max(0, at - 1) : at + 1]:
                best = min(best, (abs(sizes[s] - sizes[t] - half), s, t), key=lambda x: x[0])
        if best[1] is None:
            break
        for slot, a, b in ((best[1], high, low), (best[2], low, high)):
            if slot is not None:
                held[a].remove(slot)
                held[b].append(slot)
                load[a] -= sizes[slot]
                load[b] += sizes[slot]
                shard_of[slot] = b
    return shard_of


def slot_map(spark: SparkSession, shard_of: list[int], first: list[int], version: int) -> DataFrame:
    """version, virtual_slot, shard, first: one row per slot."""
    rows = F.from_json(F.lit(json.dumps(list(zip(shard_of, first)))), "array<array<bigint>>")
    return spark.range(1).select(F.posexplode(rows).alias("virtual_slot", "of")).select(
        F.lit(version).alias("version"), "virtual_slot", F.col("of")[0].cast("int").alias("shard"), F.col("of")[1].alias("first")
    )


def _slot_sizes(records: DataFrame, how: Slots) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot."""
    sizes, rows = [0] * how.slots, [0] * how.slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        sizes[r.virtual_slot], rows[r.virtual_slot] = r.bytes, r["rows"]
    return sizes, rows


def shard_documents(docs: DataFrame, how: Slots = DEFAULT, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is ``bytes``: shards are near equal in bytes, as far as whole slots allow.
    ``slot`` numbers the rows of a shard from 0 without gaps: the place at which its virtual
    slot begins, from the map, and the row's place there by id, checksum and size.
    ``grown_shard`` is null. A null text has no bytes and checksum 0; null ids and repeated
    rows are records like any other. The versions of the map are stored below ``map_path``,
    by default a new folder of the shared one.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    records = docs.select("doc_id", (F.octet_length(text) + how.overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    records = records.withColumn("virtual_slot", virtual_slot(how.slots))
    sizes, rows = _slot_sizes(records, how)
    hot = [slot for slot, size in enumerate(sizes) if size > how.hot * sum(sizes) / how.slots]
    if hot:
        numbered = records.withColumn("number", F.monotonically_increasing_id())
        again = F.pmod(F.xxhash64("doc_id", "text_crc32", "number"), F.lit(how.slots)).cast("int")
        spread = F.when(F.col("virtual_slot").isin(hot), again).otherwise(F.col("virtual_slot"))
        records = hold(numbered.withColumn("virtual_slot", spread).drop("number"), "records")
        sizes, rows = _slot_sizes(records, how)

    def starts(shard_of):
        filled, out = [0] * how.shards, []
        for slot, shard in enumerate(shard_of):
            out.append(filled[shard])
            filled[shard] += rows[slot]
        return out

    path = map_path or work_dir(spark, "slot-map")
    versions = [dealt(how.slots, how.shards)]
    versions.append(rebalanced(versions[0], sizes, how.shards))
    for number, shard_of in enumerate(versions, 1):
        slot_map(spark, shard_of, starts(shard_of), number).coalesce(1).write.parquet(f"{path}/version={number}")
    current = spark.read.parquet(f"{path}/version={len(versions)}").withColumnRenamed("version", "map_version")

    # numbers within a slot; a window per slot, of which there are thousands
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(current), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
