"""Operator 6, sharding: fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import places, stage, table
from rolecall.llm.registry import query
from rolecall.session import shared_path

SLOTS = 4096
SHARDS = 16


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each row.

    The slot comes from the whole record, so that neither a null key nor a common text fills one
    slot. Size is the text's UTF-8 bytes (null: none) plus 1.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32")
    )
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """Version 1 of a map, made before any data is known: slots are dealt out in turn."""
    return np.arange(slots) % shards


def rebalance(shard_of: np.ndarray, slot_bytes: np.ndarray, shards: int) -> np.ndarray:
    """The next version of a map: slots move, or two change places, until no such edit evens out the shards.

    Also takes in added shards: they start empty, and slots move into them. Each edit takes what is
    closest to half the difference between the fullest and the emptiest shard, so few slots move.
    """
    shard_of = shard_of.copy()
    while True:
        loads = np.bincount(shard_of, weights=slot_bytes, minlength=shards)
        high, low = int(loads.argmax()), int(loads.argmin())
        gap = loads[high] - loads[low]
        give = np.flatnonzero((shard_of == high) & (slot_bytes > 0))
        back = np.append(np.flatnonzero((shard_of == low) & (slot_bytes > 0)), -1)
        net = slot_bytes[give][:, None] - np.where(back < 0, 0, slot_bytes[back])[None, :]
        off = np.where((net > 0) & (net < gap), np.abs(net - gap / 2), np.inf)
        if not off.size or not np.isfinite(off.min()):
            return shard_of
        i, j = np.unravel_index(int(off.argmin()), off.shape)
        shard_of[give[i]] = low
        if back[j] >= 0:
            shard_of[back[j]] = high


def store_map(spark: SparkSession, folder: str, version: int, shard_of: np.ndarray) -> None:
    """Write one version of the map below ``folder``; earlier versions stay readable."""
    rows = [(slot, int(shard)) for slot, shard in enumerate(shard_of)]
    frame = spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1)
    frame.write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A stored version: one row per slot, so its size is the number of slots whatever the data."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, virtual_slot, map_version`` of each row, shards near equal in bytes.

    Version 1 of the map deals out slots in turn; bytes are summed per slot and version 2 is the
    edited map. ``slot`` is the row's place in its shard, gapless from 0, in order of virtual slot,
    then id and checksum. Null texts count 1 byte, equal rows are interchangeable, and other columns
    are ignored; an empty table stays empty. A record larger than a shard's share stays whole.
    """
    spark = docs.sparkSession
    rows = stage(slotted(docs, slots=slots), "slots")
    slot_bytes = np.zeros(slots)
    for row in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():  # a row per slot at most
        slot_bytes[row["virtual_slot"]] = row["bytes"]
    folder = shared_path(spark, "slot-map")
    store_map(spark, folder, 1, first_map(slots, shards))
    store_map(spark, folder, 2, rebalance(first_map(slots, shards), slot_bytes, shards))
    mapped = rows.join(F.broadcast(read_map(spark, folder, 2)), "virtual_slot")
    placed = places(mapped, ["shard"], F.col("virtual_slot"), slots, ["doc_id", "text_crc32", "size"], "slot")
    return placed.withColumn("map_version", F.lit(2))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``; the shard count does not grow under it, so ``grown_shard`` is null."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
