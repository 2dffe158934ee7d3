"""Sharding by fixed virtual slots and a versioned map from slot to shard.

A record's slot is a hash of its doc_id and text modulo a fixed number of slots
(thousands), so that null or repeated ids do not gather in one slot.  Rows alike in both
that are more, in rows or bytes, than a slot's fair share (at most two such groups a slot)
are spread over the slots one by one.  Bytes are summed per slot.  The map is a table
``version, slot, shard`` in the shared folder; the newest version is read, edited for the
bytes found (slots leave shards above the mean, lightest first, heaviest of those to the
lightest shard) and stored as the next version, by which rows are then placed.  A table
without a version starts from slots dealt in turn.

The law is ``bytes``: shards get nearly equal bytes.  Equal texts may be in different
shards.

Cases: a null text has one byte of size (its row); null ids, repeated ids and repeated rows
count each; an empty table gives an empty one; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.lineage import cut, shared_dir

SLOTS = 4096
SHARDS = 16
MAP_SCHEMA = "version int, slot int, shard int"
#: How far above the mean a shard may stay when the map is edited.
SLACK = 0.0005


def sized(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size in bytes plus one, crc32 of the text and virtual slot of each row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col("doc_id"), text).alias("alike"), F.monotonically_increasing_id().alias("number"),
    )
    # Written, so that a row keeps its number if a task is run again.
    rows = cut(rows, "sized")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    groups = rows.groupBy("alike").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    large = groups.filter((F.col("n") > total["n"] // n_slots) | (F.col("bytes") > (total["bytes"] or 0) // n_slots))
    spread = rows.join(F.broadcast(large.select("alike", F.lit(True).alias("large"))), "alike", "left")  # 2 * n_slots rows at most
    slot = F.pmod(F.when(F.col("large"), F.xxhash64("alike", "number")).otherwise(F.xxhash64("alike")), F.lit(n_slots)).cast("int")
    return spread.select("doc_id", "size", "text_crc32", "number", slot.alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> list[tuple[int, int]]:
    """(slot, bytes) of the slots in use: at most n_slots rows reach the driver."""
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()
    return [(r["virtual_slot"], r["bytes"]) for r in got]


def deal(bytes_by_slot: list[tuple[int, int]], n_shards: int = SHARDS, n_slots: int = SLOTS) -> dict[int, int]:
    """A first map: every slot, heaviest first, to the shard with the fewest bytes."""
    load = [(0, s) for s in range(n_shards)]
    have = dict.fromkeys(range(n_slots), 0) | dict(bytes_by_slot)
    out = {}
    for slot, b in sorted(have.items(), key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + b, shard))
    return out


def rebalance(old: dict[int, int], bytes_by_slot: list[tuple[int, int]], n_shards: int, slack: float = SLACK) -> dict[int, int]:
    """Edit a map for new bytes or another number of shards, moving few slots: those of
    dropped shards, then the lightest slots of shards above (1 + slack) of the mean."""
    have = dict.fromkeys(old, 0) | dict(bytes_by_slot)
    new = {k: v for k, v in old.items() if v < n_shards}
    load = [0] * n_shards
    for slot, shard in new.items():
        load[shard] += have[slot]
    loose = [s for s in have if s not in new]
    most = (1 + slack) * sum(have.values()) / n_shards
    for shard in range(n_shards):
        for slot in sorted((s for s, x in new.items() if x == shard), key=lambda s: (have[s], s)):
            if load[shard] <= most:
                break
            load[shard] -= have[slot]
            del new[slot]
            loose.append(slot)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-have[s], s)):
        total, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (total + have[slot], shard))
    return new


def map_table(spark: SparkSession, slot_map: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, k, v) for k, v in sorted(slot_map.items())], MAP_SCHEMA)


def latest(map_rows: DataFrame) -> tuple[int, dict[int, int]]:
    """Newest version in a table of maps (a map has n_slots rows)."""
    version = map_rows.agg(F.max("version")).first()[0]
    return version, {r["slot"]: r["shard"] for r in map_rows.filter(F.col("version") == version).collect()}


def assign(rows: DataFrame, slot_map: dict[int, int], version: int) -> DataFrame:
    """Shard of each row and its place within the shard, counted without gaps from 0.

    Rows are numbered within virtual slots (small windows); a slot's rows start where
    those of the shard's slots before it end, by a table of n_slots counts.
    """
    spark = rows.sparkSession
    mapped = map_table(spark, slot_map, version).select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(F.broadcast(mapped), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "shard", "map_version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "number")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("start") + F.col("place"))
        .drop("start", "place", "number")
    )


def shard(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row's size, shard and place by the map at map_path (a new one where there is
    none), edited for the bytes found and stored there as its next version."""
    spark = docs.sparkSession
    rows = sized(docs, n_slots)
    path = map_path or f"{shared_dir(spark)}/scanloom-shard-map-{uuid.uuid4().hex}"
    found = stored(spark, path)
    version, slot_map = found or (1, {s: s % n_shards for s in range(n_slots)})
    if len(slot_map) != n_slots:
        raise ValueError(f"the map has {len(slot_map)} slots")
    if not found:
        map_table(spark, slot_map, version).coalesce(1).write.mode("append").parquet(path)
    edited = rebalance(slot_map, slot_bytes(rows), n_shards)
    if edited != slot_map:
        version += 1
        map_table(spark, edited, version).coalesce(1).write.mode("append").parquet(path)
    return assign(rows, edited, version)


def stored(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """Newest version of the map at a path, if there is any."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return latest(spark.read.schema(MAP_SCHEMA).parquet(path))
