"""Sharding over fixed virtual slots.

A record's slot is a hash of its key and never changes. Bytes are summed per slot, so
whatever the number of records, balancing works on a table of ``slots`` rows (a parameter,
4,096). A slot-to-shard map is stored per version; rebalancing reads one version and writes
the next, in which only slots of too full shards have moved.

Defined cases: a null key hashes as ''; a null text counts 0 bytes and has no checksum; rows
with one key share a slot; fully equal rows get neighbouring places in either order; an empty
table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrail.llm.columns import hash60, utf8_bytes
from daytrail.session import cut_lineage

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hash60(key), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot in use, from rows (vslot, size). At most ``slots`` rows."""
    return records.groupBy("vslot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round robin, before any size is known."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")
    )


def edit_map(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: (vslot, shard, moved).

    Slots are taken by size, largest first (ties: lowest slot). A slot stays in its shard while
    that shard, with it, holds no more than the mean; else it goes to the shard that holds least
    (ties: lowest number). So each shard ends within one slot of the mean, and slots of shards
    that are not too full do not move, nor do empty slots. Works on one array of ``slots`` entries.
    """
    known = current.withColumnRenamed("shard", "was").join(sizes, "vslot", "left")
    known = known.withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    entry = F.struct(-F.col("bytes"), "vslot", "was")
    slots = known.agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.sum("bytes").alias("total")
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<struct<vslot:int,shard:int,moved:boolean>>").alias("placed"),
    )

    def place(state: Column, entry: Column) -> Column:
        loads, was, size = state["loads"], entry["was"], -entry["col1"]
        fits = (F.coalesce(F.get(loads, was), F.lit(0)) + size) * shards <= F.col("total")
        stays = (was < shards) & ((size == 0) | fits)
        least = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        target = F.when(stays, was).otherwise(least)
        return F.struct(
            F.transform(
                loads, lambda load, i: F.when(i == target, load + size).otherwise(load)
            ).alias("loads"),
            F.concat(
                state["placed"],
                F.array(
                    F.struct(
                        entry["vslot"].alias("vslot"),
                        target.alias("shard"),
                        (target != was).alias("moved"),
                    )
                ),
            ).alias("placed"),
        )

    placed = slots.select(F.aggregate("entries", start, place)["placed"].alias("placed"))
    return placed.select(F.inline("placed"))


def publish_map(slot_map: DataFrame, root: str, version: int) -> None:
    """Stores one version. Writing a version again replaces it by the same rows."""
    slot_map.coalesce(1).write.mode("overwrite").parquet(f"{root}/version={version}")


def read_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def places(records: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds each record's shard and its place in that shard, gapless from 0.

    A shard is read slot by slot. Rows are numbered inside their slot, and the rows of the slots
    before it in the shard are added, so no task holds a shard.
    """
    starts = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    mapped = (
        sizes.join(slot_map.select("vslot", "shard"), "vslot")
        .withColumn("start", F.coalesce(F.sum("rows").over(starts), F.lit(0)))
        .select("vslot", "shard", "start")
    )
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(mapped), "vslot")
        .withColumn("slot", F.col("start") + F.col("nth") - 1)
        .drop("nth", "start")
    )


def shard_documents(
    docs: DataFrame, root: str, shards: int = 16, slots: int = SLOTS, version: int = 1
) -> DataFrame:
    """Documents with shard and place; maps are kept under ``root``, one folder a version.

    Version 0 is the round-robin map, ``version`` the one edited to these sizes.
    """
    spark = docs.sparkSession
    records = cut_lineage(
        docs.select(
            "doc_id",
            (utf8_bytes(F.col("text")) + 1).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            slot_of(F.col("doc_id"), slots).alias("vslot"),
        )
    )
    sizes = slot_sizes(records)
    publish_map(first_map(spark, shards, slots), root, 0)
    publish_map(edit_map(sizes, read_map(spark, root, 0), shards), root, version)
    placed = places(records, sizes, read_map(spark, root, version))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
