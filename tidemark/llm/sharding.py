"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, a number that never changes. What
is stored is a small map from slot to shard, in versions: the first deals slots
out in turn, each later one is the one before with some slots moved, so that
the bytes of the shards come out nearly equal while most records stay. Only
counts by slot reach the driver, as many as there are slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.tables import table
from tidemark.session import durable

SLOTS = 4096
SHARDS = 8


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32 and virtual slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slot = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(slots)).cast("int")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("virtual_slot"))


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def edited_map(before: list[int], sizes: list[int], shards: int) -> list[int]:
    """`before` with slots moved, or two exchanged, from the fullest shard to the least full one until no such edit narrows their gap. Each edit makes the loads less unequal, so there is an end."""
    shard = [s if s < shards else s % shards for s in before]
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, s in enumerate(shard):
        held[s].add(slot)
    load = [sum(sizes[x] for x in held[s]) for s in range(shards)]
    while True:
        full, least = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[least]
        # Best: what leaves the gap nearest to zero. A move takes twice a slot's size off it, an exchange twice the difference.
        gives = sorted((sizes[x], x) for x in held[full])
        takes = [(0, -1), *sorted((sizes[x], x) for x in held[least])]
        best, k = (gap, -1, -1), 0
        for size, x in gives:
            while k + 1 < len(takes) and 2 * (size - takes[k + 1][0]) >= gap:
                k += 1
            for j in (k, k + 1, 0):
                if j < len(takes) and 0 < size - takes[j][0] < gap and abs(gap - 2 * (size - takes[j][0])) < best[0]:
                    best = (abs(gap - 2 * (size - takes[j][0])), x, takes[j][1])
        if best[1] < 0:
            break
        _, x, y = best
        for a, b, slot in ((full, least, x), (least, full, y)):
            if slot >= 0:
                held[a].remove(slot)
                held[b].add(slot)
                shard[slot] = b
                load[a] -= sizes[slot]
                load[b] += sizes[slot]
    return shard


def slot_map(placed: DataFrame, slots: int = SLOTS, shards: int = SHARDS, before: DataFrame | None = None) -> DataFrame:
    """The versions of the map: version, virtual_slot, shard, bytes. before: earlier versions, the last of which is edited."""
    spark = placed.sparkSession
    sizes = [0] * slots
    for slot, size in placed.groupBy("virtual_slot").agg(F.sum("size")).collect():
        sizes[slot] = size
    if before is None:
        versions = {1: first_map(slots, shards)}
    else:
        versions = {}
        for version, slot, shard in before.select("version", "virtual_slot", "shard").collect():
            versions.setdefault(version, [0] * slots)[slot] = shard
    last = max(versions)
    versions[last + 1] = edited_map(versions[last], sizes, shards)
    rows = [(v, slot, shard, sizes[slot]) for v, m in sorted(versions.items()) for slot, shard in enumerate(m)]
    return durable(spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long").coalesce(1), "slot-map")


def assign(placed: DataFrame, versions: DataFrame) -> DataFrame:
    """`placed` with shard and slot, the row's place within its shard (from 0, without gaps).

    Places follow virtual slots, and doc_id within each, so a shard is numbered
    by its slots' counts and no task holds a whole shard.
    """
    last = versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0]).select("virtual_slot", "shard")
    counts = placed.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(last, "virtual_slot")
    base = counts.select("virtual_slot", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("place", place).join(base, "virtual_slot").withColumn("slot", (F.col("base") + F.col("place") - 1).cast("long")).drop("base", "place")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; a null text has size 1, a null doc_id a slot of its own hash, and repeated rows places of their own."""
    placed = durable(with_slots(table(spark, sf_dir, "documents")), "placed")
    out = assign(placed, slot_map(placed))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


QUERIES = {"op8_sharding": op8_sharding}
ORACLE: dict[str, str] = {}
