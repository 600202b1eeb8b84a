"""Shards from fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes and rows are summed up for each slot, and a versioned map
deals the slots out to shards: largest slots first, each to the shard with the fewest bytes.  A rebalanced map is a new
version that edits as few slots as needed.  The map has one row for each slot, so its size does not depend on the
data; it is the only thing that passes through the driver.

Defined results.  A null text weighs OVERHEAD bytes.  A slot is a hash of doc_id and text, so that records that share a doc_id, or have none,
are spread; only records equal in both share a slot.  Copies of a text are placed independently of each other: the map balances bytes, law
`bytes`.  In a slot records are in the order of doc_id (null last), checksum and size.  A text of any length is one record.  An empty table gives
no rows.  Only doc_id and the text column are read, so that other columns may have any names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import fresh_path

#: Virtual slots; never changed once data are stored.
SLOTS = 16384
#: Bytes that a record weighs besides its text.
OVERHEAD = 16
_MAP = "version int, slot int, shard int, bytes long, rows long, first long"


def with_slots(docs: DataFrame, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), data), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows): at most one entry for each virtual slot."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r["virtual_slot"], r["bytes"], r["rows"]) for r in got)


def deal(totals: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: largest first, to the lightest shard; ties to the smaller number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(totals, key=lambda t: (-t[1], t[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalance(totals: list[tuple[int, int, int]], owners: dict[int, int], shards: int) -> dict[int, int]:
    """The next version of a map for new totals or another number of shards: slots of shards that are gone, and then the
    smallest sufficient slots of shards above the mean, go to the lightest shards; all others stay."""
    size = {slot: b for slot, b, _ in totals}
    out = {slot: owners[slot] for slot in size if owners.get(slot, shards) < shards}
    load = dict.fromkeys(range(shards), 0)
    for slot, shard in out.items():
        load[shard] += size[slot]
    free = [slot for slot in size if slot not in out]
    mean = sum(size.values()) / shards
    for shard in range(shards):
        for slot in sorted((s for s in out if out[s] == shard), key=lambda s: (size[s], s)):
            if load[shard] - size[slot] < mean:
                break
            load[shard] -= size[slot]
            del out[slot]
            free.append(slot)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda s: (-size[s], s)):
        b, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (b + size[slot], shard))
    return out


def store_map(spark: SparkSession, path: str, version: int, totals: list[tuple[int, int, int]], owners: dict[int, int]) -> None:
    """Adds a version to the map stored at path; storing it again replaces it.  `first` is the place of a slot's first record in its shard."""
    filled: dict[int, int] = {}
    rows = []
    for slot, size, n in totals:
        shard = owners[slot]
        rows.append((version, slot, shard, size, n, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + n
    spark.createDataFrame(rows, _MAP).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default."""
    versions = spark.read.schema(_MAP).parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and place in the shard of each record.  The map is broadcast: one row for each virtual slot at most."""
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size"))
    put = F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard", "first"))
    return records.withColumn("place", place).join(put, "virtual_slot").withColumn("slot", F.col("first") + F.col("place") - 1)


def shard(docs: DataFrame, shards: int, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.  Stores version 0 of the map at path."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "slot-map")
    records = with_slots(docs, text)
    totals = slot_totals(records)
    store_map(spark, path, 0, totals, deal(totals, shards))
    placed = assign(records, read_map(spark, path, 0))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(0).alias("map_version")
    )
