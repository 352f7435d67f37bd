"""Sharding by fixed virtual slots, with DataFrame functions only.

A record hashes to one of ``SLOTS`` slots for good. Bytes are added up per slot, slots are dealt to
shards (largest first, each to the shard with the fewest bytes), and the slot-to-shard map is stored
as a versioned table. Rebalancing edits that map: only slots that must move do. The map and the sums
per slot have SLOTS rows whatever the corpus holds, so they may pass through the driver.

Rows that agree in id, size and checksum are counted before they move; copies are dealt in runs of
RUN to CHUNKS chunks in turn, each chunk to the slot of its key and number: a row that fills a third
of the table spreads, and the slots depend on the rows alone, not on how the table is partitioned.

With a ``map_path`` the newest version of the map there is edited for the new sums and stored as the
next one; without, slots are dealt afresh.

A null text has no bytes and the checksum of the empty text; a null id hashes by its text. Within a
shard rows are numbered from 0 without gaps. An empty table gives an empty result; further columns
are left out.
"""

import heapq
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, shared_dir
from aeromosaic.llm.texts import table

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16  # bytes of a record besides its text
RUN, CHUNKS = 64, 4096  # copies of a row are dealt in runs, in turn to so many chunks


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, chunk, copies, virtual_slot): documents, equal rows counted.

    Texts are read once and don't move: only these few numbers are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text).cast("long") + OVERHEAD).alias("size")
    same = ["doc_id", "size", "text_crc32"]
    counted = docs.select("doc_id", size, F.crc32(text).alias("text_crc32")).groupBy(*same).agg(F.count("*").alias("n"))
    chunks = F.expr(f"sequence(0L, least((n - 1) div {RUN}, {CHUNKS - 1}L))")
    turn = RUN * CHUNKS
    last = f"greatest(0, least({RUN}, n % {turn} - chunk * {RUN}))"
    return counted.select(*same, "n", F.explode(chunks).alias("chunk")).select(
        *same, "chunk",
        F.expr(f"n div {turn} * {RUN} + {last}").alias("copies"),
        F.pmod(F.xxhash64(F.xxhash64("doc_id", "text_crc32", "size"), "chunk"), F.lit(slots))
        .cast("int").alias("virtual_slot"),
    )


def slot_sums(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most SLOTS rows, added up before they move."""
    held = F.sum(F.col("size") * F.col("copies"))
    sums = rows.groupBy("virtual_slot").agg(held, F.sum("copies"))
    return sorted(tuple(r) for r in sums.collect())


def deal(sums: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: largest slots first, each to the lightest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    placed = {}
    for slot, size, rows in sorted(sums, key=lambda x: (-x[1], x[0])):
        held, count, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (held + size, count + rows, shard))
    return placed


def rebalance(
    placed: dict[int, int], sums: list[tuple[int, int, int]], shards: int, slack: float = 0.01
) -> dict[int, int]:
    """The map edited for new sums or another number of shards.

    Slots of shards that are gone, then the smallest slots of shards above the mean by more than
    ``slack``, go to the lightest shard; all other slots stay where they are, also those that
    have no rows at present.
    """
    size = {slot: n for slot, n, _ in sums}
    held = dict.fromkeys(range(shards), 0)
    homes: dict[int, list[int]] = {s: [] for s in range(shards)}
    moving = []
    for slot in sorted(size, key=lambda s: (size[s], s)):
        shard = placed.get(slot, -1)
        if 0 <= shard < shards:
            held[shard] += size[slot]
            homes[shard].append(slot)
        else:
            moving.append(slot)
    most = sum(size.values()) / shards * (1 + slack)
    out = {slot: shard for slot, shard in placed.items() if shard < shards}
    for shard, slots in homes.items():
        while held[shard] > most and slots:
            slot = slots.pop(0)
            held[shard] -= size[slot]
            moving.append(slot)
    heap = [(n, s) for s, n in held.items()]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-size[s], s)):
        n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (n + size[slot], shard))
    return out


def store_map(
    spark: SparkSession, path: str, version: int, placed: dict[int, int],
    sums: list[tuple[int, int, int]],
) -> None:
    """Write one version of the map: slot, shard, and the number of the slot's first row there."""
    count = {slot: rows for slot, _, rows in sums}
    first, lines = {}, []
    for slot in sorted(placed):
        shard = placed[slot]
        lines.append(f"{slot}:{shard}:{first.get(shard, 0)}")
        first[shard] = first.get(shard, 0) + count.get(slot, 0)
    part = lambda k, kind: F.try_element_at("entry", F.lit(k)).cast(kind)
    rows = spark.range(1).select(F.explode(F.split(F.lit(",".join(lines)), ",")).alias("line"))
    rows = rows.select(F.split("line", ":").alias("entry")).where(F.size("entry") == 3)
    rows.select(
        part(1, "int").alias("virtual_slot"), part(2, "int").alias("shard"), part(3, "long").alias("first")
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    schema = "virtual_slot int, shard int, first long"
    return spark.read.schema(schema).parquet(f"{path}/version={version:06d}")


def newest_version(spark: SparkSession, path: str) -> int:
    """Number of the last version of the map that was written whole; 0 without any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    found = [0]
    for entry in system.listStatus(folder):
        version = re.fullmatch(r"version=(\d+)", entry.getPath().getName())
        # the one file of a version gets its name when it is complete
        if version and any(f.getPath().getName().startswith("part-") for f in system.listStatus(entry.getPath())):
            found.append(int(version[1]))
    return max(found)


def next_map(
    spark: SparkSession, path: str, sums: list[tuple[int, int, int]], shards: int
) -> DataFrame:
    """The newest map edited for these sums, or a first one, stored as the next version."""
    version = newest_version(spark, path)
    if version:
        before = {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, version).collect()}
        placed = rebalance(before, sums, shards)
    else:
        placed = deal(sums, shards)
    store_map(spark, path, version + 1, placed, sums)
    return load_map(spark, path, version + 1)


def shard(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (row number in the shard)."""
    spark = docs.sparkSession
    rows = settle(records(docs))
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    homes = next_map(spark, path, slot_sums(rows), shards)
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "chunk")
    before = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("first") + F.coalesce("before", F.lit(0))
    numbered = rows.withColumn("before", before).join(homes, "virtual_slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard",
        F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("slot"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    return shard(docs, shards, map_path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
