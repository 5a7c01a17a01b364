"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of virtual slots. Bytes are summed for each slot,
and a map from slots to shards is made, stored with a version and edited when
shards are added or sizes drift. Everything that touches rows is DataFrame
code; the driver only sees one row for each virtual slot.
"""

from __future__ import annotations

import bisect
import heapq
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import literals, new_path, staged, text_or_empty

#: Equal rows are dealt in lots of so many, each with its own virtual slot.
LOT = 64


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. ``shards[i]`` is the shard of slot ``i``."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def rebalanced(self, weights: list[int], n_shards: int | None = None, slack: float = 0.001) -> SlotMap:
        """The next version: an edited map, with slots moved only as far as needed.

        Slots leave the heaviest shard, largest fitting slot first, for the
        lightest one, until no shard is over the mean by more than ``slack`` of
        the mean or no move helps; then slots of the two are exchanged as long
        as that helps.
        """
        n_shards = n_shards or self.n_shards
        if n_shards < self.n_shards:
            raise ValueError("a map is edited towards as many shards or more")
        shards, loads = list(self.shards), [0] * n_shards
        held: list[set[int]] = [set() for _ in range(n_shards)]
        for slot, shard in enumerate(shards):
            loads[shard] += weights[slot]
            held[shard].add(slot)
        mean = sum(loads) / n_shards

        def move(slot: int, source: int, target: int) -> None:
            held[source].remove(slot)
            held[target].add(slot)
            shards[slot] = target
            loads[source] -= weights[slot]
            loads[target] += weights[slot]

        for _ in range(4 * len(shards)):
            high, low = max(range(n_shards), key=loads.__getitem__), min(range(n_shards), key=loads.__getitem__)
            if loads[high] <= mean * (1 + slack) and loads[low] >= mean * (1 - slack):
                break
            # moving a weight of w makes the gap between the two 2 * w less
            gap = min(loads[high] - mean, mean - loads[low])
            half = (loads[high] - loads[low]) // 2
            fit = [s for s in held[high] if 0 < weights[s] <= max(gap, half)]
            if fit:
                move(max(fit, key=lambda s: (weights[s], s)), high, low)
                continue
            light = sorted((weights[s], s) for s in held[low])
            best = None
            for s in held[high]:
                at = bisect.bisect_left(light, (weights[s] - half, -1))
                if at < len(light) and 0 < (less := weights[s] - light[at][0]) and (best is None or less > best[0]):
                    best = (less, s, light[at][1])
            if best is None:
                break
            move(best[1], high, low)
            move(best[2], low, high)
        return replace(self, version=self.version + 1, n_shards=n_shards, shards=tuple(shards))


def first_map(weights: list[int], n_shards: int) -> SlotMap:
    """Version 1: the heaviest slots first, each to the shard with the least weight so far."""
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        load, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return SlotMap(1, n_shards, tuple(shards))


def map_frame(spark: SparkSession, slot_map: SlotMap, weights: list[int]) -> DataFrame:
    """The map as rows (version, n_shards, virtual_slot, shard, bytes)."""
    shards, sizes = literals(slot_map.shards, "int"), literals(weights, "long")
    slot = F.col("id").cast("int")
    return spark.range(len(slot_map.shards)).select(
        F.lit(slot_map.version).alias("version"),
        F.lit(slot_map.n_shards).alias("n_shards"),
        slot.alias("virtual_slot"),
        F.element_at(shards, slot + 1).alias("shard"),
        F.element_at(sizes, slot + 1).alias("bytes"),
    )


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def store_map(spark: SparkSession, slot_map: SlotMap, weights: list[int], path: str) -> None:
    """Writes this version beside the earlier ones, which stay readable; an error if the version exists.

    A file made only if it is not there yet claims the version, so of two
    writers of one version one gets the error. A version is read once it is
    complete; a claim without one is that of a writer that failed.
    """
    files, _ = _file_system(spark, path)
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claim-{slot_map.version}")
    if not files.createNewFile(claim):
        raise FileExistsError(f"version {slot_map.version} of the map at {path} exists or is being written")
    map_frame(spark, slot_map, weights).coalesce(1).write.mode("error").parquet(f"{path}/v{slot_map.version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the map, in order; none if nothing is stored."""
    files, at = _file_system(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v[0-9]+", n) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The newest stored map, or the given version."""
    version = versions(spark, path)[-1] if version is None else version
    rows = spark.read.parquet(f"{path}/v{version}").select("version", "virtual_slot", "shard", "n_shards").collect()  # one row a slot
    by_slot = {r.virtual_slot: r.shard for r in rows}
    return SlotMap(rows[0].version, rows[0].n_shards, tuple(by_slot[i] for i in range(len(by_slot))))


def lots(docs: DataFrame, n_slots: int) -> DataFrame:
    """Lots of up to LOT equal rows: doc_id, size, text_crc32, lot, copies, virtual_slot.

    Equal rows are counted before they move, so a row that makes up a third of
    the table is one row here; its lots then hash into different slots.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT).cast("long"))))
        .withColumn("copies", F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT))
        .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "lot"), F.lit(n_slots)).cast("int"))
        .drop("n")
    )


def weigh(lots_table: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot: n_slots rows at most reach the driver."""
    sums = lots_table.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("r")).collect()
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in sums:
        sizes[r.virtual_slot], counts[r.virtual_slot] = int(r.b), int(r.r)
    return sizes, counts


def shard_documents(docs: DataFrame, *, n_shards: int = 16, n_slots: int = 4096, map_path: str | None = None) -> DataFrame:
    """Deals all documents into shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1; a null text counts as empty),
    text_crc32, shard, slot (place in the shard, gapless from 0), virtual_slot
    and map_version. The first map is made from the rows of each slot and
    stored; the newest stored map is then edited by the bytes of each slot,
    stored as the next version, and read back for use. Without ``map_path``
    the maps are stored in a new folder of the application.

    Null ids and texts are values like others; equal rows are interchangeable
    and may land in different shards; an empty table gives an empty result;
    other columns are not read. A single text is never cut, so one text larger
    than its shard's share makes that shard larger.
    """
    spark = docs.sparkSession
    held = staged(lots(docs, n_slots), "shard-lots")
    weights, counts = weigh(held, n_slots)
    map_path = map_path or new_path(spark, "shard-maps")
    if not versions(spark, map_path):
        store_map(spark, first_map(counts, n_shards), counts, map_path)
    store_map(spark, load_map(spark, map_path).rebalanced(weights, n_shards), weights, map_path)
    slot_map = load_map(spark, map_path)
    start, filled = [0] * n_slots, [0] * n_shards
    for s, shard in enumerate(slot_map.shards):
        start[s], filled[shard] = filled[shard], filled[shard] + counts[s]
    slot = F.col("virtual_slot") + 1
    lookup = lambda values, kind: F.element_at(literals(values, kind), slot)
    before = F.sum("copies").over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    return (
        held.withColumn("first", before + lookup(start, "long"))
        .withColumn("shard", lookup(slot_map.shards, "int"))
        .withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", F.lit(slot_map.version).alias("map_version"))
    )


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
