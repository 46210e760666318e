"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots. Only the bytes of each slot are gathered (a few
thousand numbers, whatever the input), and a small map, kept in versions, says which shard holds which slot.
Rebalancing edits that map: the slots of the records never change, so what moves is whole slots.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellwise.llm.common import fresh_path

#: Virtual slots; the slot map has as many entries.
SLOTS = 8192
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """The shard of each virtual slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def balanced(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far (then the fewest slots)."""
        heap = [(0, 0, shard) for shard in range(shards)]
        shard_of = [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
            load, held, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + slot_bytes.get(slot, 0), held + 1, shard))
        return SlotMap(1, shards, tuple(shard_of))

    def grown(self, slot_bytes: dict[int, int]) -> SlotMap:
        """One more shard: each old shard hands slots to it until the new one has its share; no other slot moves.

        A shard gives a slot only if it keeps its share and the new one gets no more than its own; where a few slots hold
        most bytes, the new shard stays that much smaller.
        """
        new = self.shards
        shard_of, load = list(self.shard_of), [0] * (new + 1)
        held: dict[int, list[tuple[int, int]]] = {}
        for slot, shard in enumerate(shard_of):
            load[shard] += slot_bytes.get(slot, 0)
            held.setdefault(shard, []).append((slot_bytes.get(slot, 0), slot))
        target = sum(load) / (new + 1)
        for slots in held.values():
            slots.sort(reverse=True)
        for shard in sorted(held, key=lambda s: -load[s]):
            for size, slot in held[shard]:
                if size and load[shard] - size >= target and load[new] + size <= target:
                    shard_of[slot] = new
                    load[shard] -= size
                    load[new] += size
        return SlotMap(self.version + 1, new + 1, tuple(shard_of))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Adds this version to the folder; earlier versions stay."""
        row = json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of})
        spark.range(1).select(F.lit(row).alias("value")).write.mode("errorifexists").text(f"{folder}/v{self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        row = json.loads(spark.read.text(f"{folder}/v{version}").first()["value"])
        return SlotMap(row["version"], row["shards"], tuple(row["shard_of"]))

    def column(self, slot: Column) -> Column:
        """The shard of a slot."""
        return looked_up(self.shard_of, slot).cast("int")


def looked_up(values: list[int] | tuple[int, ...], slot: Column) -> Column:
    """A slot's value in a constant array of SLOTS numbers: no join."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), slot.cast("int") + 1)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row; the text itself goes no further.

    A null text has the bytes of none and the CRC of the empty string. The slot is a hash of id and text, so a
    hot id or a text with many copies under several ids spreads over the slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(SLOTS)).cast("int").alias("vslot"),
    )


def slot_totals(rows: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows of each virtual slot, in one aggregate: at most SLOTS rows reach the driver."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r["vslot"]: r["bytes"] for r in found}, {r["vslot"]: r["n"] for r in found}


def assign(rows: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Adds shard and slot, the gapless place of a row in its shard; counts: rows of each virtual slot.

    A row's place is the number of rows in its shard's earlier virtual slots plus its place in its own, so no task
    ever holds a shard: the widest window is one virtual slot.
    """
    first, before = [], [0] * slot_map.shards
    for vslot, shard in enumerate(slot_map.shard_of):
        first.append(before[shard])
        before[shard] += counts.get(vslot, 0)
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    slot = looked_up(first, F.col("vslot")) + place - 1
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), slot_map.column(F.col("vslot")).alias("shard"), slot.cast("long").alias("slot"), "vslot")


def shard_documents(docs: DataFrame, shards: int = 40, folder: str | None = None) -> DataFrame:
    """docs put into shards of near equal bytes.

    Each row of docs gives one row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: under this law the
    map, not the id, decides), vslot, and rebalanced_shard: the shard in the map's next version, edited for one more
    shard. Both versions are stored in folder (a new one in the shared folder if none is given), and the rows are assigned
    from what is read back. Null ids and repeated rows are rows like any other; a very long text is only measured and hashed;
    an empty table gives an empty result; further columns of docs are ignored.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "slots")
    rows = sized(docs)
    sizes, counts = slot_totals(rows)
    SlotMap.balanced(sizes, shards).save(spark, folder)
    now = SlotMap.load(spark, folder, 1)
    now.grown(sizes).save(spark, folder)
    grown = SlotMap.load(spark, folder, now.version + 1)
    out = assign(rows, now, counts)
    return out.withColumn("grown_shard", F.lit(None).cast("int")).withColumn("rebalanced_shard", grown.column(F.col("vslot")))
