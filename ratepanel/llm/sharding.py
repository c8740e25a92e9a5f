"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record is hashed into one of thousands of slots for good. Bytes and rows are added
up per slot, and only these sums, of a fixed number, reach the driver. The map from
slots to shards starts even; each rebalancing edits the map, moving as few slots as it
takes, and is stored as a further version, so earlier layouts stay readable. With a folder for
the map, a run starts from the version stored last and adds its own. A record's
place in its shard is the rows of the slots before its own plus its place in the slot.

Law ``bytes``: the shards' sizes are near equal, up to the smallest move of a slot that helps.

Defined results: a null text has size 1 and checksum 0; null ids are hashed like any
other, together with the text; repeated rows share a slot and get places of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratepanel.llm.common import unused
from ratepanel.session import settle

SLOTS = 4096
SHARDS = 8
MAP = "version int, virtual_slot int, shard int"


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def record_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64(F.col("text"))), F.lit(slots)).cast("int")


@dataclass
class SlotMap:
    """Versions of the map, from number ``first`` on; ``versions[v][slot]`` is the shard."""

    versions: list[np.ndarray] = field(default_factory=list)
    first: int = 0

    @classmethod
    def even(cls, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return cls([np.arange(slots) % shards])

    @classmethod
    def load(cls, spark: SparkSession, folder: str, slots: int, shards: int) -> SlotMap | None:
        """The version stored last in ``folder``, if there is one."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        stored = spark.read.schema(MAP).parquet(folder)
        version = stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).orderBy("virtual_slot").collect()
        owner = np.array([r["shard"] for r in rows])
        if len(owner) != slots or owner.max() >= shards:
            raise ValueError(f"the map in {folder} has {len(owner)} slots and {owner.max() + 1} shards, not {slots} and {shards}")
        return cls([owner], version)

    def store(self, spark: SparkSession, folder: str, after: int) -> None:
        """Appends the versions beyond number ``after``."""
        found = [(self.first + v, s, int(x)) for v, owner in enumerate(self.versions) for s, x in enumerate(owner)]
        rows = spark.createDataFrame([r for r in found if r[0] > after], MAP)
        rows.coalesce(1).write.mode("append").parquet(folder)

    @property
    def latest(self) -> np.ndarray:
        return self.versions[-1]

    def rebalance(self, sizes: np.ndarray, shards: int) -> None:
        """Adds a version: slots move from the fullest to the emptiest shard, each time the
        one nearest to half the difference, as long as that narrows it."""
        owner = self.latest.copy()
        load = np.bincount(owner, weights=sizes, minlength=shards)
        while True:
            full, empty = int(load.argmax()), int(load.argmin())
            gap = load[full] - load[empty]
            own = np.flatnonzero((owner == full) & (sizes > 0) & (sizes < gap))
            if not len(own):
                break
            slot = own[np.abs(sizes[own] - gap / 2).argmin()]
            owner[slot] = empty
            load[full] -= sizes[slot]
            load[empty] += sizes[slot]
        self.versions.append(owner)

    def grow(self, sizes: np.ndarray, shards: int) -> None:
        """Adds a version with further shards; slots move into these alone, large ones first."""
        owner = self.latest.copy()
        old = int(owner.max()) + 1
        load = np.bincount(owner, weights=sizes, minlength=shards)
        fair = sizes.sum() / shards
        for new in range(old, shards):
            for slot in np.argsort(-sizes, kind="stable"):
                giver, size = owner[slot], sizes[slot]
                if giver < old and load[giver] - size >= fair - size / 2 and load[new] + size <= fair + size / 2:
                    owner[slot] = new
                    load[giver] -= size
                    load[new] += size
        self.versions.append(owner)

    def table(self, spark: SparkSession, rows: np.ndarray) -> DataFrame:
        """The map as a stored table ``version, virtual_slot, shard, before``, where
        ``before`` counts the rows in the shard's slots before this one."""
        found = []
        for version, owner in enumerate(self.versions, start=self.first):
            filled = np.zeros(int(owner.max()) + 1, dtype=np.int64)
            for slot, shard in enumerate(owner):
                found.append((version, slot, int(shard), int(filled[shard])))
                filled[shard] += rows[slot]
        return settle(spark.createDataFrame(found, "version int, virtual_slot int, shard int, before long").coalesce(1))


def slot_sums(slots_and_bytes: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot, from ``virtual_slot, bytes`` of each record."""
    sums = slots_and_bytes.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    sizes, rows = np.zeros(slots), np.zeros(slots, dtype=np.int64)
    for r in sums.collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    return sizes, rows


def placed(docs: DataFrame, keep: list[Column], shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """``keep`` of each row of ``docs``, and ``_slot, _version, _shard, _place``; the map is kept in ``folder``."""
    sizes, rows = slot_sums(docs.select(slot_of(slots).alias("virtual_slot"), record_size().alias("bytes")), slots)
    spark = docs.sparkSession
    stored = SlotMap.load(spark, folder, slots, shards) if folder else None
    slot_map = stored or SlotMap.even(slots, shards)
    if slot_map.latest.max() + 1 < min(shards, slots):
        slot_map.grow(sizes, shards)
    slot_map.rebalance(sizes, shards)
    if folder:
        slot_map.store(spark, folder, slot_map.first if stored else -1)
    last = slot_map.first + len(slot_map.versions) - 1
    newest = slot_map.table(spark, rows).where(F.col("version") == last)
    newest = newest.select(
        F.col("virtual_slot").alias("_slot"),
        F.col("version").alias("_version"),
        F.col("shard").alias("_shard"),
        F.col("before").alias("_before"),
    )
    order = [F.col("doc_id").alias("_order_id"), F.xxhash64("text").alias("_order_hash")]
    keyed = docs.select(*keep, slot_of(slots).alias("_slot"), *order)
    in_slot = F.row_number().over(Window.partitionBy("_slot").orderBy("_order_id", "_order_hash"))
    numbered = keyed.withColumn("_row", in_slot - 1).drop("_order_id", "_order_hash")
    return numbered.join(newest, "_slot").withColumn("_place", F.col("_before") + F.col("_row")).drop("_before", "_row")


def shard_rows(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Each record's id, size, checksum and place, without its text."""
    keep = [F.col("doc_id"), record_size().alias("size"), record_crc().alias("text_crc32")]
    return placed(docs, keep, shards, slots, folder).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_slot").alias("virtual_slot"),
        F.col("_version").alias("map_version"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """``docs`` with the shard and the place in it of each record."""
    found = placed(docs, [docs[c] for c in docs.columns], shards, slots, folder)
    shard, slot = unused(docs, "shard"), unused(docs, "slot")
    return found.select(*docs.columns, F.col("_shard").alias(shard), F.col("_place").alias(slot))
