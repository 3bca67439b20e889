"""Sharding through fixed virtual slots.

Records are hashed into thousands of slots, the bytes of every slot are summed, and a versioned map tells each slot's
shard. Rebalancing edits the map: version 1 deals slots out in turn, each later version moves slots from the heaviest
shards to the lightest. Records follow their slot, so an edit moves only the records of the slots it names. The map is
kept in a folder: a later run loads it, adds a version that fits the sizes it finds, and moves as little as that takes.

Records with equal text share a slot, and so a shard. Only a text whose copies hold more bytes than a whole shard (so
there are fewer such texts than shards in a run) has its records spread over many slots by doc_id, from then on and in all
later versions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import text_slices
from lodestone.plans.runtime import materialize, new_path, prepare

SLOTS = 8192
#: Slots over which the records of a crowded text are spread, counted from SLOTS on.
SPREAD = 4096
#: Rebalancing ends when the heaviest shard is within this part of the mean, or no move helps.
TOLERANCE = 0.0005


#: Rows of a slot that one task numbers; a larger slot is numbered in parts.
PART_ROWS = 1 << 16


@dataclass
class SlotMap:
    """shards[v][s] is the shard of slot s in version v + 1; crowded: the text hashes spread over slots, with the version
    that began it."""

    versions: list[np.ndarray] = field(default_factory=list)
    crowded: dict[int, int] = field(default_factory=dict)

    @classmethod
    def fixed(cls, slots: int, shards: int) -> SlotMap:
        return cls([np.arange(slots) % shards])

    @property
    def current(self) -> np.ndarray:
        return self.versions[-1]

    def moves(self, version: int | None = None) -> list[tuple[int, int, int]]:
        """(slot, shard before, shard after) of the slots that a version, by default the last, moved."""
        v = len(self.versions) if version is None else version
        if v < 2:
            return []
        before, after = self.versions[v - 2], self.versions[v - 1]
        return [(int(s), int(before[s]), int(after[s])) for s in np.flatnonzero(before != after)]

    def rebalance(self, size: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> int:
        """Add a version in which shards hold nearly equal size, unless the current one does. Returns the number of slots
        moved.

        Slots of shards that are no more go to the lightest, largest first. Then each step moves, from the heaviest shard
        to the lightest, the slot that is nearest to half their difference; if none helps, the pair of slots whose
        exchange is nearest. Slots without size stay.
        """
        home = self.current.copy()
        lost = np.flatnonzero(home >= shards)
        load = np.bincount(home[home < shards], weights=size[home < shards], minlength=shards)
        for s in lost[np.argsort(-size[lost], kind="stable")]:
            home[s] = int(load.argmin())
            load[home[s]] += size[s]
        mean = load.mean()
        for _ in range(4 * len(size)):
            hi, lo = int(load.argmax()), int(load.argmin())
            gap = (load[hi] - load[lo]) / 2
            if load[hi] <= mean * (1 + tolerance) and load[lo] >= mean * (1 - tolerance):
                break
            mine = np.flatnonzero((home == hi) & (size > 0))
            if not len(mine):
                break
            best = mine[np.abs(size[mine] - gap).argmin()]
            gain = gap - abs(size[best] - gap)
            theirs = np.flatnonzero((home == lo) & (size > 0))
            swap = None
            if len(theirs) and gain < 0.5 * gap:
                order = theirs[np.argsort(size[theirs], kind="stable")]
                at = np.clip(np.searchsorted(size[order], size[mine] - gap), 0, len(order) - 1)
                off = np.abs(size[mine] - size[order[at]] - gap)
                k = int(off.argmin())
                if gap - off[k] > gain:
                    swap, best, gain = order[at[k]], mine[k], gap - off[k]
            if gain <= 0:
                break
            home[best] = lo
            load[hi] -= size[best]
            load[lo] += size[best]
            if swap is not None:
                home[swap] = hi
                load[hi] += size[swap]
                load[lo] -= size[swap]
        moved = int((home != self.current).sum())
        if moved:
            self.versions.append(home)
        return moved

    def frame(self, spark, since: int = 0) -> DataFrame:
        """The edits of versions after `since`: (version, vslot, shard), all slots for version 1, else those it moved."""
        rows = [(1, s, int(x)) for s, x in enumerate(self.versions[0])] if not since else []
        for v in range(max(since + 1, 2), len(self.versions) + 1):
            rows += [(v, s, after) for s, _, after in self.moves(v)]
        return spark.createDataFrame(rows, "version int, vslot int, shard int")

    def save(self, spark, path: str, since: int = 0) -> None:
        """Add the versions after `since`, and the texts they began to spread, to the folder; no older file is touched."""
        fresh = [(v, int(k)) for k, v in self.crowded.items() if v > since]
        self.frame(spark, since).coalesce(1).write.mode("append").parquet(f"{path}/slots")
        spark.createDataFrame(fresh, "version int, key long").coalesce(1).write.mode("append").parquet(f"{path}/crowded")

    @classmethod
    def load(cls, spark, path: str) -> SlotMap | None:
        """The map in the folder, or None where there is none."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slots/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        rows = spark.read.parquet(f"{path}/slots").orderBy("version", "vslot").collect()  # SLOTS + SPREAD rows, then those moved
        home = np.array([r["shard"] for r in rows if r["version"] == 1])
        out = cls([home])
        for v in range(2, max(r["version"] for r in rows) + 1):
            home = home.copy()
            for r in rows:
                if r["version"] == v:
                    home[r["vslot"]] = r["shard"]
            out.versions.append(home)
        out.crowded = {r["key"]: r["version"] for r in spark.read.parquet(f"{path}/crowded").collect()}
        return out


def _measure(batches):
    for rows, data, off in text_slices(batches, "text"):
        view = memoryview(np.ascontiguousarray(data))
        crc = [zlib.crc32(view[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("uid"), pa.array(np.diff(off) + 1), pa.array(crc, pa.int64()), rows.column("key")], names=["doc_id", "uid", "size", "text_crc32", "key"])


@dataclass
class Sharding:
    """rows as shard() gives them, the slot map with its last version, and the slots that this run moved."""

    rows: DataFrame
    map: SlotMap
    moved: list[tuple[int, int, int]]


def place(docs: DataFrame, shards: int = 16, slots: int = SLOTS, spread: int = SPREAD, seed: int = 42, map_path: str | None = None) -> Sharding:
    """Put every row into a shard, see shard(). If map_path holds a map, it is loaded and edited, and the slots and spread
    of its time are kept; else a new one is begun there (by default in the shared folder)."""
    spark = prepare(docs.sparkSession)
    path = map_path or new_path(spark, "slot-map")
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))))
    kinds = "doc_id long, uid long, size long, text_crc32 long, key long"
    facts = materialize(rows.mapInArrow(_measure, kinds), "shard-facts")
    own = F.pmod("key", F.lit(slots)).cast("int")

    def totals(df: DataFrame) -> np.ndarray:
        """Bytes and rows of each slot; a bounded number of rows."""
        out = np.zeros((2, slots + spread))
        for r in df.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
            out[:, r["vslot"]] = r["size"], r["n"]
        return out

    known = SlotMap.load(spark, path) if map_path else None
    made = known or SlotMap.fixed(slots + spread, shards)
    if len(made.current) != slots + spread:
        raise ValueError(f"the map in {path} has {len(made.current)} slots, not {slots + spread}")
    since = len(made.versions) if known else 0
    first = totals(facts.select(own.alias("vslot"), "size"))
    limit = float(first[0].sum()) / shards
    full = [int(s) for s in np.flatnonzero(first[0] > limit)]
    if full:
        texts = facts.where(own.isin(full)).groupBy("key").agg(F.sum("size").alias("size"))
        for r in texts.where(F.col("size") > limit).select("key").collect():  # fewer than shards
            made.crowded.setdefault(r["key"], since + 1)
    vslot = own
    if made.crowded:
        apart = (F.lit(slots) + F.pmod(F.xxhash64(F.lit(seed), "key", "doc_id", "uid"), F.lit(spread))).cast("int")
        vslot = F.when(F.col("key").isin(list(made.crowded)), apart).otherwise(own)
    dealt = facts.withColumn("vslot", vslot)
    held = totals(dealt)
    made.rebalance(held[0], shards)
    made.save(spark, path, since)

    home = made.current
    order = np.lexsort((np.arange(len(home)), home))
    before = np.zeros(len(home), np.int64)
    count = held[1][order].astype(np.int64)
    run = np.cumsum(count) - count
    starts = np.searchsorted(home[order], np.arange(shards))
    before[order] = run - run[np.minimum(starts, len(run) - 1)][home[order]]
    parts = np.maximum(1, -(-held[1].astype(np.int64) // PART_ROWS))
    places = spark.createDataFrame([(int(s), int(home[s]), int(before[s]), int(parts[s])) for s in np.flatnonzero(held[1])], "vslot int, shard int, before long, parts int")
    placed = dealt.join(F.broadcast(places), "vslot")  # at most slots + spread rows
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "uid"), F.col("parts")).cast("int"))
    inside = Window.partitionBy("vslot", "part").orderBy(F.col("doc_id").asc_nulls_last(), "uid")
    number = F.col("before") + F.row_number().over(inside) - 1
    if (parts > 1).any():
        earlier = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for PART_ROWS rows
        sums = placed.where("parts > 1").groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))
        sums = sums.select("vslot", "part", F.sum("n").over(earlier).alias("skip"))
        placed = placed.withColumn("number", number).join(sums, ["vslot", "part"], "left")
        number = F.col("number") + F.coalesce("skip", F.lit(0))
    rows = placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", number.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(len(made.versions)).alias("map_version"),
    )
    return Sharding(rows, made, made.moves() if known and len(made.versions) > since else [])


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, spread: int = SPREAD, seed: int = 42, map_path: str | None = None) -> DataFrame:
    """Put every row into a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    docs: doc_id long, text string; other columns are not read. size: UTF-8 bytes of the text (null: none) plus 1. The
    law is `bytes`: the shards' sizes are near equal. slot counts a shard's rows from 0 without gaps, in the order of
    virtual slots, within one by doc_id (slots of more than PART_ROWS rows in parts). place() also gives the map and what
    moved.

    - Equal texts share a shard unless their copies hold more bytes than a shard may.
    - Rows that repeat a doc_id, null doc_ids (last in their slot or part) and empty texts are placed like any other.
    - Fewer rows than shards leave shards empty. No rows give no rows. Texts are measured whole, in slices of many texts.
    """
    return place(docs, shards, slots, spread, seed, map_path).rows
