"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Rows are hashed into SLOTS virtual slots; bytes and rows are summed by slot (a table of at most
SLOTS rows, whatever the corpus). A map from slots to shards is stored by version. A new one starts as
slot modulo shards, version 0. Each time rows are assigned, the last version is read and edited: with
more shards than before, slots move into the new ones alone; then whole slots move from the fullest
shard to the emptiest while that evens them out. What comes of it, with the sums it was made for, is
written as the next version, and rows follow it; where nothing moves, the sums alone are new. The law
that holds is ``bytes``: the shards' sizes are near equal.

Defined results: size is the text's UTF-8 bytes plus 1, so a null or empty text has size 1 and
checksum 0; a very long text is one row of its slot, and no slot is split; rows that repeat doc_id and
text are numbered first and spread over the slots like any others, as are rows with a null doc_id; an
empty table gives an empty result and a map of empty slots; fewer shards than the stored map has are an
error. Ids may be of any type that has an order. Only the id and text columns are read, so other
columns of any name do no harm.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_path, written

SLOTS = 4096
#: Equal rows that are numbered in one step.
COPIES = 100_000
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy (the number among equal rows), virtual_slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = written(rows, "distinct-rows")

    def numbered(part: DataFrame) -> DataFrame:
        return part.select("doc_id", "size", "text_crc32", F.explode(F.sequence("first", F.least("n", F.col("first") + COPIES - 1))).alias("copy"))

    few = numbered(rows.filter(F.col("n") <= COPIES).withColumn("first", F.lit(1).cast("long")))
    many = rows.filter(F.col("n") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(COPIES).cast("long"))))
    own = few.unionByName(numbered(many.repartition("doc_id", "text_crc32", "first")))
    return own.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(slots)).cast("int"))


def rebalanced(held: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map after moves of whole slots from the fullest to the emptiest shard, largest slot
    that fits first, until no move lessens the difference."""
    held = dict(held)
    by_shard: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    load = [0] * shards
    for slot, shard in held.items():
        by_shard[shard].append((sizes.get(slot, 0), slot))
        load[shard] += sizes.get(slot, 0)
    for _ in range(4 * len(held)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        move = max(((b, s) for b, s in by_shard[full] if 0 < b < gap), key=lambda x: (-abs(2 * x[0] - gap), x[1]), default=None)
        if move is None or load[full] == load[empty]:
            break
        by_shard[full].remove(move)
        by_shard[empty].append(move)
        load[full] -= move[0]
        load[empty] += move[0]
        held[move[1]] = empty
    return held


def grown(held: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map for one more shard: slots move only into the new one, from the fullest each time."""
    held, load = dict(held), [0] * (shards + 1)
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in held.items():
        load[shard] += sizes.get(slot, 0)
        own[shard].append((sizes.get(slot, 0), slot))
    goal = sum(load) / (shards + 1)
    heap = [(-load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for o in own:
        o.sort()
    while heap:
        _, shard = heapq.heappop(heap)
        fit = [x for x in own[shard] if x[0] and load[shards] + x[0] <= goal + x[0] / 2]
        if load[shards] >= goal or not fit or load[shard] <= goal:
            break
        moved = fit[-1]
        own[shard].remove(moved)
        held[moved[1]] = shards
        load[shard] -= moved[0]
        load[shards] += moved[0]
        heapq.heappush(heap, (-load[shard], shard))
    return held


class SlotMap:
    """The versions of a slot-to-shard map, kept as a Parquet table with a folder a version."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def write(self, version: int, held: dict[int, int], sizes: dict[int, tuple[int, int]]) -> None:
        rows = [(version, s, held[s], *sizes.get(s, (0, 0))) for s in range(self.slots)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v={version}")

    def last(self) -> int | None:
        """The number of the last version that was written whole; None without one."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = store.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(top, "v=*/_SUCCESS")) or []
        return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=None)

    def edited(self, shards: int, sums: dict[int, tuple[int, int]]) -> int:
        """Edits the last version for these shards and sums (bytes, rows by slot); the number of
        the version that holds from now on."""
        sizes, last = {s: b for s, (b, _) in sums.items()}, self.last()
        if last is None:
            last, held = 0, {s: s % shards for s in range(self.slots)}
            self.write(0, held, sums)
        else:
            held = {r.slot: r.shard for r in self.read(last).collect()}  # `slots` rows
            if len(held) != self.slots:
                raise ValueError(f"the map has {len(held)} slots, not {self.slots}")
        had = max(held.values()) + 1
        if had > shards:
            raise ValueError(f"the map has {had} shards; {shards} are fewer")
        for n in range(had, shards):
            held = grown(held, sizes, n)
        self.write(last + 1, rebalanced(held, sizes, shards), sums)
        return last + 1


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, virtual_slot, place (gapless from 0 in its shard), version.
    The map at map_path is edited, or begun; unset, a map for this call alone.

    The rows' digests are written once; the sums by slot and the map are SLOTS rows. A row's place
    is its rank in its virtual slot plus the rows of the shard's earlier slots, so that no task
    sorts more than a slot."""
    spark = docs.sparkSession
    rows = written(slotted(docs, id_col, text_col, slots), "slotted")
    sums = {r.virtual_slot: (r.bytes, r.rows) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}  # at most `slots` rows
    versions = SlotMap(spark, map_path or shared_path(spark, "slot-map"), slots)
    version = versions.edited(shards, sums)
    order = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    places = versions.read(version).withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    places = F.broadcast(places.select(F.col("slot").alias("virtual_slot"), "shard", "before", "version"))  # `slots` rows
    rank = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "copy")
    return rows.withColumn("rank", F.row_number().over(rank)).join(places, "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", "virtual_slot",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("place"), "version",
    )
