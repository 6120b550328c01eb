"""Sharding by fixed virtual slots.

Each record is hashed to one of N_SLOTS slots, a number that never changes; bytes and rows are summed per slot; a versioned
table maps slots to shards. The first version deals the slots out in turn, before any size is known. Rebalancing edits that
table by what the slots hold: a new shard count or new data moves a few slots, and no record is hashed anew. A call on a path that holds
a map edits that map; a version is added where something changes.

Skew: records are hashed by their own id, so copies of one text or a hot source spread over the slots. A slot of many rows with more
than a SPLIT-th of a shard's bytes, as an id that very many rows have makes it, is marked in the map as spread: its rows, then and ever
after, are hashed by id, text checksum and place to all slots. The
only things collected are the slot histogram and the map, whose rows are bounded by the slot count. Places in a shard are numbered
inside parts of a slot of about PART_ROWS rows, dealt by each row's place in the input, so no task sorts a slot, however full.

Cases: records with a null id are hashed by their text's checksum; a null text has size 1; repeated rows (same id) share a slot, unless it
is spread, and get different places; an empty table gives an empty result; extra columns are ignored; a stored map that lacks a slot raises.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

N_SLOTS = 4096
#: Rows of a slot that are numbered together.
PART_ROWS = 250_000
#: A slot may hold this part of a shard's mean bytes.
SPLIT = 16


@dataclass(frozen=True)
class SlotMap:
    """Slot to shard, with a version that each edit raises, and the slots whose rows are spread over all."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())
    spread: frozenset[int] = field(default=frozenset())

    def rows(self) -> list[tuple[int, int, bool, int]]:
        return [(s, k, s in self.spread, self.version) for s, k in enumerate(self.shard_of)]


def dealt(n_slots: int, n_shards: int) -> SlotMap:
    """The first version: slots in turn."""
    return SlotMap(1, n_shards, tuple(s % n_shards for s in range(n_slots)))


def rebalanced(old: SlotMap, sizes: list[int], n_shards: int | None = None, tolerance: float = 0.0005) -> SlotMap:
    """The next version: moves slots from the fullest shard to the emptiest until both are within tolerance of the mean, or no move helps.

    Slots of removed shards move first. A move takes the slot that comes nearest to half the gap between the two, or, where all are
    too large, exchanges two that differ by about as much; so few move, and each step narrows the gap. Only the moved slots change; they are listed in `moved`.
    """
    n = n_shards or old.n_shards
    shard_of, load, own = list(old.shard_of), [0] * n, [[] for _ in range(n)]
    moved: dict[int, None] = {}

    def put(slot: int, shard: int) -> None:
        shard_of[slot] = shard
        load[shard] += sizes[slot]
        if sizes[slot]:
            insort(own[shard], (sizes[slot], slot))

    homeless = [s for s, k in enumerate(shard_of) if k >= n]
    for s, k in enumerate(shard_of):
        if k < n:
            put(s, k)
    for s in sorted(homeless, key=lambda s: (-sizes[s], s)):
        put(s, min(range(n), key=lambda k: (load[k], k)))
        moved[s] = None
    mean = sum(sizes) / n
    while True:
        high, low = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        # a slot of the fullest that goes, and one of the emptiest, or none, that comes back for it
        best = min(((x, y) for x, y in _steps(own[high], own[low], gap) if 0 < x[0] - y[0] < gap), key=lambda s: (s[1][1] >= 0, abs(gap - 2 * (s[0][0] - s[1][0])), s), default=None)
        if best is None:
            break
        for (size, slot), here, there in ((best[0], high, low), (best[1], low, high)):
            if slot >= 0:
                own[here].remove((size, slot))
                load[here] -= size
                put(slot, there)
                moved[slot] = None
    return SlotMap(old.version + 1, n, tuple(shard_of), tuple(s for s in moved if shard_of[s] != old.shard_of[s]), old.spread)


def _steps(high: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of (size, slot) that a step may exchange: single slots near half the gap, and each slot with those near it less half the gap."""
    nothing = (0, -1)
    at = bisect_right(high, (gap / 2, 0))
    single = [x for x in high[max(0, at - 1) : at + 1] if x[0] < gap]
    yield from ((x, nothing) for x in single)
    if not single:
        for x in high:
            at = bisect_right(low, (x[0] - gap / 2, 0))
            yield from ((x, y) for y in low[max(0, at - 1) : at + 1])


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, virtual_slot and place (in the input; to be stored before it is used) of every record."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.crc32(data).cast("string")))
    return docs.select(
        F.col(id_col),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("place"),
    )


def slot_histogram(slotted: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; n_slots numbers reach the driver, whatever the input."""
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, counts


def too_full(sizes: list[int], counts: list[int], n_shards: int, spread: frozenset[int] = frozenset()) -> frozenset[int]:
    """The slots of several rows that hold more than a SPLIT-th of a shard and are not spread yet."""
    most = sum(sizes) / (SPLIT * n_shards)
    return frozenset(s for s, (size, n) in enumerate(zip(sizes, counts, strict=True)) if n > 1 and size > most and s not in spread)


def with_spread(slotted: DataFrame, spread: frozenset[int], n_slots: int = N_SLOTS, id_col: str = "doc_id") -> DataFrame:
    """Rows of spread slots, of which there are SPLIT a shard at most when they are found, in slots by id, checksum and place."""
    if not spread:
        return slotted
    other = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "text_crc32", "place"), F.lit(n_slots)).cast("int")
    return slotted.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(*sorted(spread)), other).otherwise(F.col("virtual_slot")))


MAP = "virtual_slot int, shard int, spread boolean, version int"


def has_map(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version to the map's table, partitioned by version."""
    rows = spark.createDataFrame(slot_map.rows(), MAP)
    rows.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest if none is named."""
    rows = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, to be edited; a row a slot reaches the driver."""
    rows = sorted(load_map(spark, path, version).collect(), key=lambda r: r["virtual_slot"])
    if [r["virtual_slot"] for r in rows] != list(range(N_SLOTS)):
        raise ValueError(f"the map at {path} has not one row for each of {N_SLOTS} slots")
    return SlotMap(rows[0]["version"], max(r["shard"] for r in rows) + 1, tuple(r["shard"] for r in rows), spread=frozenset(r["virtual_slot"] for r in rows if r["spread"]))


def assign(slotted: DataFrame, slot_map: DataFrame, rows: int, part_rows: int = PART_ROWS, id_col: str = "doc_id") -> DataFrame:
    """Adds shard, version and slot: the record's place in its shard, gapless from 0. slotted is stored and has so many rows.

    A part's places are shifted by the rows of the shard's earlier parts, a table of a row a part.
    """
    parts = max(1, rows // (N_SLOTS * part_rows))
    at = slotted.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    before = W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    base = at.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).join(slot_map, "virtual_slot")
    base = base.select("virtual_slot", "part", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(W.partitionBy("virtual_slot", "part").orderBy(F.col(id_col), "text_crc32", "size", "place"))
    placed = at.withColumn("number", number).join(base, ["virtual_slot", "part"])
    return placed.withColumn("slot", (F.col("base") + F.col("number") - 1).cast("long")).drop("base", "number", "part", "place")


def shard_documents(docs: DataFrame, n_shards: int, path: str) -> DataFrame:
    """Every record's shard by the map at path, edited to fit n_shards and the sizes; a path without one gets its first version first."""
    spark = docs.sparkSession
    if not has_map(spark, path):
        store_map(spark, dealt(N_SLOTS, n_shards), path)
    old = read_map(spark, path)
    hashed = common.stored(with_slots(docs), "slotted")
    slotted = with_spread(hashed, old.spread)
    sizes, counts = slot_histogram(slotted)
    if found := too_full(sizes, counts, n_shards, old.spread):
        old = replace(old, spread=old.spread | found)
        slotted = with_spread(hashed, old.spread)
        sizes, counts = slot_histogram(slotted)
    new = rebalanced(old, sizes, n_shards)
    if new.moved or found or old.n_shards != n_shards:
        store_map(spark, new, path)
    return assign(slotted, load_map(spark, path).drop("spread"), sum(counts))


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, law `bytes`: the first map, rebalanced by the bytes of its slots, read back in its second version."""
    out = shard_documents(common.table(spark, sf_dir, "documents"), 8, common.new_path(spark, "slotmap"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
