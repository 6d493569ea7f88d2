"""Shards of near-equal bytes through a fixed number of virtual slots.

A record's hash (of all that is sharded: id and text) puts it in one of SLOTS virtual slots, for
good. Of equal rows each has a salt of its own in its hash, so that many of them spread over the slots; they are
interchangeable, and which of them has which salt may differ from run to run. A slot map says which shard each slot belongs to; it is a small table of SLOTS rows, kept
as versions side by side. Only the map is edited when shards are rebalanced or added, so records
of slots that keep their shard never move.

* Version 0 deals slots round robin.
* `rebalanced` reads the bytes of each slot (one aggregate over the records) and writes the next
  version: slots are taken largest first, and each goes to the shard with the fewest bytes so
  far, its old one if that is no fuller. This is a fold over SLOTS rows, whose number is fixed.

`placed` gives each record its shard and its place in it, 0, 1, 2 ... without a gap: places are
counted within a virtual slot, and a slot's first place is the count of the shard's earlier slots. So no
task ever holds a shard, only slots. The law is `bytes`: sums of sizes are near equal, up to the size
of a small slot or one record that is larger than a shard's share.

Defined results: null text has 0 bytes, hence size OVERHEAD, and the crc32 of an empty text; null ids hash
like any value; equal rows get slots and places of their own; an empty
table gives no row; only doc_id and text are read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablevitals.llm.common import scratch_path, stored

SLOTS = 4096
OVERHEAD = 16  # bytes a record takes besides its text


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row; stored, as equal rows are numbered once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    hashed = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("doc_id", "text").alias("hash"),
            F.monotonically_increasing_id().alias("nth"),
        ),
        "hashes",
    )
    repeated = hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("nth").alias("first")).where("n > 1").select("hash", "first")
    salted = hashed.join(repeated, "hash", "left")
    # The first of equal rows, and rows without equals, have their own hash.
    slot = F.when(F.col("nth") > F.col("first"), F.xxhash64("hash", "nth")).otherwise(F.col("hash"))
    return salted.select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(slots)).cast("long").alias("virtual_slot"))


def slot_bytes(placed_records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has records."""
    return placed_records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the slot map: version, virtual_slot, shard."""
    return spark.range(slots, numPartitions=1).select(F.lit(0).alias("version"), F.col("id").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map: slots by falling size, each to the emptiest shard.

    With more shards than before it also fills the new ones; with fewer, it empties those above.
    """
    last = slot_map.join(slot_map.agg(F.max("version").alias("version")), "version").join(sizes, "virtual_slot", "left")
    slots = last.select("version", F.struct(F.col("bytes").isNull().alias("unused"), (-F.coalesce("bytes", F.lit(0))).alias("less"), F.col("virtual_slot").alias("slot"), F.col("shard").alias("shard")).alias("slot"))
    folded = slots.groupBy("version").agg(F.sort_array(F.collect_list("slot")).alias("slots"))

    def step(state: Column, slot: Column) -> Column:
        loads = state["loads"]
        old = F.when((slot["shard"] < shards) & (F.get(loads, slot["shard"]) <= F.array_min(loads)), slot["shard"])
        goes = F.coalesce(old, F.array_position(loads, F.array_min(loads)).cast("int") - 1)
        return F.struct(
            F.transform(loads, lambda load, i: load + F.when(i == goes, -slot["less"]).otherwise(F.lit(0))).alias("loads"),
            goes.alias("goes"),
        )

    # One state after each slot would be an array of states; the slots of each shard are kept as a map of choices.
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def keep(state: Column, slot: Column) -> Column:
        now = step(state, slot)
        return F.struct(now["loads"].alias("loads"), F.concat(state["chosen"], F.array(now["goes"])).alias("chosen"))

    chosen = F.aggregate("slots", start, keep, lambda state: state["chosen"])
    pairs = folded.select((F.col("version") + 1).alias("version"), F.explode(F.arrays_zip(F.col("slots"), chosen.alias("shard"))).alias("pair"))
    return pairs.select("version", F.col("pair.slots.slot").alias("virtual_slot"), F.col("pair.shard").alias("shard"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """The slots whose shard changed between two versions."""
    old = before.select("virtual_slot", F.col("shard").alias("from_shard"))
    return after.join(old, "virtual_slot").where("shard <> from_shard").select("virtual_slot", "from_shard", "shard")


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Adds one version to a folder that holds the map's versions."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest by default."""
    versions = spark.read.schema("version int, virtual_slot long, shard int").parquet(folder)
    if version is None:
        return versions.join(versions.agg(F.max("version").alias("version")), "version").select("version", "virtual_slot", "shard")
    return versions.where(F.col("version") == version)


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and slot (place in the shard) of every record, under one version of the map."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot").withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    joined = numbered.join(starts.select("virtual_slot", "shard", "first"), "virtual_slot")
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Every row of docs in one of the shards, near equal in bytes; the map is stored in folder."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "slot-map")
    rows = stored(records(docs, slots), "records")
    sizes = stored(slot_bytes(rows), "slot-bytes")
    save_map(first_map(spark, shards, slots), folder)
    save_map(rebalanced(read_map(spark, folder), sizes, shards), folder)
    return placed(rows, sizes, read_map(spark, folder))
