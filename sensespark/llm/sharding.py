"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's hash puts it into one of ``SLOTS`` virtual slots for good.  Bytes
are summed per slot, and a map from slots to shards, kept as rows with a
version, says where each slot lives.  Rebalancing edits the map; records never
move except with their slot.

Main path: DataFrame expressions only.  The largest thing held at one place is
the list of slots, whose number is a parameter and not the data's.

Defined cases: a null text has no bytes and the checksum of the empty text;
null ids share a slot by their text; rows that repeat share a slot and get
places of their own; an empty table gives an empty result and a map whose
slots hold 0 bytes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh_path, materialise

SLOTS = 4096


def slot_of(key: Column, salt: Column, slots: int = SLOTS) -> Column:
    """The fixed virtual slot of a record; ``salt`` spreads records that share a key or have none."""
    return F.pmod(F.xxhash64(key, salt), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, records) of every slot, empty slots too."""
    known = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("long")
    return every.join(known, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("records", zero).alias("records")
    )


def _dealt(slots: Column, loads: Column) -> Column:
    """Fold: each slot, the largest first, to the shard with the fewest bytes."""

    def step(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i + 1 == least, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["shards"], F.array(least - 1)).alias("shards"),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    return F.aggregate(slots, start, step, lambda s: s["shards"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """(version, virtual_slot, shard, bytes, records): version 0, slots dealt in turn."""
    return sizes.select(F.lit(0).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).alias("shard"), "bytes", "records")


def balance_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with near-equal bytes.

    Slots go by descending bytes to the emptiest shard.  The fold is one
    expression over the fixed number of slots.
    """
    order = F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "records")), asc=False)
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    dealt = slot_map.agg(F.max("version").alias("version"), order.alias("slots")).withColumn("shards", _dealt(F.col("slots"), loads))
    pair = dealt.select((F.col("version") + 1).alias("version"), F.explode(F.arrays_zip("slots", "shards")).alias("x"))
    return pair.select(
        "version",
        F.col("x.slots.virtual_slot").alias("virtual_slot"),
        F.col("x.shards").alias("shard"),
        F.col("x.slots.bytes").alias("bytes"),
        F.col("x.slots.records").alias("records"),
    )


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with one shard more (number ``shards``).

    Each old shard gives slots, its smallest first, while what it has given
    stays within its share of the new shard's load; rows move only into the
    new shard.
    """
    by_size = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    given = F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    own = F.sum("bytes").over(Window.partitionBy("shard"))
    moves = F.col("given") * F.lit(shards + 1) <= F.col("own")
    moved = slot_map.withColumn("given", given).withColumn("own", own)
    return moved.select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "bytes", "records"
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to the table at ``path``."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest if none is named."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "records")


def records_of(df: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), narrow; texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        crc.alias("text_crc32"),
        slot_of(F.col(id_col).cast("long"), crc, slots).alias("virtual_slot"),
    )


def assign_shards(df: DataFrame, shards: int = 40, slots: int = SLOTS, **cols) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of every record.

    The first version of the slot map deals slots in turn; it is stored, edited
    to equal bytes and stored again, and the latest version is what is used.

    ``slot`` is the record's place in its shard, gapless from 0: the records
    of the shard's earlier virtual slots, plus its rank in its own one.  So
    the rank needs a window over one virtual slot, not over a whole shard.
    """
    records = materialise(records_of(df, slots, **cols), "shard-records")
    path = fresh_path(df.sparkSession, "slot-map")
    save_map(first_map(slot_bytes(records, slots), shards), path)
    save_map(balance_map(load_map(df.sparkSession, path), shards), path)
    slot_map = load_map(df.sparkSession, path)
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("first")
    places = slot_map.select("virtual_slot", "shard", first)
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = records.withColumn("rank", rank)
    # One row per slot: 4,096 rows of 16 bytes, whatever the data.
    joined = ranked.join(F.broadcast(places), "virtual_slot")
    return joined.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))
