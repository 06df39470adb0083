"""Sharding by rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 16
SEED = 1729
#: Slots are counted in this many parts of each shard, so that no task has a whole shard.
SLOT_PARTS = 1024


def rendezvous(key: Column, weights: Mapping[int, float], seed: int = SEED) -> Column:
    """The shard with the highest score for the key, -weight / ln(u), u the key's and shard's hash in (0, 1).

    A shard's score depends on nothing but the key and that shard, so a new shard takes
    keys only into itself, in proportion to its weight. Ties go to the higher shard id. A
    null key is a key like any other.
    """

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00")), F.lit(shard), F.lit(seed)), 11)
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[score(s, w) for s, w in weights.items()])).shard


def slots(rows: DataFrame, shard: str, parts: int = SLOT_PARTS) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard.

    rows must be a written table. `part` divides each shard by the row's number, so equal
    keys spread too; shards x parts counts give each part its first slot.
    """
    counts = rows.groupBy(shard, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most shards x parts rows
    inside = Window.partitionBy(shard, "part").orderBy("row")
    return rows.withColumn("at", F.row_number().over(inside)).join(F.broadcast(first), [shard, "part"]).withColumn("slot", (F.col("first") + F.col("at") - 1).cast("long"))


def assign_shards(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int = SLOT_PARTS) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, grown_shard, slot.

    A null text has size 1 and the checksum of no bytes; a null id is one key; repeated
    rows share a shard and have slots of their own. Other columns are not read. Texts don't
    leave the scan: only their size and checksum are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.monotonically_increasing_id()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        (rendezvous(F.col(id_col), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        row.alias("row"),
    ).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    return slots(written(rows, "shards"), "shard", parts).select("doc_id", "size", "text_crc32", "shard", "grown_shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = dict.fromkeys(range(SHARDS), 1.0)
    out = assign_shards(table(spark, sf_dir, "documents"), even, even | {SHARDS: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
