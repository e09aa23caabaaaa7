"""Sharding by jump consistent hashing, in DataFrame functions only.

Every key walks the published jump sequence: a 64-bit linear congruential generator decides at which shard
count the key moves next, and the last stop below the shard count is its shard. Nothing but the key and the
count matters, so appending a shard moves 1/(n+1) of the keys, all of them into the new shard.

The 64-bit state is kept as two unsigned 32-bit halves in longs and multiplied in 16-bit limbs, so the plan
is free of overflow under ANSI arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, table, whole_text, with_offsets

# Fixed values of the published generator: multiplier 2862933555777941757, increment 1.
_MULTIPLIER = 2862933555777941757
_LOW32 = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * multiplier + 1 modulo 2**64."""
    mult_high, mult_low = F.lit(_MULTIPLIER >> 32), F.lit(_MULTIPLIER & _LOW32)
    mask16, mask32 = F.lit(0xFFFF).cast("long"), F.lit(_LOW32)
    first = low.bitwiseAND(mask16) * mult_low + F.lit(1)
    second = F.shiftrightunsigned(low, 16) * mult_low + F.shiftrightunsigned(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(mask16), 16).bitwiseOR(first.bitwiseAND(mask16))

    def product32(a: Column, b: Column) -> Column:
        upper = (F.shiftrightunsigned(a, 16) * b.bitwiseAND(mask16)).bitwiseAND(mask16)
        lower = (a.bitwiseAND(mask16) * b).bitwiseAND(mask32)
        return F.shiftleft(upper, 16) + lower

    new_high = (F.shiftrightunsigned(second, 16) + product32(high, mult_low) + product32(low, mult_high)).bitwiseAND(mask32)
    return new_high, new_low


def jump_stops(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a long key among ``shards`` and among ``shards + 1``.

    The stops of a key are increasing, so ``shards + 1`` steps always suffice; after the first stop beyond
    the range the remaining steps only pass the state on.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW32)).alias("low"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        # The published step: floor((b + 1) * 2**31 / ((state >> 33) + 1)).
        fraction = F.lit(2.0**31) / (F.shiftrightunsigned(high, 1) + 1).cast("double")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            F.when(state["next"] < shards, state["next"]).otherwise(state["shard"]).alias("shard"),
            state["next"].alias("grown"),
            F.floor((state["next"] + 1).cast("double") * fraction).alias("next"),
        )
        return F.when(state["next"] <= shards, moved).otherwise(state)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return walked


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Put every row into one of ``shards`` shards by its key and number the rows of each shard from 0.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts count as empty; a null key is a
    key like any other (its rows share a shard); rows repeated in full get slots of their own. An empty table
    gives an empty result. Only the named columns are read, so further columns do no harm.
    """
    spark = docs.sparkSession
    stops = jump_stops(F.xxhash64(F.col(key)), shards)
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole_text()) + 16).cast("long").alias("size"),
        F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"),
        stops.alias("_stops"),
    ).select(
        "doc_id", "size", "text_crc32",
        F.col("_stops.shard").cast("int").alias("shard"),
        F.col("_stops.grown").cast("int").alias("grown_shard"),
        F.lit(1).cast("long").alias("_one"),
    )
    numbered = with_offsets(placed, ["shard"], ["doc_id", "text_crc32", "size"], "_one", "slot", buckets or 4 * shuffle_width(spark))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 40)
