"""Sharding: jump consistent hashing, DataFrame functions only.

A key's shard follows from the key and the number of shards alone. There is no ring table: each row
runs the jump recurrence on its own 64-bit key, and when a shard is appended exactly the rows that
the recurrence sends on move, all of them into the new shard.

Defined results: a null key counts as 0. A null text has no bytes. Equal keys always share a shard.
Repeated rows get slots of their own. An empty table gives an empty result. Extra columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Multiplier of the recurrence's 64-bit linear generator (a fixed value).
MULTIPLIER = 2862933555777941757
_HI, _LO, _MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
#: Jumps of one key: ln(shards) on average. More than this many would raise an error, never a wrong shard.
MAX_JUMPS = 200
#: Rows that one slot-numbering group should hold.
GROUP_ROWS = 200_000


def _low32(a: Column, b: int) -> Column:
    """(a * b) modulo 2**32 for a < 2**32 without leaving 63 bits, so it also holds in ANSI mode."""
    high = (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return (a.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(b) + high * 65536).bitwiseAND(F.lit(_MASK))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Key * MULTIPLIER + 1 modulo 2**64, the key in two halves of 32 bits."""
    part0 = lo.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(_LO) + 1
    part1 = F.shiftright(lo, 16) * F.lit(_LO)
    low = part0 + part1.bitwiseAND(F.lit(0xFFFF).cast("long")) * 65536
    carry = F.shiftright(low, 32) + F.shiftright(part1, 16)
    high = (carry + _low32(hi, _LO) + _low32(lo, _HI)).bitwiseAND(F.lit(_MASK))
    return high, low.bitwiseAND(F.lit(_MASK))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the key's shard of `shards`, and its shard once one more is appended."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"),
        long(0).alias("at"), long(-1).alias("shard"), long(-1).alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        reach = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
        jumped = F.struct(
            hi.alias("hi"), lo.alias("lo"), ((s["at"] + 1).cast("double") * reach).cast("long").alias("at"),
            F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]).alias("shard"), s["at"].alias("grown"),
        )
        return F.when(s["at"] <= shards, jumped).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(min(shards + 1, MAX_JUMPS))), state, step,
        lambda s: F.when(s["at"] > shards, F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))
        .otherwise(F.raise_error(F.lit("a key jumped more often than MAX_JUMPS")).cast("struct<shard:int,grown:int>")),
    )


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard under the law `key`, its slot there, and its shard of one more.

    Only (key, size, checksum, shard) is shuffled, never the text. Slots are numbered within small
    groups of a shard (groups by a hash of key and checksum, GROUP_ROWS rows on average), to which the
    number of rows in the groups before is added; that table has one row per group.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("k"), body.alias("t")).select(
        F.col("k"),
        (F.octet_length("t").cast("long") + 16).alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        jump_shards(F.col("k"), shards).alias("j"),
    )
    slim = slim.select("k", "size", "text_crc32", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"))
    slim = materialize(slim, "shards")
    groups = max(4, min(4096, -(-slim.count() // (shards * GROUP_ROWS))))
    slim = slim.withColumn("g", F.pmod(F.xxhash64("k", "text_crc32"), F.lit(groups)).cast("int"))
    # shards * groups rows, 4096 * shards at most: small enough to broadcast
    before = slim.groupBy("shard", "g").agg(F.count("*").alias("n"))
    running = W.partitionBy("shard").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("shard", "g", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "g").orderBy("k", "text_crc32", "size")
    return slim.withColumn("r", F.row_number().over(within)).join(F.broadcast(before), ["shard", "g"]).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("r") - 1).cast("long").alias("slot"), "grown_shard",
    )
