"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

The shard of a key depends on the key and the number of shards alone. When shards are appended, a key either stays or
moves to an appended shard; n to n + 1 shards moves about one row in n + 1. The key is hashed by XXH64, and the hash
drives the published generator (a 64-bit linear congruential one); its wrapping product is put together from 16-bit and
32-bit parts, because Spark's BIGINT product raises on overflow. Everything is SQL expressions on BIGINT and DOUBLE.

Slots number the rows of a shard without gaps. They come from `chunks` hash chunks per shard: rows are numbered within
a chunk and chunks are offset by a prefix sum over their counts, so no task numbers a whole shard.

Null keys form one key of their own (one shard); repeated rows get slots of their own; null texts have size 1 and the
checksum of the empty string. Clashing columns of the input are replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the published generator. A fixed value.
MULTIPLIER = 2862933555777941757


def _next_state(k: Column) -> Column:
    """k * MULTIPLIER + 1 modulo 2**64, on a BIGINT's bits."""
    mask, low, high = F.lit(0xFFFFFFFF), MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
    lo, hi = k.bitwiseAND(mask), F.shiftrightunsigned(k, 32)

    def times(x: Column, m: int) -> Column:
        """x * m without the bits that the 16-bit shift carries beyond 2**32."""
        return x * F.lit(m & 0xFFFF) + F.shiftleft((x * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)

    down = times(lo, low) + 1
    carry = F.shiftright(down, 32) + F.shiftright(lo * F.lit(low >> 16), 16)
    up = (carry + times(hi, low) + times(lo, high)).bitwiseAND(mask)
    return F.shiftleft(up, 32).bitwiseOR(down.bitwiseAND(mask))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0 .. shards - 1 of a BIGINT hash: the last jump below the number of shards."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    start = F.struct(key.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def advance(s: Column, _: Column) -> Column:
        k = _next_state(s["k"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(k, 33) + 1).cast("double")))
        return F.when(s["j"] >= shards, s).otherwise(F.struct(k.alias("k"), s["j"].alias("b"), jump.cast("long").alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, advance, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 8, chunks: int = 1024) -> DataFrame:
    """docs(doc_id, text, ...) with size, text_crc32, law, shard, slot and grown_shard, the shard if one is appended.

    Rows of a chunk are numbered by doc_id, then size, then checksum.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "_chunk", "_before")
    key, text = F.xxhash64(F.col("doc_id").cast("long")), F.coalesce("text", F.lit(""))
    rows = docs.drop(*made).select(
        "*",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        F.pmod(F.shiftright(key, 20), F.lit(chunks)).cast("int").alias("_chunk"),
    )
    counts = docs.select(jump_shard(key, shards).alias("shard"), F.pmod(F.shiftright(key, 20), F.lit(chunks)).cast("int").alias("_chunk")).groupBy("shard", "_chunk").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    # At most shards * chunks rows of three numbers: a bound that does not depend on the input.
    if shards * chunks <= 1 << 20:
        offsets = F.broadcast(offsets)
    place = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("_place", place).join(offsets, ["shard", "_chunk"]).withColumn("slot", F.col("_before") + F.col("_place") - 1).drop("_chunk", "_before", "_place")


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 16) -> None:
    """docs as Parquet, one folder for each shard, each of up to `files` files, rows of a file by slot."""
    placed = assign_shards(docs, shards)
    placed.repartition(shards * files, "shard", F.pmod("slot", F.lit(files))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
