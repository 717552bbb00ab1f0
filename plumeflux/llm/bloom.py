"""Blocked Bloom filters made and asked by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 64-bit words in a block of 512 bits
FILTER_BYTES = 4 << 20


def _bits(h: Column) -> list[Column]:
    """Mask of one bit in each word of a block: six bits of a second hash choose the place in each."""
    places = F.xxhash64(h, F.lit(1))
    return [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(places, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        for k in range(WORDS)
    ]


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def n_blocks(n_keys: int, per_block: int = 32) -> int:
    return max(1, -(-n_keys // per_block))


def bloom_blocks(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """All blocks of the filter over the hashes ``h`` of ``keys``: block, words."""
    rows = keys.select(block_of(h, blocks).alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(_bits(h))])
    used = rows.groupBy("block").agg(F.array(*[F.bit_or(f"b{k}") for k in range(WORDS)]).alias("words"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    return every.join(used, "block", "left").withColumn("words", F.coalesce("words", F.array_repeat(F.lit(0).cast("bigint"), WORDS)))


def may_hold(words: Column, h: Column) -> Column:
    """Whether a block's words hold every bit of ``h``."""
    out = F.lit(True)
    for k, bit in enumerate(_bits(h)):
        out = out & (words[k].bitwiseAND(bit) != 0)
    return out


def likely_hit(keys: DataFrame, n_keys: int, h: Column, filter_bytes: int = FILTER_BYTES) -> Column:
    """Whether ``h`` may be among the hashes of the first column of ``keys`` (``n_keys`` rows); an exact join must follow.

    The filter is a scalar of the scan while it takes at most ``filter_bytes``; past that every row may
    be a hit and the exact join alone decides.
    """
    blocks = n_blocks(n_keys)
    if blocks * WORDS * 8 > filter_bytes:
        return F.lit(True)
    key_hash = F.xxhash64(keys.columns[0])
    held = bloom_blocks(keys, key_hash, blocks).agg(F.array_sort(F.collect_list(F.struct("block", "words")))["words"].alias("m")).scalar()
    return may_hold(held[block_of(h, blocks)], h)
