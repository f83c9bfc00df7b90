"""A blocked Bloom filter made of DataFrame operations.

The filter is a table: one row per block of 512 bits, as eight longs. It is built by one aggregation with map-side
combine and probed by a join on the block number. :func:`blocks_for` sizes it by the number of keys, so that the share of
false positives stays about one in a hundred. Up to ``BROADCAST_BLOCKS`` blocks (16 MB of bits, 11 million keys) the
filter is broadcast; a larger one stays partitioned by block, and the probing rows are shuffled to its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 16  # 4 MB of bits
BROADCAST_BLOCKS = 1 << 18
BITS_A_KEY = 12
HASHES = 5
WORDS = 8


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block, and its bit positions (0..511) there."""
    high, low = F.xxhash64(key), F.xxhash64(F.lit("bits"), key)
    return F.pmod(high, F.lit(blocks)).cast("int"), [F.shiftrightunsigned(low, 9 * i).bitwiseAND(511).cast("int") for i in range(HASHES)]


def blocks_for(keys: int) -> int:
    """The number of blocks for so many distinct keys: a power of two, ``BITS_A_KEY`` bits a key or more."""
    return 1 << max(6, (max(1, keys) * BITS_A_KEY // 512).bit_length())


def build(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter over all non-null values of ``key``: ``bf_block, bf_w0 .. bf_w7``."""
    if not 0 < blocks < 1 << 31:
        raise ValueError("blocks must be a positive int")
    block, bits = _place(F.col(key), blocks)
    placed = keys.where(F.col(key).isNotNull()).select(block.alias("bf_block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    word = lambda w: F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(F.shiftright(F.col(f"b{i}"), 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"b{i}").bitwiseAND(63))).otherwise(F.lit(0).cast("long"))
        for i in range(HASHES)
    ]))
    return placed.groupBy("bf_block").agg(*[word(w).alias(f"bf_w{w}") for w in range(WORDS)])


def probe(df: DataFrame, key: str, bloom: DataFrame, blocks: int = BLOCKS, flag: str = "maybe") -> DataFrame:
    """Add ``flag``: false where ``key`` certainly was not among the filter's keys. Null keys give false.

    Above ``BROADCAST_BLOCKS`` the join is a sort-merge join, whose hot blocks AQE splits."""
    block, bits = _place(df[key], blocks)
    own = bloom.select(F.col("bf_block").alias("__bf_block"), *[F.col(f"bf_w{w}").alias(f"__bf_w{w}") for w in range(WORDS)])
    joined = df.withColumn("__bf", block).join(F.broadcast(own) if blocks <= BROADCAST_BLOCKS else own.hint("merge"), F.col("__bf") == F.col("__bf_block"), "left")
    words = F.array(*[F.col(f"__bf_w{w}") for w in range(WORDS)])
    tests = [
        F.call_function("getbit", F.element_at(words, (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(63)) == 1
        for b in bits
    ]
    hit = reduce(lambda a, b: a & b, tests)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit & F.col(f"`{key}`").isNotNull(), F.lit(False)).alias(flag))
