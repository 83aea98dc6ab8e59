"""Blocked Bloom filters as tables: a key sets one bit in each of the eight 64-bit words of one block.

A filter is built by aggregation and broadcast; it has a largest size, MOST_BLOCKS blocks of 64 bytes. More keys fill it more, so that more
others pass; no key is ever missed, and an exact join decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import quoted

WORDS = 8
KEYS_PER_BLOCK = 32
MOST_BLOCKS = 1 << 17


def block_count(keys: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-keys // KEYS_PER_BLOCK)))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a key's block."""
    digest = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(digest, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")


def blocked_filter(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, w0 .. w7) of the blocks that hold a key; `keys` are combined before they are shuffled."""
    words = [F.bit_or(F.expr("shiftleft(1L, b[%d])" % k)).alias(f"w{k}") for k in range(WORDS)]
    return keys.select(_block(quoted(key), blocks).alias("block"), F.array(*_bits(quoted(key))).alias("b")).groupBy("block").agg(*words)


def possible(rows: DataFrame, bloom: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others."""
    tested = rows.withColumn("block", _block(quoted(key), blocks)).join(F.broadcast(bloom), "block")
    for k, bit in enumerate(_bits(quoted(key))):
        tested = tested.filter(F.getbit(F.col(f"w{k}"), bit) == 1)
    return tested.select(*rows.columns)
