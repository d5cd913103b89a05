"""Bloom filters over keys, as tables of bitmaps that can be merged.

A filter is cut into blocks of 32,768 bits.  A key has one block and ``PROBES``
bits in it, so a filter is one grouped aggregate (block, bitmap) that combines
before its shuffle, and two filters are merged block by block.  With
``KEYS_A_BLOCK`` keys a block about 1 in 100 keys that are not there pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block (what Spark's bitmap functions hold), bits a key sets in it, and keys for which a block is made.
BLOCK_BITS, PROBES, KEYS_A_BLOCK = 32_768, 4, 3_000
#: A filter of more blocks (4 KB each) is not sent to all tasks.
MOST_BLOCKS = 16_384


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys // KEYS_A_BLOCK))


def _block(keys: list[str], n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_blocks))


def _probes(keys: list[str]) -> list[Column]:
    second = F.xxhash64(F.lit(1), *keys)
    return [F.shiftrightunsigned(second, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long")) for k in range(PROBES)]


def built(df: DataFrame, keys: list[str], n_blocks: int) -> DataFrame:
    """block, bitmap over the distinct and repeated keys of ``df``."""
    bits = df.select(_block(keys, n_blocks).alias("block"), F.explode(F.array(*_probes(keys))).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of the keys of both; they must have the same number of blocks."""
    return one.unionByName(other).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def tested(df: DataFrame, filtered: DataFrame, keys: list[str], n_blocks: int, name: str = "maybe") -> DataFrame:
    """``df`` with a flag: False if the key is surely not in the filter.

    The filter goes to all tasks, so ``n_blocks`` must be at most ``MOST_BLOCKS`` (64 MB).
    """
    if n_blocks > MOST_BLOCKS:
        raise ValueError(f"a filter of {n_blocks} blocks is too large to be sent to all tasks")
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.lit(True)
    for k in range(PROBES):
        bit = F.col(f"_bit{k}")
        found = found & (F.getbit(byte(bit), (bit % 8).cast("int")) == 1)
    probed = df.withColumns({"_block": _block(keys, n_blocks), **{f"_bit{k}": c for k, c in enumerate(_probes(keys))}})
    side = F.broadcast(filtered.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap")))
    joined = probed.join(side, "_block", "left").withColumn(name, F.coalesce(found, F.lit(False)))
    return joined.select(*df.columns, name)
